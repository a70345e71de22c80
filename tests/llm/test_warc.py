"""op2: archives written, read back and compared with a plain model; damage is noticed."""

import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from namewright.llm import warc
from namewright.llm.common import new_path

BIG = "<p>" + "x" * 200 + "é</p>"
ROWS = [(5, "http://a/1", BIG), (2, "http://a/2\r\nX-Bad: 1", BIG), (9, None, BIG), (1, "http://b", "small"), (3, "http://b", "small"), (4, "http://c", None), (6, "u", ""), (7, "u", BIG + "!"), (None, "n", BIG), (8, "u", "y" * 99), (10, "u", "y" * 99), (11, "u", "y" * 100), (12, "u", "y" * 100)]


@pytest.fixture(scope="module")
def read(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("digest", F.lit("mine"))
    return warc.read_archive(spark, warc.write_archive(pages, new_path(spark, "warc"))).collect()


def test_model(read):
    got = {r.page_id: (r.payload_bytes, r.digest, r.record_type, r.refers_to) for r in read}
    first = {}
    for i, _, h in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (h or "").encode()
        d = hashlib.sha256(b).hexdigest()
        to = first.setdefault(d, i) if len(b) >= 100 else i
        assert got[i] == (len(b), d, "response" if to == i else "revisit", None if to == i else str(to))
    assert len(read) == len(ROWS)


def test_records(read):
    for r in read:
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1" and all(": " in x for x in lines[1:]) and bytes(r.header) == head + b"\r\n\r\n"
        fields = dict(x.split(": ", 1) for x in lines[1:])
        assert "X-Bad" not in fields and block[-4:] == b"\r\n\r\n" and len(block) - 4 == int(fields["Content-Length"])
        assert block[:-4] == (b"" if r.record_type == "revisit" else bytes(r.payload))
        assert hashlib.sha256(bytes(r.payload)).hexdigest() == fields["WARC-Payload-Digest"].removeprefix("sha256:")


def test_payloads_once_and_damage(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    path = warc.write_archive(pages, new_path(spark, "warc"))
    p = spark.read.parquet(f"{path}/payloads")
    assert p.count() == p.select("digest").distinct().count() == len({(r[2] or "") for r in ROWS})
    bad = new_path(spark, "warc")
    spark.read.parquet(f"{path}/records").write.parquet(f"{bad}/records")
    p.withColumn("payload", F.concat("payload", F.lit(b"?"))).write.parquet(f"{bad}/payloads")
    with pytest.raises(PySparkException):
        warc.read_archive(spark, bad).collect()
    gone = new_path(spark, "warc")
    spark.read.parquet(f"{path}/records").write.parquet(f"{gone}/records")
    p.limit(1).write.parquet(f"{gone}/payloads")
    with pytest.raises(PySparkException):
        warc.read_archive(spark, gone).collect()


def test_repeats_and_empty(spark):
    twice = spark.createDataFrame([(1, "u", BIG), (1, "u", BIG), (2, "u", BIG)], "page_id long, url string, html string")
    r = warc.read_archive(spark, warc.write_archive(twice, new_path(spark, "warc"))).collect()
    assert sorted(x.record_type for x in r) == ["response", "response", "revisit"]
    nulls = spark.createDataFrame([(None, "u", BIG), (None, "u", BIG)], "page_id long, url string, html string")
    assert {x.record_type for x in warc.read_archive(spark, warc.write_archive(nulls, new_path(spark, "warc"))).collect()} == {"response"}
    assert warc.read_archive(spark, warc.write_archive(twice.limit(0), new_path(spark, "warc"))).count() == 0
