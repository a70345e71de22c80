"""Content-addressed WARC archive (DataFrame functions only).

write_archive() stores, in the shared folder, one row for each record with its exact header bytes
(``records``) and each payload's bytes once under its SHA-256 (``payloads``). read_archive() checks
every stored payload against its digest and rebuilds the records by a join: for a revisit the header
is its own and the payload comes from the response it refers to.

Of records with equal payloads of at least min_revisit bytes the one with the smallest id is the
response, others are revisits; smaller payloads are always responses (their bytes are stored once too).
Defined results: a null payload is empty; a null URL leaves out the WARC-Target-URI line; white space
and control characters in a URL are percent-encoded, so that a header line cannot be broken; null ids
come after all others and never serve as the response where another id exists (where all ids of a
group are null, all are responses); rows that repeat the smallest id are all responses; an empty
table gives an empty archive; further columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
MIN_REVISIT = 100
URN = "urn:record:"


def describe(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, n_bytes, record_type, refers_to.

    Only (digest, id) pairs are shuffled to find first ids, pre-aggregated on the map side; then the
    pages meet the first ids of the digests that occur twice or more.
    """
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumns({"digest": F.sha2("payload", 256), "n_bytes": F.octet_length("payload").cast("long")})
    firsts = p.filter(F.col("n_bytes") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    p = p.join(firsts, "digest", "left")
    revisit = (F.col("n_bytes") >= min_revisit) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return p.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("first_id"))}).drop("first_id")


def _uri(c):
    for ch in [" ", *map(chr, range(32)), "\x7f"]:
        c = F.replace(c, F.lit(ch), F.lit(f"%{ord(ch):02X}"))
    return c


def with_header(described: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Adds header: the record's exact header block, with its closing empty line."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    urn = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    url = F.when(F.col("url").rlike(r"[\x00-\x20\x7F]"), _uri(F.col("url"))).otherwise(F.col("url"))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", url)).otherwise(""), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))), F.lit(CRLF),
    )
    return described.withColumn("header", header.cast("binary"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = MIN_REVISIT) -> str:
    """Writes the archive below path: records (header bytes) and payloads (bytes once for each digest)."""
    d = describe(pages, id_col, url_col, payload_col, min_revisit)
    # two passes: the records' pass moves no payload, and the payloads' shuffle carries each task's distinct ones
    with_header(d).select("page_id", "digest", "header").write.option("compression", "zstd").parquet(f"{path}/records")
    payload = pages.select(F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    payload.select(F.sha2("payload", 256).alias("digest"), "payload").dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/payloads")
    return path


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: page_id, record_type, refers_to, url, header, digest (of the bytes read), payload, payload_bytes, record.

    A payload whose bytes do not have the digest it is stored under, or is missing, ends the read with an error.
    record is the whole WARC record: header, block (empty for a revisit) and two line ends.
    """
    p = spark.read.parquet(f"{path}/payloads").withColumn("found", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    p = p.withColumn("found", F.when(F.col("found") == F.col("digest"), F.col("found")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("digest")))))
    r = spark.read.parquet(f"{path}/records").withColumn("_h", F.col("header").cast("string"))
    field = lambda name: F.regexp_extract("_h", rf"(?m)^{name}: ([^\r\n]*)", 1)
    r = r.withColumns({"record_type": field("WARC-Type"), "url": F.nullif(field("WARC-Target-URI"), F.lit("")), "_to": field("WARC-Refers-To"), "in_header": F.regexp_extract("_h", r"(?m)^WARC-Payload-Digest: sha256:([0-9a-f]{64})", 1)})
    r = r.withColumn("refers_to", F.when(F.col("_to") != "", F.regexp_extract("_to", rf"^<{URN}(.*)>$", 1)))
    out = r.join(p, "digest", "left")
    whole = F.when((F.col("found") == F.col("in_header")), F.col("found")).otherwise(F.raise_error(F.concat(F.lit("no payload under "), F.col("in_header"))))
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return out.select("page_id", "record_type", "refers_to", "url", "header", whole.alias("digest"), "payload", "payload_bytes", F.concat("header", block, F.lit((CRLF * 2).encode())).alias("record"))
