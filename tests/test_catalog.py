"""Every registered query with SQL gives the SQL's rows on the small tables; all others give rows."""

import collections
import datetime

import duckdb
import pytest

import __spark_entry__ as entry
from namewright.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 6) if isinstance(v, float) else v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_oracle(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_rows(spark, sf, name):
    assert not entry.queries()[name](spark, sf).isEmpty()


def test_word_diff_is_difflibs(spark, sf):
    import difflib

    from namewright.operators import edits
    from namewright.plans.identifiers import renames

    got = collections.Counter((r.commit, r.idx, r.old_name, r.new_name, r.op, r.old_words, r.new_words) for r in entry.queries()["word_diff_ops"](spark, sf).collect())
    want = collections.Counter()
    for r in renames(spark, sf).collect():
        old, new = edits.parse(r.old_name).words, edits.parse(r.new_name).words
        for o, a, b, c, d in difflib.SequenceMatcher(None, old, new).get_opcodes():
            if o != "equal":
                want[r.commit, r.idx, r.old_name, r.new_name, o, " ".join(old[a:b]) if o != "insert" else "", " ".join(new[c:d]) if o != "delete" else ""] += 1
    assert got == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["word", "word_case", "n"] and df.count() > 0
