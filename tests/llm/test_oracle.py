"""Queries with SQL give the SQL's rows on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from namewright.llm.oracle import ORACLE


@pytest.mark.parametrize("name", sorted(ORACLE))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_oracle(spark, name, size):
    d = f"/root/testdata/{size}"
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    cur = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    df = entry.queries()[name](spark, d)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=repr) == sorted(cur.fetchall(), key=repr)
