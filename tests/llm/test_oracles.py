"""Queries with SQL agree with DuckDB on the smallest driver tables."""

import os

import duckdb
import pytest

from quern.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", registry.oracle_sql())
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.sql(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    cols = sorted(want.columns)
    assert sorted(map(str, want[cols].itertuples(index=False, name=None))) == sorted(map(str, got[cols].itertuples(index=False, name=None)))
