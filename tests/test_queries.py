"""Every query with SQL, against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

from geochron.plans.queries import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, other, name):
    df = QUERIES[name](spark, SF)
    want = other.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    mine = sorted(tuple(repr(r[c]) for c in cols) for r in df.collect())
    at = [want.columns.index(c) for c in cols]
    theirs = sorted(tuple(repr(r[i]) for i in at) for r in want.fetchall())
    assert mine == theirs


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
