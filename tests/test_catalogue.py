"""Every query with SQL gives the rows of the SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quadlake.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
SLOW = {"commit_checkout"}  # test_store has its parts


def norm(v):
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - SLOW))
def test_query(spark, tables, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(norm([r[c] for c in cols]) for r in df.collect())
    if name in catalogue.SQL:
        rel = tables.sql(catalogue.SQL[name])
        assert sorted(rel.columns) == cols
        assert got == sorted(norm([r[rel.columns.index(c)] for c in cols]) for r in rel.fetchall())
    else:
        assert got


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(catalogue.SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
