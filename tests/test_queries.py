"""Every query with SQL gives DuckDB's rows on sf0.001."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(name, spark, duck):
    a, b = entry.queries()[name](spark, SF).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda x: sorted(map(str, x[sorted(x.columns)].astype(object).where(x[sorted(x.columns)].notna(), None).itertuples(index=False, name=None)))
    assert rows(a) == rows(b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
