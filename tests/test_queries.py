"""Every registered query next to its check SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import rows_of

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    got = df.collect()
    assert got
    sql = entry.oracle_sql().get(name)
    if sql:
        rel = con.sql(sql)
        want, cols = rel.fetchall(), rel.columns
        assert sorted(cols) == sorted(df.columns)
        assert rows_of(df.columns, got) == rows_of(cols, want)
