"""Every registered query runs on the smallest tables and gives the rows that its SQL gives."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from compare import assert_same_rows


def test_registry_is_consistent():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not n.startswith("p") or not n[1:2].isdigit()))
def test_query(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    if name in entry.oracle_sql():
        assert_same_rows(df, duck.execute(entry.oracle_sql()[name]))
    else:
        assert len(df.columns) > 0 and df.count() > 0
