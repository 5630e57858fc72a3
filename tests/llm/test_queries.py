"""The llm queries on the smallest tables, against their SQL where there is one."""

import glob
import os

import duckdb
import pytest

from compare import assert_same_rows
from foliolake.llm import queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    if name in queries.ORACLES:
        assert_same_rows(df, duck.execute(queries.ORACLES[name]))
    else:
        assert df.columns and df.count() > 0


def test_columns(spark, sf_dir):
    want = {"p2_found": ["doc"], "p3_found": ["crop_a", "crop_b"], "p4_found": ["record_id", "line_no", "kind"], "p8_found": ["doc_id", "span_start", "span_end"]}
    for name, cols in want.items():
        assert queries.QUERIES[name](spark, sf_dir).columns == cols
