"""All registered queries against their SQL twins at sf0.001."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from crestline.registry import COVERS, QUERIES, SQL
from tools.compare import compare

SF = "/root/testdata/sf0.001"
NAMES = list(SQL)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    status, note, _ = compare(spark, con, name, QUERIES[name], SQL[name], SF)
    assert status == "ok", note


def test_contract(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(COVERS) == set(QUERIES)
