"""Every registered query on the smallest folder against its SQL twin."""

import pytest
from compare import duck, mismatch
from conftest import SMALL

import __spark_entry__ as entry
from cellsight import registry

QUERIES, SQL = ({n: v for n, v in found.items() if n in registry.QUERIES} for found in (entry.queries(), entry.oracle_sql()))


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert mismatch(QUERIES[name](spark, SMALL), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() == spark.read.parquet(f"{SMALL}/supplier.parquet").count()
