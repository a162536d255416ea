"""Every registered query against its DuckDB oracle on the smallest driver
folder (the driver's own gate runs the same comparison at sf0.01)."""

import os

import pytest

import __spark_entry__ as E
from counterbook.plans import registry
from counterbook.plans.compare import compare, duckdb_connection

SF = os.environ.get("COUNTERBOOK_TEST_SF", "/root/testdata/sf0.001")
registry.load_all()
QUERIES = dict(registry.QUERIES)
ORACLE = dict(registry.ORACLE)


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["period", "order_count", "gross_sales", "total_discounts", "net_sales", "items_sold"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SF), con, ORACLE[name])
    assert ok, msg
