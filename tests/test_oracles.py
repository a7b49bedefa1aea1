"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import pytest
from oracle_compare import compare, duck

from shopflow.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, con, key):
    r = compare(spark, key, QUERIES[key], ORACLES[key], SF, con)
    assert r["names_match"], r
    assert r["type_mismatches"] == [], r
    assert r["values_match"], r


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, key):
    df = QUERIES[key](spark, SF)
    assert df.count() >= 0


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["category", "order_count", "total_sold", "revenue"]
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
