"""The queries with SQL oracles against them, as the driver compares them."""

import pytest
from conftest_llm import SF
from oracle_compare import compare, duck

from shopflow.llm.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, key):
    r = compare(spark, key, QUERIES[key], ORACLES[key], SF, duck(SF))
    assert r["names_match"] and r["type_mismatches"] == [] and r["values_match"], r
