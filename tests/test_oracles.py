"""Every registered query against DuckDB on the given tables."""

from __future__ import annotations

import os

import oracle
import pytest

import __spark_entry__ as contract
from movecheck.plans.registry import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, connection, name):
    n, problems = oracle.compare(
        spark, QUERIES[name], ORACLES[name], SF_DIR, connection
    )
    assert not problems
    if name != "rename_detection":  # volumes may be too small to match at the smallest scale
        assert n > 0


def test_entry(spark):
    assert contract.entry(spark).columns == ["cohort", "n", "retained", "rate"]
