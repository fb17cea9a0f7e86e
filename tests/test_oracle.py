"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from siftrank.catalog import oracle, queries, round_trips  # noqa: F401
from tests.oracle_check import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_sql():
    assert set(queries.REGISTRY) == set(oracle.oracle_sql())
    assert set(queries.REGISTRY) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(queries.REGISTRY))
def test_query_matches_sql(spark, con, name):
    ok, message = compare(spark, con, FOLDER, name)
    assert ok, message


def test_entry(spark):
    assert contract.entry(spark).count() == 1
