"""Every registered batch query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tideline.plans import catalog, oracle
from tests.compare import connect, difference


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(catalog.all_queries()) == set(oracle.all_sql())


@pytest.mark.parametrize("name", list(catalog.all_queries()))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert difference(spark, con, entry.queries()[name], entry.oracle_sql()[name], sf_dir) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
