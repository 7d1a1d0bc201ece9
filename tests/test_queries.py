"""Every named query against its SQL twin on the smallest data set."""

import pytest
from twins import compare, duck

from foliant.plans.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, con, sf_dir, name):
    ok, note = compare(spark, con, name, sf_dir)
    assert ok, note


def test_every_query_has_a_twin():
    assert QUERIES.keys() == SQL.keys()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert entry.queries().keys() >= entry.oracle_sql().keys()
