"""Every registered query against its DuckDB statement on the smallest test tables."""

import pytest

import __spark_entry__ as entry
import compare
from parcelyard.trial import oracle, registry

SF = "/root/testdata/sf0.001"
QUERIES = registry.all_queries()
ORACLES = oracle.all_oracles()


@pytest.fixture(scope="module")
def duck():
    con = compare.connect(SF)
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert compare.difference(QUERIES[name](spark, SF), duck, ORACLES[name]) == ""


def test_the_driver_gets_them_all():
    assert QUERIES.keys() <= entry.queries().keys()
    assert ORACLES.keys() <= entry.oracle_sql().keys()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
