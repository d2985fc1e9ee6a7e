"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from checks.registry import ORACLES, QUERIES
from tests.compare import assert_same, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert_same(spark, con, FOLDER, entry.queries()[name], entry.oracle_sql()[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
