"""Queries that join tracks or genres, planned as for dimensions too large to broadcast."""

import pytest

import __spark_entry__ as entry
from checks import with_tracks  # noqa: F401
from checks.registry import ORACLES
from tests.compare import NO_BROADCASTS, assert_same, connect, settings
from tests.test_oracle import FOLDER

NAMES = sorted(
    n for n in ORACLES
    if any(k in n for k in ("genre", "release_", "same_year", "artist_popularity", "overview_full"))
)


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql_without_broadcasts(spark, con, name):
    with settings(spark, NO_BROADCASTS):
        assert_same(spark, con, FOLDER, entry.queries()[name], entry.oracle_sql()[name])
