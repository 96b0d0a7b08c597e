"""Every registered query with a SQL twin must match it on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from check_queries import compare, database

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    verdict, _ = compare(spark, con, FOLDER, name)
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    assert entry_points.entry(spark).count() == 6
