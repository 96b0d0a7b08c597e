"""Queries with a SQL twin must match it on the smallest tables; those without must run on them."""

import pytest

from check_queries import compare, database
from counterpoise.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    verdict, _ = compare(spark, database(FOLDER), FOLDER, name)
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_has_one_row_for_each_document(spark, name):
    n = queries.QUERIES[name](spark, FOLDER).count()
    assert n == (50 if name == "op3_hnsw" else 200)
