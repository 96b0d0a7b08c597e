"""All registered queries and their SQL twins."""

from __future__ import annotations

from counterpoise.registry import balancing, comparisons, explanations, identity, models, preparation

GROUPS = (preparation, identity, balancing, models, explanations, comparisons)


def queries():
    return {name: query for group in GROUPS for name, (query, _) in group.QUERIES.items()}


def oracle_sql():
    return {name: sql for group in GROUPS for name, (_, sql) in group.QUERIES.items() if sql is not None}
