"""Blocks of the neighbour join are smaller in few dimensions; small tables need no Python worker."""

import math
import random

from pyspark.sql import functions as F

from counterpoise.operators import knn
from counterpoise.workspace import small_table


def _points(spark, n=300, dims=2):
    pick = random.Random(4)
    rows = [(i, [float(pick.randrange(40)) for _ in range(dims)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "rid long, vec array<double>")


def test_narrow_blocks_give_the_same_neighbours(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_POINTS", 128)
    monkeypatch.setattr(knn, "NARROW_POINTS", 16)
    rows, points = _points(spark)
    found = sorted((r["rid"], r["rank"], r["neighbour"]) for r in knn.nearest(points, points, 2).collect())
    expected = []
    for i, v in rows:
        near = sorted((math.dist(v, w), j) for j, w in rows if j != i)[:2]
        expected += [(i, rank, j) for rank, (_, j) in enumerate(near, 1)]
    assert found == sorted(expected)


def test_smaller_blocks_make_more_leaves(spark):
    _, points = _points(spark)
    assert knn._kd_tree(points, 300, 32).leaves > knn._kd_tree(points, 300, 256).leaves


def test_small_tables_are_not_read_by_python(spark):
    made = small_table(spark, {"a": range(3), "b": [5, 6, 7]})
    assert "ExistingRDD" not in made._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in made.orderBy("a").collect()] == [(0, 5), (1, 6), (2, 7)]
    assert made.agg(F.sum("b")).first()[0] == 18 and small_table(spark, {"a": []}).count() == 0
