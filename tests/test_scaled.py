"""Steps that are read several times are made once, and joins of many rows do not sort them."""

import pytest
from pyspark.sql import functions as F

from counterpoise.functions.draws import draw
from counterpoise.operators import evaluate, explain, selection
from counterpoise.sources.tables import task


def _rows(spark, n=300):
    return spark.range(n).select(
        F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"), (F.col("id") % 3 == 0).cast("int").alias("y")
    )


def test_roc_auc_makes_its_distinct_scores_once(spark):
    scored = _rows(spark).select("y", F.lit("m").alias("model"), F.col("a").alias("p1"))
    out = evaluate.roc_auc(scored, ["model"])
    assert out.inputFiles() and all("distinct-scores" in f for f in out.inputFiles())
    rows = [(r["y"], r["p1"]) for r in scored.collect()]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    wins = sum((p > q) + (p == q) / 2 for p in pos for q in neg)
    assert out.first()["roc_auc"] == pytest.approx(wins / len(pos) / len(neg))


def test_dense_index_reads_its_rows_once(spark):
    rows = _rows(spark).withColumnRenamed("k", "rid")
    out = selection.dense_index(rows, draw(9, "x", F.col("rid")))
    assert out.columns == [*rows.columns, "idx"]
    assert out.inputFiles() and all("numbered" in f for f in out.inputFiles())
    expected = [r["rid"] for r in rows.withColumn("d", draw(9, "x", F.col("rid"))).orderBy("d", "rid").collect()]
    assert [r["rid"] for r in out.orderBy("idx").collect()] == expected


def test_permutations_are_joined_without_a_sort(spark):
    given = task(_rows(spark), "y", ["a", "b"], "k", "t")
    losses = explain.permutation_importance(given, lambda df: (F.col("a") + F.col("b")) / 20, rounds=3, loss="rmse")
    plan = losses._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(r["variable"] for r in losses.collect()) == ["a", "b"]
