import random

from pyspark.sql import functions as F

from counterpoise.functions.draws import draw
from counterpoise.operators import selection as S


def test_cuts_with_a_hot_value(spark, monkeypatch):
    """A third of the rows share one value; narrow histograms force several rounds."""
    monkeypatch.setattr(S, "SLICES", 8)
    monkeypatch.setattr(S, "RANKABLE_ROWS", 20)
    pick = random.Random(5)
    rows = [(i, "g" if i % 4 else "h", 7.5 if i % 3 == 0 else pick.uniform(0, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "rid bigint, grp string, x double").repartition(7)
    order = [F.col("x"), draw(1, "tie", F.col("rid"))]
    sizes = {"g": [1, 400, 900, 2249, 2250, 5000], "h": [0, 100]}
    counts, cuts = S.exact_cuts(df, "grp", order, lambda c: sizes)
    assert counts == {"g": 2250, "h": 750}
    hashes = {r["rid"]: r["h"] for r in df.select("rid", order[1].alias("h")).collect()}
    for (group, n), cut in cuts.items():
        chosen = {r["rid"] for r in df.where((F.col("grp") == group) & S.up_to(cut, order)).collect()}
        wanted = sorted((x, hashes[i], i) for i, g, x in rows if g == group)[:n]
        assert chosen == {i for _, _, i in wanted}, (group, n)


def test_dense_index_is_a_permutation_for_any_partitioning(spark):
    df = spark.range(5000).select(F.col("id").alias("rid"), (F.col("id") % 3).alias("g"))
    seen = set()
    for n in (1, 4, 17):
        out = S.dense_index(df.repartition(n), draw(9, "x", F.col("rid")), by=["g"]).collect()
        for g in range(3):
            assert sorted(r["idx"] for r in out if r["g"] == g) == list(range(len([1 for r in out if r["g"] == g])))
        seen.add(tuple(sorted((r["rid"], r["idx"]) for r in out)))
    assert len(seen) == 1


def test_sample_has_the_exact_size(spark):
    df = spark.range(1000).withColumnRenamed("id", "rid")
    assert S.sample_rows(df, 137, 3).count() == 137
    assert S.sample_rows(df, 5000, 3).count() == 1000
    assert S.sample_rows(df, None, 3).count() == 1000


def test_value_buckets_are_ordered_and_even(spark):
    df = spark.range(4000).select(F.lit("g").alias("g"), (F.exp(F.col("id") / 100)).alias("v"))
    sizes = S.value_buckets(df, ["g"], "v", cuts=16).groupBy("_bucket").agg(
        F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
    ).orderBy("_bucket").collect()
    assert len(sizes) == 16 and max(r["n"] for r in sizes) < 400
    assert all(a["hi"] < b["lo"] for a, b in zip(sizes, sizes[1:]))
