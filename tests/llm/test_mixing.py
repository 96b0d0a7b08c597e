import pytest
from pyspark.sql import functions as F

from counterpoise.llm import mixing

SCHEMA = "doc_id long, text string, source string, lang string"


@pytest.fixture
def docs(spark):
    """Source ``hot`` has most rows; languages and first letters vary."""
    rows = []
    for i in range(1500):
        source = "hot" if i % 3 else f"s{i % 7}"
        lang = "de" if i % 4 == 0 else "en"
        rows.append((i, " ".join(f"{'abcd'[(i + k) % 4]}word{k % 3}x" for k in range(5 + i % 11)), source, lang))
    return spark.createDataFrame(rows, SCHEMA)


def shares(raked, dim, column):
    total = sum(r["s"] for r in raked.groupBy(dim).agg(F.sum(column).alias("s")).collect())
    return {r[dim]: r["s"] / total for r in raked.groupBy(dim).agg(F.sum(column).alias("s")).collect()}


def test_marginals_meet_targets(spark, docs):
    rows = docs.withColumn("tokens", F.size(F.split("text", " ")))
    table = mixing.cells(rows, ["source", "lang"], "tokens")
    targets = {
        "source": spark.createDataFrame([(s, 1.0) for s in ("hot", "s0", "s1", "s2", "s3", "s4", "s5", "s6")], "source string, share double"),
        "lang": spark.createDataFrame([("en", 3.0), ("de", 1.0), ("xx", 9.0)], "lang string, share double"),
    }
    raked = mixing.rake(table, targets, sweeps=20)
    assert all(abs(x - 1 / 8) < 1e-4 for x in shares(raked, "source", "weight").values())
    assert abs(shares(raked, "lang", "weight")["en"] - 0.75) < 1e-4
    assert raked.agg(F.sum("weight")).first()[0] == pytest.approx(table.agg(F.sum("tokens")).first()[0])
    chances = mixing.probabilities(raked, 0.5, 30)
    kept = chances.agg(F.sum(F.col("tokens") * F.col("probability")) / F.sum("tokens")).first()[0]
    assert kept == pytest.approx(0.5, abs=1e-3)


def test_value_without_target_keeps_its_share(spark):
    table = spark.createDataFrame([("a", 10.0), ("b", 30.0), ("c", 60.0)], "source string, tokens double")
    raked = mixing.rake(table, {"source": spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, share double")}, sweeps=2)
    assert {r["source"]: round(r["weight"], 6) for r in raked.collect()} == {"a": 20.0, "b": 20.0, "c": 60.0}


def test_draw_follows_probabilities(docs):
    got = mixing.mix(docs, keep_share=0.6)
    assert got.columns == [*docs.columns, "tokens", "topic", "probability", "kept"]
    sums = got.agg(F.sum(F.col("kept").cast("int") * F.col("tokens")), F.sum(F.col("probability") * F.col("tokens")), F.sum("tokens")).first()
    assert sums[1] / sums[2] == pytest.approx(0.6, abs=0.02)
    assert sums[0] / sums[2] == pytest.approx(0.6, abs=0.06)
    again = mixing.mix(docs.repartition(5), keep_share=0.6)
    assert sorted(got.where("kept").select("doc_id").collect()) == sorted(again.where("kept").select("doc_id").collect())


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "a", "en"), (2, "", "a", None), (3, "?", None, "en"), (4, "some words here", None, None), (4, "some words here", None, None), (None, "word " * 200_000, "a", "en")],
        SCHEMA,
    ).withColumn("kept", F.lit("x")).withColumn("topic", F.lit(1))
    got = mixing.mix(docs)
    assert got.columns == [*docs.columns, "tokens", "topic_1", "probability", "kept_1"]
    rows = {(r["doc_id"], r["tokens"]): r for r in got.collect()}
    assert got.count() == 6
    assert rows[1, 0]["probability"] == 0.0 and not rows[1, 0]["kept_1"] and rows[2, 0]["topic_1"] == "none"
    assert rows[None, 200_000]["tokens"] == 200_000 and rows[3, 1]["topic_1"] == "none"
    assert got.where("doc_id = 4").select("kept_1").distinct().count() == 1
    assert mixing.mix(docs.limit(0)).count() == 0


def test_ties_go_to_the_smaller_group(spark):
    # 'aaaaa': (97 + 5) % 4 = 2; 'bbbbb': 3.
    docs = spark.createDataFrame([(1, "aaaaa bbbbb"), (2, "bbbbb aaaaa bbbbb")], "doc_id int, text string")
    got = {r["doc_id"]: r["topic"] for r in mixing.with_facts(docs, "text", "tokens", "topic").collect()}
    assert got == {1: "group2", 2: "group3"}
