"""Ids, names, missing labels and the meaning of the classes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from counterpoise.operators import explain, model, prepare, resample
from counterpoise.plans import ladder
from counterpoise.sources.tables import task


def test_reserved_features_neither_leak_nor_vanish(spark):
    rng = random.Random(3)
    rows = [(i, rng.random(), rng.random(), rng.random(), rng.random(), i % 3 == 0) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, y double, split double, p1 double, code double, kind boolean")
    made = task(df, "kind", key="id")
    assert not made.was_split and prepare.imbalance_ratio(made) == 2.0
    sums = made.df.agg(*[F.sum(c) for c in made.features]).first()
    assert [round(x, 9) for x in sums] == [round(sum(r[k] for r in rows), 9) for k in range(1, 5)]
    fitted = model.fit_model(made, model.random_forest(trees=5, depth=3), test_size=0.5, seed=1)
    auc = {r["metric"]: r["value"] for r in fitted.evaluate().collect()}
    assert auc["roc_auc"] < 0.8


def test_reserved_label_and_id_feature(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, 6.0, "b")], "k long, rid double, split string")
    made = task(df, "split", ["rid"], "k")
    assert made.label == "split_kept" and made.features == ("rid_kept",)
    assert sorted(map(tuple, made.df.collect())) == [(1, 5.0, "a"), (2, 6.0, "b")]


def test_ids_of_keys_and_rows(spark):
    rows = [("a|b", "c", 1), ("a", "b|c", 1), (None, "x", 1), ("x", None, 1), ("\\N", "x", 1), ("x", None, 1)]
    df = spark.createDataFrame(rows, "one string, two string, v int")
    assert task(df, None, ["v"], ["one", "two"]).df.select("rid").distinct().count() == 5
    assert task(df, None).df.select("rid").distinct().count() == 6
    with pytest.raises(ValueError, match="repeats"):
        task(df, None, ["v"], ["one", "two"], check_key=True)


def test_null_labels_take_no_part(spark):
    rows = [(i, float(i), None if i % 10 == 0 else i % 3 == 0) for i in range(200)]
    made = task(spark.createDataFrame(rows, "id long, a double, kind boolean"), "kind", key="id")
    split = prepare.train_test_split(made, 0.25, 7)
    assert split.fitting_rows.count() + split.judging_rows.count() == 180
    assert split.df.where("kind is null and split is not null").count() == 0
    coded = model.encode_target(made.df, "kind", False)
    assert coded.where("kind is null and y is not null").count() == 0
    assert resample.random_over(made, 1.0).where("kind is null").count() == 0


@pytest.fixture
def turned(spark):
    """The majority label, 1, is the larger one."""
    rows = [(i, random.Random(i).random(), random.Random(-i).random(), 0 if i % 4 == 0 else 1) for i in range(120)]
    return task(spark.createDataFrame(rows, "id long, a double, b double, kind int"), "kind", key="id")


def test_class_meaning_survives_ratio_one(turned):
    made = ladder.rebalance_ladder(turned, [ladder.RANDOM_UNDER], n_per_method=2)
    even = made.task(turned, made.names[1])
    assert prepare.imbalance_ratio(even) == 1.0 and even.majority == 1
    assert model.fit_model(even, model.random_forest(trees=2, depth=2)).majority == 1


def test_importance_uses_the_label_of_the_model(turned):
    fitted = model.fit_model(turned, model.random_forest(trees=3, depth=2))
    own = explain.permutation_importance(fitted.task, fitted.score, rounds=2, majority=fitted.majority, model=fitted.name)
    through = explain.explain_all({("x",): fitted}, "VI", rounds=2)
    assert {r["variable"]: r["dropout_loss"] for r in own.collect()} == {r["variable"]: r["dropout_loss"] for r in through.collect()}
    none = explain.explain_all({("x",): fitted}, "VI", variables=["missing"])
    assert none.count() == 0 and "path" in none.columns
    assert explain.explain_all({("x",): fitted}, "PDP", variables=["missing"]).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 60, 1009, 10_000])
def test_shuffles_are_one_to_one(n):
    for multiplier, shift in explain.shuffles(n, 4, seed=3):
        assert math.gcd(multiplier, n) == 1
        assert sorted((multiplier * i + shift) % n for i in range(n)) == list(range(n))


def test_smote_refuses_missing_numbers_and_counts_missing_categories(spark):
    rows = [(i, float("nan") if i % 7 == 0 else float(i), i % 4 == 0) for i in range(80)]
    broken = task(spark.createDataFrame(rows, "id long, a double, kind boolean"), "kind", key="id")
    with pytest.raises(resample.BalancingError, match="missing"):
        resample.smote(broken, 1.0)
    rows = [(i, None if i % 5 == 0 else "pqr"[i % 3], "st"[i % 2], i % 4 == 0) for i in range(80)]
    texts = task(spark.createDataFrame(rows, "id long, a string, b string, kind boolean"), "kind", key="id")
    made = resample.smote(texts, 1.0)
    assert made.where("origin = 'synthetic'").count() == 40
    mixed = [(r[0], r[1], float(r[0]), r[3]) for r in rows]
    made = resample.smote(task(spark.createDataFrame(mixed, "id long, a string, b double, kind boolean"), "kind", key="id"), 1.0)
    assert made.where("origin = 'synthetic'").count() == 40


def test_one_bad_ratio_spoils_no_other(turned):
    def picky(t, ratios, seed):
        if any(r < 2 for r in ratios.values()):
            raise resample.BalancingError("too even")
        return resample.random_under(t, ratios, seed)

    made = ladder.rebalance_ladder(turned, {"PICKY": picky}, n_per_method=4, keep_original=False)
    assert len(made.names) == 2 and made.failures.count() == 2

    def dead(t, ratios, seed):
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        ladder.rebalance_ladder(turned, {"DEAD": dead}, n_per_method=1)
