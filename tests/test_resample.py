import random

import pytest
from pyspark.sql import functions as F

from counterpoise.operators import prepare, resample
from counterpoise.plans import ladder
from counterpoise.sources.tables import task
from counterpoise.task import TaskSet


def numeric(spark, n_major=40, n_minor=20, seed=1, name="n"):
    pick = random.Random(seed)
    rows = [(i, pick.gauss(0, 1), pick.gauss(0, 1), 0) for i in range(n_major)]
    rows += [(1000 + i, pick.gauss(1, 1), pick.gauss(1, 1), 1) for i in range(n_minor)]
    return task(spark.createDataFrame(rows, "id int, a double, b double, y int"), "y", key="id", name=name)


def mixed(spark, features):
    rows = [(i, [1.0, 2.0, 3.0][i % 3] + i / 100, "abc"[i % 3], [1, 2, 2][i % 3], int(i % 3 == 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, b string, n int, y int")
    return task(df, "y", features, "id", "m")


def sizes(df):
    return {(r["variant"], r["y"]): r["count"] for r in df.groupBy("variant", "y").count().collect()}


@pytest.mark.parametrize("method", [resample.random_under, resample.near_miss])
def test_undersampling_counts(spark, method):
    found = sizes(method(numeric(spark), {"a": 1.0, "b": 1.5}))
    assert found == {("a", 0): 20, ("a", 1): 20, ("b", 0): 30, ("b", 1): 20}


@pytest.mark.parametrize("method", [resample.random_over, resample.smote])
def test_oversampling_counts(spark, method):
    found = sizes(method(numeric(spark), {"a": 1.0, "b": 1.6}))
    assert found == {("a", 0): 40, ("a", 1): 40, ("b", 0): 40, ("b", 1): 25}


def test_ratio_cannot_grow(spark):
    for method in (resample.random_under, resample.random_over, resample.near_miss, resample.smote):
        with pytest.raises(resample.BalancingError):
            method(numeric(spark), 5.0)


def test_undersampling_is_nested_and_partition_independent(spark):
    t = numeric(spark, 900, 100)
    seen = set()
    for n in (1, 4, 17):
        out = resample.random_under(t.with_df(t.df.repartition(n)), {"a": 1.0, "b": 2.0}, 5).collect()
        a = {r["rid"] for r in out if r["variant"] == "a"}
        b = {r["rid"] for r in out if r["variant"] == "b"}
        assert a < b
        seen.add((tuple(sorted(a)), tuple(sorted(b))))
    assert len(seen) == 1


def test_near_miss_keeps_closest_when_a_third_are_copies(spark):
    rows = [(i, 5.0 if i % 3 == 0 else 1.0 + i, 0) for i in range(90)] + [(1000 + i, 0.0 + i / 10, 1) for i in range(30)]
    t = task(spark.createDataFrame(rows, "id int, a double, y int"), "y", key="id")
    kept = [r["a"] for r in resample.near_miss(t, 1.0).where("y = 0").collect()]
    assert len(kept) == 30
    distances = sorted(min_mean(x) for _, x, y in rows if y == 0)
    assert sorted(round(min_mean(x), 9) for x in kept) == [round(d, 9) for d in distances[:30]]


def min_mean(x):
    return sum(sorted(abs(x - i / 10) for i in range(30))[:3]) / 3


def test_synthetic_rows_lie_between_minority_rows(spark):
    t = numeric(spark)
    out = resample.smote(t, 1.0, seed=3)
    minority = [(r["a"], r["b"]) for r in t.df.where("y = 1").collect()]
    for r in out.where(F.col("origin") == "synthetic").collect():
        assert any(on_segment((r["a"], r["b"]), p, q) for p in minority for q in minority if p != q)


def on_segment(x, p, q):
    span = [b - a for a, b in zip(p, q)]
    t = (x[0] - p[0]) / span[0]
    return -1e-9 <= t <= 1 + 1e-9 and abs(p[1] + t * span[1] - x[1]) < 1e-9


def test_smote_picks_the_variant_by_column_types(spark):
    for features in (["a"], ["a", "b"], ["b", "n"]):
        t = mixed(spark, features)
        out = resample.smote(t, 1.0)
        assert sizes(out) == {("balanced", 0): 40, ("balanced", 1): 40}
        assert out.select(*features).dtypes == t.df.select(*features).dtypes
    assert resample.categorical_features(mixed(spark, ["a", "b", "n"])) == ["b", "n"]


def test_smote_needs_two_minority_rows(spark):
    with pytest.raises(resample.BalancingError):
        resample.smote(numeric(spark, 10, 1), 1.0)


def test_borderline_without_danger_is_unchanged(spark):
    rows = [(i, float(i) / 100, 0) for i in range(60)] + [(500 + i, 100.0 + i / 100, 1) for i in range(20)]
    t = task(spark.createDataFrame(rows, "id int, a double, y int"), "y", key="id")
    assert sizes(resample.borderline_smote(t, 1.0)) == {("balanced", 0): 60, ("balanced", 1): 20}


def test_smote_tomek_leaves_no_links(spark):
    from counterpoise.operators.knn import tomek_links, vector_of

    t = numeric(spark, 60, 30, 5)
    out = resample.smote_tomek(t, 1.5)
    whole = resample.smote(t, 1.5)
    points = whole.select("rid", "y", vector_of(whole, t.features).alias("vec"))
    ends = {r["rid"] for r in tomek_links(points, "y").collect()}
    assert ends and out.count() == whole.count() - len(ends)
    assert not ends & {r["rid"] for r in out.collect()}


def test_only_the_train_part_is_resampled(spark):
    t = prepare.train_test_split(numeric(spark, 100, 20), 0.2, 1)
    made = ladder.rebalance_ladder(t, [ladder.RANDOM_UNDER, ladder.SMOTE], 2, seed=1)
    test_rows = {r["rid"] for r in t.test.df.select(F.col("rid").cast("string").alias("rid")).collect()}
    for name in made.names:
        variant = made.task(t, name)
        assert {r["rid"] for r in variant.test.df.collect()} == test_rows
        train = variant.train.df
        assert not {r["rid"] for r in train.collect()} & test_rows


def test_user_resampler_contract(spark):
    t = numeric(spark)
    with pytest.raises(resample.BalancingError):
        resample.custom(t, lambda df, label, ratio, seed: df.drop("a"))
    with pytest.raises(resample.BalancingError):
        resample.custom(t, lambda df, label, ratio, seed: df.withColumn("a", F.lit("text")))
    assert resample.custom(t, lambda df, label, ratio, seed: df.limit(7)).count() == 7


def test_ladder_values():
    assert ladder.ladder_ratios(resample.Classes(0, 1, 100, 10), 3) == [7.0, 4.0, 1.0]
    expected = {1: 5, 2: 5, 3: 4, 4: 3, 6: 3, 7: 2, 10: 2, 20: 1}
    classes = resample.Classes(0, 1, 40, 20)
    assert {m: len(ladder.ladder_ratios(classes, 5, m)) for m in expected} == expected
    assert ladder.ladder_ratios(resample.Classes(0, 1, 5, 5), 4) == []


def test_ladder_shape_names_and_order(spark):
    made = ladder.rebalance_ladder(numeric(spark), ladder.BASIC, 2, seed=1)
    assert len(made.names) == 3 * 2 + 1 and made.names[-1] == "n"
    assert made.names[0] == "n_transformed_UNDERSAMPLING__Random_IR=1.5=0.75BASE_IR=0.5IR_RANGE"
    bare = ladder.rebalance_ladder(numeric(spark), ladder.BASIC, 2, seed=1, keep_original=False)
    assert len(bare.names) == 6
    base = made.variants.where("is_base").collect()
    assert [r["variant"] for r in base] == ["n"]


def test_failing_methods_are_reported_and_others_survive(spark):
    made = ladder.rebalance_ladder(numeric(spark, 10, 1), ladder.BASIC, 2, seed=1)
    failed = {r["variant"] for r in made.failures.collect()}
    # One minority row: SMOTE can't make any, but the first ratio asks for none.
    assert len(failed) == 1 and all("SMOTE_IR=1.0=" in v for v in failed)
    assert len(made.names) == 6 and made.rows.count() > 0


def test_sweep(spark):
    t = numeric(spark)
    made = ladder.sweep(t, resample.random_under, [{"ratio": 1.0}, {"alpha": 0.8}], ["_x", "_x"])
    assert made.names == ("n_x", "n_x_1")
    assert sizes(made.rows)[("n_x_1", 0)] == 25
    with pytest.raises(ValueError):
        ladder.sweep(t, resample.random_under, [{}], ["_a", "_b"])


def test_sweep_over_a_collection_keeps_paths(spark):
    tasks = TaskSet.of([numeric(spark, name="a"), numeric(spark, 50, 25, name="b")]).nested("group")
    out = ladder.sweep_all(tasks, resample.random_over, [[{"ratio": 1.0}], [{"ratio": 1.0}, {"ratio": 1.5}]])
    assert list(out) == [("group", "a"), ("group", "b")]
    assert [len(v.names) for v in out.values()] == [1, 2]
    with pytest.raises(ValueError):
        ladder.sweep_all(tasks, resample.random_over, [[{"ratio": 1.0}]])


def test_stored_ladder_keeps_branches_whose_tasks_succeed(spark):
    from counterpoise.plans import ladder
    from counterpoise.registry import balancing, fixtures

    params = [{"ratio": 1.0}, {"ratio": balancing.REFUSED_RATIO}, {"ratio": 2.0}]
    made = ladder.sweep(fixtures.orders(spark, "/root/testdata/sf0.001"), balancing._audited_under, params).stored()
    ledger = {r.variant: r for r in made.ledger.collect()}
    assert [ledger[n].committed for n in ("orders_transformed_0", "orders_transformed_1", "orders_transformed_2")] == [True, False, True]
    assert "audit refuses" in ledger["orders_transformed_1"].reason
    counts = dict(made.rows.groupBy("variant").count().collect())
    assert counts == {n: ledger[n].n_rows for n in ("orders_transformed_0", "orders_transformed_2")}
    assert made.names == ("orders_transformed_0", "orders_transformed_2")
    assert [r.variant for r in made.failures.collect()] == ["orders_transformed_1"]
    assert {r.variant for r in made.variants.collect()} == {"orders_transformed_0", "orders_transformed_2"}


def test_stored_variants_are_differences_and_read_back_whole(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    from counterpoise.plans import ladder
    from counterpoise.registry import fixtures

    base = fixtures.orders(spark, "/root/testdata/sf0.001")
    methods = (ladder.RANDOM_UNDER, ladder.RANDOM_OVER)
    made = ladder.rebalance_ladder(base, methods, n_per_method=2, seed=3)
    before = Counter(tuple(r) for r in made.rows.select(*sorted(made.rows.columns)).collect())
    stored = made.stored()
    after = Counter(tuple(r) for r in stored.rows.select(*sorted(made.rows.columns)).collect())
    assert after == before
    ledger = {r.variant: r.n_rows for r in stored.ledger.collect()}
    assert ledger == dict(Counter(v for v, *_ in [(r.variant,) for r in made.rows.select("variant").collect()]))
    plus = sum(b.where(F.col("origin") != "original").count() for _, b in stored.branches)
    assert plus > 0
    for name in stored.names:
        own = Counter(tuple(r) for r in stored.variant_rows(name).select(*sorted(made.rows.columns)).collect())
        assert own == Counter(r for r in before.elements() if r[sorted(made.rows.columns).index("variant")] == name)
