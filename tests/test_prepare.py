import pytest
from pyspark.sql import functions as F

from counterpoise.operators import prepare
from counterpoise.sources.tables import task

NAN = float("nan")


def nans(spark, labels):
    rows = [(1, 1.0, "a", labels[0]), (2, 2.0, "b", labels[1]), (3, NAN, "c", labels[2])]
    return task(spark.createDataFrame(rows, "id int, a double, b string, y double"), "y", key="id")


def test_missing_rows_and_labels(spark):
    cleaned = prepare.remove_missing(nans(spark, (NAN, 0.0, 1.0)))
    assert cleaned.features == ("a", "b") and cleaned.df.count() == 1
    assert prepare.remove_missing(nans(spark, (1.0, 0.0, 1.0)), 1).df.count() == 2


def test_mostly_missing_column_is_dropped(spark):
    rows = [(i, None if i else 1.0, float(i), i % 2) for i in range(20)]
    t = task(spark.createDataFrame(rows, "id int, a double, b double, y int"), "y", key="id")
    assert prepare.remove_missing(t).features == ("b",)
    kept = prepare.remove_missing(t, 0.95)
    assert kept.features == ("a", "b") and kept.df.count() == 1


def test_outliers(spark):
    a = [1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1000.0]
    rows = [(i, x, "abcabpq"[i], y) for i, (x, y) in enumerate(zip(a, [0, 0, 1, 0, 0, 1, 1]))]
    t = task(spark.createDataFrame(rows, "id int, a double, b string, y int"), "y", key="id")
    assert prepare.remove_outliers(t, 1).df.count() == 6
    assert prepare.remove_outliers(t, 3).df.count() == 7


def test_outliers_sequential_differs_from_simultaneous(spark):
    rows = [(i, float(i % 7), 0.0 if i else 50.0, i % 2) for i in range(40)]
    rows += [(100, 1000.0, 60.0, 1)]
    t = task(spark.createDataFrame(rows, "id int, a double, b double, y int"), "y", key="id")
    # The first filter removes row 100; only then is row 0 an outlier of the second column.
    assert prepare.remove_outliers(t, 3).df.count() == 39
    assert prepare.remove_outliers(t, 3, sequential=False).df.count() == 39
    assert prepare.remove_outliers(t, 4.5).df.count() == 39
    assert prepare.remove_outliers(t, 4.5, sequential=False).df.count() == 40


def test_split(spark):
    rows = [(i, float(i), int(i < 20)) for i in range(120)]
    t = task(spark.createDataFrame(rows, "id int, a double, y int"), "y", key="id")
    cut = prepare.train_test_split(t, 0.2, 1)
    found = {(r["split"], r["y"]): r["count"] for r in cut.df.groupBy("split", "y").count().collect()}
    assert found == {("train", 0): 80, ("train", 1): 16, ("test", 0): 20, ("test", 1): 4}
    assert cut.train.name.endswith("_train") and cut.test.df.count() == 24
    with pytest.raises(ValueError):
        prepare.train_test_split(cut)
    with pytest.raises(ValueError):
        t.train
    assert prepare.imbalance_ratio(cut) == 5


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(3000).select(F.col("id"), F.col("id").alias("a"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    seen = set()
    for n in (1, 4, 17):
        cut = prepare.train_test_split(task(df.repartition(n), "y", key="id"), 0.25, 3)
        seen.add(tuple(sorted(r["rid"] for r in cut.test.df.collect())))
    assert len(seen) == 1


def test_split_needs_two_rows_per_class(spark):
    rows = [(0, 1.0, 1), (1, 1.0, 0), (2, 1.0, 0)]
    with pytest.raises(ValueError):
        prepare.train_test_split(task(spark.createDataFrame(rows, "id int, a double, y int"), "y", key="id"))


def test_largest_remainder():
    assert prepare.stratified_counts({0: 7, 1: 3}, 0.25) == {0: 5, 1: 2}
    assert sum(prepare.stratified_counts({0: 11, 1: 6}, 0.2).values()) == 17 - 4


def test_custom_split(spark):
    rows = [(i, float(i), i % 2) for i in range(6)]
    t = task(spark.createDataFrame(rows, "id int, a double, y int"), "y", key="id")
    cut = prepare.custom_split(t, t.df.where("rid < 4"), t.df.where("rid >= 4"))
    assert (cut.train.df.count(), cut.test.df.count(), cut.df.count()) == (4, 2, 6)


def test_majority_tie_takes_smaller_label():
    assert prepare.majority_of({"b": 3, "a": 3}) == "a"
    assert prepare.majority_of({0: 1, 1: 2}) == 1


def test_equality_is_by_rows(spark):
    rows = [(1, 1.0, 0), (2, 2.0, 1), (3, 2.0, 1)]
    a = task(spark.createDataFrame(rows, "id int, a double, y int"), "y", key="id")
    b = task(spark.createDataFrame([(9, 2.0, 1), (8, 2.0, 1), (7, 1.0, 0)], "id int, a double, y int"), "y", key="id")
    c = task(spark.createDataFrame([(9, 2.0, 1), (8, 1.0, 0), (7, 1.0, 0)], "id int, a double, y int"), "y", key="id")
    assert prepare.same_rows(a, b) and not prepare.same_rows(a, c)


def test_projection_and_casts(spark):
    df = spark.createDataFrame([(1, 1, "x", 2.0, 0)], "id int, n int, s string, x double, y int")
    t = task(df, "y", key="id")
    assert prepare.drop_categorical(t).features == ("s", "x")
    assert prepare.drop_categorical(t, drop_strings=True).features == ("x",)
    assert dict(prepare.to_double(t).df.dtypes)["n"] == "double"
    assert prepare.head(t, 1).name == "dataset_head"


def test_profile(spark):
    rows = [(1, 0.0, "a", 0), (2, 4.0, "a", 1), (3, None, "b", 1)]
    t = task(spark.createDataFrame(rows, "id int, x double, s string, y int"), "y", key="id")
    seen = {r["column"]: r for r in prepare.profile(t, exact_percentiles=True).collect()}
    assert seen["x"]["n_missing"] == 1 and seen["x"]["mean"] == 2.0 and seen["x"]["n_zero"] == 1
    assert seen["s"]["n_distinct"] == 2 and seen["s"]["top_values"] == "a=2, b=1"
    assert "y" in seen
    assert "n_distinct" not in prepare.profile(t, minimal=True).columns
