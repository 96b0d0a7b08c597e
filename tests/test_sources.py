import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpoise.operators import collection, prepare
from counterpoise.sources.tables import from_csv, from_directory, from_npy, task
from counterpoise.task import TaskSet


def small(spark, labels=(0, 0, 1), name="t"):
    rows = [(i, float(i + 1), "abc"[i % 3], y) for i, y in enumerate(labels)]
    return task(spark.createDataFrame(rows, "id int, a double, b string, y int"), "y", key="id", name=name)


def test_default_features_and_ratio(spark):
    t = small(spark)
    assert t.features == ("a", "b")
    assert prepare.imbalance_ratio(t) == 2
    assert prepare.is_binary(t)


def test_more_than_two_labels(spark):
    t = small(spark, (2, 0, 1))
    assert not prepare.is_binary(t)
    with pytest.raises(ValueError):
        prepare.imbalance_ratio(t)


def test_one_class_and_no_label(spark):
    assert prepare.imbalance_ratio(small(spark, (1, 1, 1))) == 0
    unlabelled = task(spark.createDataFrame([(1, 2.0)], "id int, a double"), None, key="id")
    assert prepare.imbalance_ratio(unlabelled) == 0
    assert not prepare.is_binary(unlabelled)


def test_row_ids_without_key_are_unique_and_stable(spark):
    rows = spark.createDataFrame([(1.0, "x")] * 500 + [(float(i), "y") for i in range(50)], "a double, b string")
    ids = [r["rid"] for r in task(rows, "b").df.collect()]
    assert len(set(ids)) == 550
    again = [r["rid"] for r in task(rows.repartition(17), "b").df.collect()]
    assert sorted(ids) == sorted(again)


def test_csv_label_defaults_to_last_column(spark, tmp_path):
    file = tmp_path / "data_1.csv"
    file.write_text("col1,col2,target\n1,2,0\n3,4,1\n5,6,0\n7,8,1\n")
    t = from_csv(spark, str(file))
    assert t.features == ("col1", "col2") and t.label == "target"
    assert prepare.imbalance_ratio(t) == 1
    (tmp_path / "first.csv").write_text("y,a,b\n0,1,2\n1,3,4\n")
    assert from_csv(spark, str(tmp_path / "first.csv"), target="y").features == ("a", "b")
    with pytest.raises(ValueError):
        from_csv(spark, str(file), target="nothing")


def test_directory(spark, tmp_path):
    (tmp_path / "one.csv").write_text("a,y\n1,0\n2,1\n")
    (tmp_path / "two.csv").write_text("p,q,z\n1,2,0\n2,3,1\n3,4,1\n")
    (tmp_path / "notes.txt").write_text("ignored")
    np.save(tmp_path / "three.npy", np.array([[1.0, 2.0, 0.0], [3.0, 4.0, 1.0]]))
    tasks = from_directory(spark, str(tmp_path))
    assert [t.name for t in tasks.tasks] == ["one", "three", "two"]
    assert prepare.imbalance_ratio(tasks["two"]) == 2
    assert tasks["three"].df.count() == 2 and tasks["three"].features == ("c0", "c1")
    with pytest.raises(FileNotFoundError):
        from_directory(spark, str(tmp_path / "missing"))
    with pytest.raises(NotADirectoryError):
        from_directory(spark, str(tmp_path / "one.csv"))


def test_pickled_arrays_are_refused(spark, tmp_path):
    np.save(tmp_path / "bad.npy", np.array([{"a": 1}], dtype=object), allow_pickle=True)
    with pytest.raises(Exception):
        from_npy(spark, str(tmp_path / "bad.npy")).df.count()


def test_task_sets(spark):
    a, b = small(spark, name="a"), small(spark, name="b")
    tasks = TaskSet.of([a, b])
    assert len(tasks.subset("a")) == 1 and len(tasks.subset(["a", "none"])) == 1 and len(tasks.subset("none")) == 0
    with pytest.raises(ValueError):
        tasks.append(small(spark, name="a"))
    with pytest.raises(ValueError):
        tasks.union(TaskSet.of([a]))
    nested = tasks.nested("left").union(tasks.nested("right"))
    assert [p for p, _ in nested.members][0] == ("left", "a") and len(nested) == 4
    assert nested.long().select("dataset").distinct().count() == 4


def test_non_binary_and_empty_members_are_removed(spark):
    empty = small(spark, name="empty")
    empty = empty.with_df(empty.df.where(F.lit(False)))
    tasks = TaskSet.of([small(spark, name="ok"), small(spark, (1, 2, 3), "many"), empty])
    assert [t.name for t in collection.without_non_binary(tasks).tasks] == ["ok", "empty"]
    assert [t.name for t in collection.without_empty(tasks).tasks] == ["ok", "many"]


def test_task_set_equality_ignores_order(spark):
    a, b = small(spark, name="a"), small(spark, (0, 1, 1), "b")
    assert collection.same_tasks(TaskSet.of([a, b]), TaskSet.of([b, a]))
    assert not collection.same_tasks(TaskSet.of([a]), TaskSet.of([a, b]))
