"""Operators over task sets: statistics, selection and per-task mapping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from counterpoise.operators import prepare
from counterpoise.task import TaskSet


def stats(tasks: TaskSet) -> DataFrame:
    """(name, ir, nrow, ncol, n_classes, majority) for every member, in one job."""
    if not len(tasks):
        raise ValueError("no tasks")
    out = None
    for i, (_, member) in enumerate(tasks.members):
        row = prepare.label_stats(member).withColumn("position", F.lit(i))
        out = row if out is None else out.unionByName(row)
    return out


def select_tasks(
    table: DataFrame,
    min_ir: float = 1.5,
    min_rows: int = 1000,
    exclude: Sequence[str] = (),
    max_categorical_frac: float | None = 0.75,
) -> DataFrame:
    """Filter a statistics table ``(source, name, ir, nrow, ncol[, ncol_continuous])``.

    Of equal names the first source wins, among the sources whose task passes.
    """
    kept = table.where((F.col("ir") >= min_ir) & (F.col("nrow") >= min_rows))
    if exclude:
        kept = kept.where(~F.col("name").isin(list(exclude)))
    first = Window.partitionBy("name").orderBy("source")
    kept = kept.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") == 1).drop("_rank")
    if max_categorical_frac is not None and "ncol_continuous" in table.columns:
        kept = kept.where(F.col("ncol_continuous") / F.col("ncol") >= 1 - max_categorical_frac)
    return kept


def _members_where(tasks: TaskSet, keep) -> TaskSet:
    rows = {r["position"]: r for r in stats(tasks).collect()} if len(tasks) else {}
    return TaskSet(tuple(m for i, m in enumerate(tasks.members) if keep(rows[i])), tasks.name)


def without_non_binary(tasks: TaskSet) -> TaskSet:
    """Drop members with more than two label values."""
    return _members_where(tasks, lambda r: r["n_classes"] <= 2)


def without_empty(tasks: TaskSet) -> TaskSet:
    """Drop members without rows."""
    return _members_where(tasks, lambda r: r["nrow"] > 0)


def train_test_split(tasks: TaskSet, test_size: float = 0.2, seed: int = 0) -> TaskSet:
    return tasks.map(lambda t: prepare.train_test_split(t, test_size, seed))


def remove_missing(tasks: TaskSet, col_thresh: float = 0.9) -> TaskSet:
    """Remove missing values everywhere, then members that became empty."""
    return without_empty(tasks.map(lambda t: prepare.remove_missing(t, col_thresh)))


def remove_outliers(tasks: TaskSet, n_std: float = 3) -> TaskSet:
    return tasks.map(lambda t: prepare.remove_outliers(t, n_std))


def drop_categorical(tasks: TaskSet) -> TaskSet:
    return tasks.map(prepare.drop_categorical)


def head(tasks: TaskSet, n: int = 10) -> TaskSet:
    return tasks.map(lambda t: prepare.head(t, n))


def same_tasks(a: TaskSet, b: TaskSet) -> bool:
    """Equal members by path, in any order."""
    left, right = dict(a.members), dict(b.members)
    return set(left) == set(right) and all(prepare.same_rows(left[p], right[p]) for p in left)


