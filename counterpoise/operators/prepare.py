"""Cleaning, splitting and describing tasks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.functions import columns as C
from counterpoise.functions.draws import draw, with_draw
from counterpoise.operators.selection import DRAW_BOUNDS, exact_cuts, up_to
from counterpoise.task import RID, SPLIT, TEST, TRAIN, Task


def class_counts(task: Task, whole: bool = False) -> dict:
    """Rows per label of the train part (or of everything): one small aggregate."""
    label = task.require_label()
    rows = task.df if whole else task.fitting_rows
    counted = rows.where(F.col(label).isNotNull()).groupBy(label).count().limit(3).collect()
    if len(counted) > 2:
        raise ValueError("target has too many classes for binary classification")
    return {r[label]: r["count"] for r in counted}


def is_binary(task: Task) -> bool:
    """A label with at most two distinct values."""
    if task.label is None:
        return False
    return len(task.df.select(task.label).where(F.col(task.label).isNotNull()).distinct().limit(3).collect()) <= 2


def imbalance_ratio(task: Task) -> float:
    """Majority rows per minority row in the train part; 0 for no label or one class."""
    if task.label is None:
        return 0.0
    counts = class_counts(task)
    return 0.0 if len(counts) < 2 else max(counts.values()) / min(counts.values())


def majority_of(counts: dict):
    """Label with the higher count; the smaller label wins a tie."""
    return min(counts, key=lambda label: (-counts[label], label))


def with_majority(task: Task) -> Task:
    """Fix the majority label, from all rows, before anything is rebalanced."""
    if task.majority is not None:
        return task
    return task.with_df(task.df, majority=majority_of(class_counts(task, whole=True)))


def label_stats(task: Task) -> DataFrame:
    """One lazy row: name, ir, nrow, ncol, n_classes and majority label (as text)."""
    label = task.require_label()
    part = F.col(SPLIT) == TRAIN if task.was_split else F.lit(True)
    per_class = (
        task.df.where(F.col(label).isNotNull())
        .groupBy(F.col(label).alias("_label"))
        .agg(F.count(F.lit(1)).alias("_all"), F.sum(part.cast("bigint")).alias("_fit"))
    )
    ratio = F.max("_fit") / F.min("_fit")
    smallest_of_largest = F.min_by(F.col("_label"), F.struct(-F.col("_all"), F.col("_label")))
    return per_class.agg(
        F.lit(task.name).alias("name"),
        F.when(F.count(F.lit(1)) == 2, ratio).when(F.count(F.lit(1)) < 2, F.lit(0.0)).alias("ir"),
        F.coalesce(F.sum("_all"), F.lit(0)).alias("nrow"),
        F.lit(len(task.features)).alias("ncol"),
        F.count(F.lit(1)).alias("n_classes"),
        smallest_of_largest.cast("string").alias("majority"),
    )


def train_test_split(task: Task, test_size: float = 0.2, seed: int = 0) -> Task:
    """Stratified split with exact counts; adds the ``split`` column.

    Each class gives its rows with the smallest draws to the train part. The
    per-class train counts come from the largest-remainder rule. Rows without a
    label are in neither part.
    """
    if task.was_split:
        raise ValueError("the task has already been split")
    label = task.require_label()
    order = draw(seed, "split", F.col(RID))
    train_rows: dict = {}

    def wanted(counts):
        train_rows.update(stratified_counts(counts, test_size))
        return {g: [n] for g, n in train_rows.items()}

    _, cuts = exact_cuts(task.df.where(F.col(label).isNotNull()), label, [order], wanted, bounds=DRAW_BOUNDS)
    chosen = F.lit(False)
    for (group, _), cut in cuts.items():
        chosen = chosen | ((F.col(label) == F.lit(group)) & up_to(cut, [F.col("_h")]))
    drawn = with_draw(task.df, "_h", order)
    return task.with_df(drawn.withColumn(SPLIT, F.when(F.col(label).isNull(), F.lit(None)).when(chosen, TRAIN).otherwise(TEST)).drop("_h"))


def stratified_counts(counts: dict, test_size: float) -> dict:
    """Train rows per class: proportional shares, largest remainders first."""
    if not counts or min(counts.values()) < 2:
        raise ValueError("every class needs at least two rows to be split")
    total = sum(counts.values())
    n_train = total - math.ceil(test_size * total)
    exact = {g: n_train * c / total for g, c in counts.items()}
    shares = {g: math.floor(x) for g, x in exact.items()}
    by_remainder = sorted(counts, key=lambda g: (-(exact[g] - shares[g]), g))
    for g in by_remainder[: n_train - sum(shares.values())]:
        shares[g] += 1
    return shares


def custom_split(task: Task, train: DataFrame, test: DataFrame) -> Task:
    """Two given frames become the train and the test part."""
    both = train.withColumn(SPLIT, F.lit(TRAIN)).unionByName(test.withColumn(SPLIT, F.lit(TEST)))
    return task.with_df(both)


def split_by(task: Task, is_train: Column) -> Task:
    """Split by a predicate over the task's columns."""
    return task.with_df(task.df.withColumn(SPLIT, F.when(is_train, TRAIN).otherwise(TEST)))


def remove_missing(task: Task, col_thresh: float = 0.9) -> Task:
    """Drop features that are mostly missing, then rows with anything missing."""
    shares = task.df.agg(
        *[F.avg(C.is_missing(task.df, c).cast("double")).alias(c) for c in task.features]
    ).first()
    kept = tuple(c for c in task.features if shares[c] is None or shares[c] <= col_thresh)
    out = task.df.drop(*[c for c in task.features if c not in kept])
    present = F.lit(True)
    for c in kept + ((task.label,) if task.label else ()):
        present = present & ~C.is_missing(task.df, c)
    return task.with_df(out.where(present), features=kept)


def remove_outliers(task: Task, n_std: float = 3, sequential: bool = True) -> Task:
    """Keep mean - n*std <= x <= mean + n*std for each continuous feature, in order.

    Sequentially, each column's statistics are taken after the filters of the
    columns before it: one aggregate per column. The filters are constants, so
    the final plan is a single scan with pushed-down range predicates.
    """
    names = C.continuous(task.df, [c for c in task.features if c not in (task.categorical or ())])
    out = task.df
    if not names:
        return task

    def limits(df, columns):
        row = df.agg(
            *[F.avg(_number(df, c)).alias(f"m_{c}") for c in columns],
            *[F.stddev_samp(_number(df, c)).alias(f"s_{c}") for c in columns],
        ).first()
        return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns}

    together = None if sequential else limits(out, names)
    for c in names:
        mean, std = together[c] if together else limits(out, [c])[c]
        if mean is None or std is None or math.isnan(std):
            out = out.where(F.lit(False))
            continue
        out = out.where(F.col(c).between(mean - n_std * std, mean + n_std * std))
    return task.with_df(out)


def _number(df: DataFrame, name: str) -> Column:
    """The column as double, with NaN read as missing."""
    value = F.col(name).cast("double")
    return F.when(C.is_missing(df, name), None).otherwise(value)


def drop_categorical(task: Task, drop_strings: bool = False) -> Task:
    """Drop integer and declared categorical features (and strings on request)."""

    def dropped(c):
        kind = C.type_of(task.df, c)
        return (
            c in (task.categorical or ())
            or isinstance(kind, C.INTEGER_TYPES)
            or (drop_strings and isinstance(kind, C.TEXT_TYPES))
        )

    return keep_features(task, [c for c in task.features if not dropped(c)])


def keep_features(task: Task, names: Sequence[str]) -> Task:
    """Project to the named features."""
    names = tuple(names)
    return task.with_df(task.df.drop(*[c for c in task.features if c not in names]), features=names)


def drop_prefixed(task: Task, prefix: str, keep: Sequence[str] = ()) -> Task:
    """Drop features whose name starts with ``prefix``, except those in ``keep``."""
    return keep_features(task, [c for c in task.features if c in keep or not c.startswith(prefix)])


def head(task: Task, n: int = 10) -> Task:
    """First ``n`` rows by row id."""
    return task.with_df(task.df.orderBy(RID).limit(n), name=f"{task.name}_head")


def to_double(task: Task, names: Sequence[str] | None = None) -> Task:
    """Cast the named (default: all integer) features to double."""
    if names is None:
        names = [c for c in task.features if isinstance(C.type_of(task.df, c), C.INTEGER_TYPES)]
    return task.with_df(task.df.withColumns({c: F.col(c).cast("double") for c in names}))


def row_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose multiplicity differs between two frames with equal columns."""
    signed = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1)))
    return signed.groupBy(*a.columns).agg(F.sum("_n").alias("surplus")).where(F.col("surplus") != 0)


def same_rows(a: Task, b: Task) -> bool:
    """Same name, features and multiset of rows (row ids aside)."""
    if (a.name, a.features, a.label) != (b.name, b.features, b.label):
        return False
    columns = [*a.features, *([a.label] if a.label else [])]
    if [C.type_of(a.df, c) for c in columns] != [C.type_of(b.df, c) for c in columns]:
        return False
    return row_differences(a.df.select(*columns), b.df.select(*columns)).isEmpty()


def profile(
    task: Task, minimal: bool = False, exact_percentiles: bool = False, top: int = 3, accuracy: int = 10_000
) -> DataFrame:
    """One row per column: counts, missing, distinct, moments, quartiles, top values.

    All columns are turned into one long (column, number, text) relation that is
    aggregated once; the partial aggregates keep the shuffle small.
    """
    names = list(task.features) + ([task.label] if task.label else [])
    if not names:
        raise ValueError("nothing to profile")
    rows = task.df
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                (_number(rows, c) if _is_number(rows, c) else F.lit(None).cast("double")).alias("number"),
                F.when(~C.is_missing(rows, c), F.col(c).cast("string")).alias("text"),
            )
            for c in names
        ]
    )
    long = rows.select(F.inline(cells))
    middle = (
        [F.percentile("number", F.lit(q)).alias(n) for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
        if exact_percentiles
        else [
            F.percentile_approx("number", q, accuracy).alias(n)
            for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))
        ]
    )
    basic = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("text").isNull().cast("bigint")).alias("n_missing"),
        F.avg("number").alias("mean"),
        F.stddev_samp("number").alias("std"),
        F.min("number").alias("min"),
        F.max("number").alias("max"),
        F.sum((F.col("number") == 0).cast("bigint")).alias("n_zero"),
        *middle,
    )
    if minimal:
        return basic
    from pyspark.sql import Window

    values = long.where(F.col("text").isNotNull()).groupBy("column", "text").agg(F.count(F.lit(1)).alias("_n"))
    distinct = values.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    order = Window.partitionBy("column").orderBy(F.desc("_n"), "text")
    best = (
        values.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= top)
        .groupBy("column")
        .agg(F.sort_array(F.collect_list(F.struct("_rank", "text", "_n"))).alias("_top"))
        .select(
            "column",
            F.array_join(
                F.transform("_top", lambda t: F.concat_ws("=", t["text"], t["_n"].cast("string"))), ", "
            ).alias("top_values"),
        )
    )
    return basic.join(distinct, "column", "left").join(best, "column", "left")


def correlations(task: Task) -> DataFrame:
    """Pearson correlation of every pair of numeric features: one aggregate, one row per pair."""
    names = [c for c in task.features if _is_number(task.df, c)]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    if not pairs:
        raise ValueError("needs two numeric features")
    wide = task.df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs]
    )
    return wide.select(F.inline(cells))


def _is_number(df: DataFrame, name: str) -> bool:
    return isinstance(C.type_of(df, name), C.INTEGER_TYPES + C.CONTINUOUS_TYPES) and not isinstance(
        C.type_of(df, name), T.BooleanType
    )
