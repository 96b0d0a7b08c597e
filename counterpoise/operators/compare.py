"""Distances, tests and summaries over explanation tables.

Inputs are the long result tables. Curves and importances of one data set carry
the same ``dataset``; the base of each data set is a model name or the rows with
``is_base``. Every comparison is an equi-join with the base rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from counterpoise.operators.selection import value_buckets
from counterpoise.workspace import ship_package

EXACT_UP_TO = 25
_FIRST = Window.unboundedPreceding


def mark_base(results: DataFrame, base: str | None = None, position: str = "position") -> DataFrame:
    """Add ``is_base``: the named model, or each data set's last one by ``position``."""
    if base is not None:
        return results.withColumn("is_base", F.col("model") == base)
    latest = results.groupBy("dataset").agg(F.max(position).alias("_last"))
    return results.join(latest, "dataset").withColumn("is_base", F.col(position) == F.col("_last")).drop("_last")


def filter_models(results: DataFrame, pattern: str, keep_base: bool = True) -> DataFrame:
    """Models whose name matches a regular expression (anywhere in the name)."""
    hit = F.col("model").rlike(pattern)
    return results.where(hit | F.col("is_base")) if keep_base else results.where(hit)


def with_all_variables(results: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Models that have every requested variable (relational division)."""
    wanted = sorted(set(variables))
    complete = (
        results.where(F.col("variable").isin(wanted))
        .groupBy("dataset", "model")
        .agg(F.count_distinct("variable").alias("_n"))
        .where(F.col("_n") == len(wanted))
        .select("dataset", "model")
    )
    return results.join(complete, ["dataset", "model"], "left_semi")


def same_variables(results: DataFrame) -> bool:
    """Do all models of the table have the same variables?"""
    sets = results.groupBy("dataset", "model").agg(F.array_sort(F.collect_set("variable")).alias("_v"))
    return len(sets.select("_v").distinct().limit(2).collect()) <= 1


def require_variables(results: DataFrame, variables: Sequence[str] | None) -> DataFrame:
    """Restrict to named variables; an unknown name, or differing models without names, is an error."""
    if variables is None:
        if not same_variables(results):
            raise ValueError("models have different variables; name the ones to compare")
        return results
    names = [variables] if isinstance(variables, str) else list(variables)
    known = {
        r["variable"] for r in results.where(F.col("is_base") & F.col("variable").isin(names)).select("variable").distinct().collect()
    }
    missing = [v for v in names if v not in known]
    if missing:
        raise ValueError(f"variables not available: {missing}")
    return with_all_variables(results.where(F.col("variable").isin(names)), names)


def _beside_base(results: DataFrame, place: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Non-base rows with struct ``_base``: the base row's values at the same place.

    One window over the rows of a place (one per model) replaces a self-join, so
    the results are computed once.
    """
    base = F.max(F.when(F.col("is_base"), F.struct(*values))).over(Window.partitionBy(*place))
    return results.withColumn("_base", base).where(~F.col("is_base") & F.col("_base").isNotNull())


# ---------------------------------------------------------------- curves


def curve_distance(curves: DataFrame) -> DataFrame:
    """Standard deviation of distances (SDD) per (dataset, model, variable).

    Curves are aligned with the base by grid position; ``grid_mismatch`` tells
    how many positions have different x values.
    """
    place = ["dataset", "variable", "grid_idx"]
    same_x = F.col("x_num").eqNullSafe(F.col("_base.x_num")) & F.col("x_cat").eqNullSafe(F.col("_base.x_cat"))
    return (
        _beside_base(curves, place, ["y_hat", "x_num", "x_cat"])
        .groupBy("dataset", "model", "variable")
        .agg(
            F.stddev_pop(F.col("y_hat") - F.col("_base.y_hat")).alias("sdd"),
            F.sum((~same_x).cast("int")).alias("grid_mismatch"),
        )
    )


def averaged_distance(distances: DataFrame, by: Sequence[str] = ("dataset", "model")) -> DataFrame:
    """Mean SDD (ASDD): over variables per model, over models per variable, or both."""
    return distances.groupBy(*by).agg(F.avg("sdd").alias("asdd"))


# ---------------------------------------------------------------- performance


def performance_change(metrics: DataFrame, percent: bool = False) -> DataFrame:
    """(dataset, model, metric, change) against the base of the data set."""
    change = F.col("value") - F.col("_base.value")
    if percent:
        change = change / F.nullif(F.col("_base.value"), F.lit(0.0))
    return _beside_base(metrics, ["dataset", "metric"], ["value"]).select(
        "dataset", "model", "metric", change.alias("change")
    )


def gain_points(distances: DataFrame, changes: DataFrame, filters: Mapping[str, str] | None = None) -> DataFrame:
    """(filter, dataset, model, change, asdd): performance change against curve distance."""
    points = averaged_distance(distances).join(changes, ["dataset", "model"])
    return by_filter(points, filters)


# ---------------------------------------------------------------- filters


def by_filter(results: DataFrame, filters: Mapping[str, str] | None, labels: Sequence[str] | None = None) -> DataFrame:
    """One copy of each row per name filter it matches; ``filters`` maps label to pattern."""
    if labels is not None:
        patterns = list(filters.values()) if isinstance(filters, Mapping) else list(filters or [])
        if len(labels) != len(patterns):
            raise ValueError("one label per filter is needed")
        filters = dict(zip(labels, patterns))
    if filters is None:
        return results.withColumn("filter", F.lit("All values"))
    tests = F.array(*[F.when(F.col("model").rlike(p), F.lit(name)) for name, p in filters.items()])
    return results.withColumn("filter", F.explode(F.array_compact(tests)))


def box_summary(
    values: DataFrame, value: str, by: Sequence[str] = ("filter",), whisker: float = 1.5
) -> DataFrame:
    """Count, extremes, quartiles, mean and whisker ends per group: the data of a box plot."""
    by = list(by)
    quartiles = values.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.min(value).alias("min"),
        F.percentile(value, F.lit(0.25)).alias("q1"),
        F.percentile(value, F.lit(0.5)).alias("median"),
        F.percentile(value, F.lit(0.75)).alias("q3"),
        F.max(value).alias("max"),
        F.avg(value).alias("mean"),
    )
    reach = whisker * (F.col("q3") - F.col("q1"))
    limits = quartiles.select(
        *by, (F.col("q1") - reach).alias("_lo"), (F.col("q3") + reach).alias("_hi")
    )
    ends = (
        values.join(limits, by)
        .where((F.col(value) >= F.col("_lo")) & (F.col(value) <= F.col("_hi")))
        .groupBy(*by)
        .agg(F.min(value).alias("whisker_low"), F.max(value).alias("whisker_high"))
    )
    return quartiles.join(ends, by, "left")


# ---------------------------------------------------------------- importances


def top_variables(importance: DataFrame, max_variables: int) -> DataFrame:
    """The base's variables with the smallest values, in ascending order, per data set."""
    order = Window.partitionBy("dataset").orderBy("dropout_loss", "variable")
    return (
        importance.where("is_base")
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= max_variables)
        .select("dataset", "variable", "position")
    )


def wilcoxon(importance: DataFrame, max_variables: int | None = None, exact_up_to: int = EXACT_UP_TO) -> DataFrame:
    """Signed-rank test of every model's importances against its base.

    Returns per (dataset, model): n, w_plus, w_minus, tie_term, statistic, ties,
    status and the two-sided p_value. Zero differences are dropped.
    """
    ship_package(importance.sparkSession)
    statistics = wilcoxon_statistics(importance, max_variables)
    return statistics.withColumn(
        "p_value", _p_values(exact_up_to)("n", "statistic", "tie_term", "n_zero")
    )


def wilcoxon_statistics(importance: DataFrame, max_variables: int | None = None) -> DataFrame:
    """The rank sums behind ``wilcoxon``."""
    if max_variables is not None:
        importance = importance.join(
            top_variables(importance, max_variables), ["dataset", "variable"], "left_semi"
        )
    gap = F.col("_base.dropout_loss") - F.col("dropout_loss")
    pairs = (
        _beside_base(importance, ["dataset", "variable"], ["dropout_loss"])
        .select("dataset", "model", "variable", gap.alias("_d"))
        .withColumn("_size", F.abs("_d"))
    )
    # Zero differences get ranks of their own and are counted apart.
    pair = ["dataset", "model", F.col("_size") == 0]
    ranked = (
        pairs.withColumn("_first", F.rank().over(Window.partitionBy(*pair).orderBy("_size")))
        .withColumn("_ties", F.count(F.lit(1)).over(Window.partitionBy(*pair, "_size")))
        .withColumn("_rank", F.col("_first") + (F.col("_ties") - 1) / 2)
    )

    def total(test, value):
        return F.sum(F.when(test, value).otherwise(F.lit(0.0)))

    differs = F.col("_d") != 0
    sums = ranked.groupBy("dataset", "model").agg(
        F.sum(differs.cast("bigint")).alias("n"),
        F.sum((~differs).cast("bigint")).alias("n_zero"),
        total(F.col("_d") > 0, F.col("_rank")).alias("w_plus"),
        total(F.col("_d") < 0, F.col("_rank")).alias("w_minus"),
        total(differs, (F.col("_ties") * F.col("_ties") - 1).cast("double")).alias("tie_term"),
    )
    return sums.select(
        "dataset",
        "model",
        "n",
        "n_zero",
        "w_plus",
        "w_minus",
        F.least("w_plus", "w_minus").alias("statistic"),
        "tie_term",
        (F.col("tie_term") > 0).alias("ties"),
        F.when(F.col("n") == 0, "all differences are zero").otherwise("ok").alias("status"),
    )


@lru_cache(maxsize=None)
def _null_counts(n: int) -> np.ndarray:
    """How many sign patterns of ranks 1..n give each rank sum."""
    counts = np.ones(1)
    for rank in range(1, n + 1):
        shifted = np.zeros(len(counts) + rank)
        shifted[: len(counts)] += counts
        shifted[rank:] += counts
        counts = shifted
    return counts


def signed_rank_p(n: int, statistic: float, tie_term: float, n_zero: int, exact_up_to: int = EXACT_UP_TO) -> float:
    """Two-sided p-value: exact null distribution for small samples, else normal approximation."""
    if n == 0:
        return float("nan")
    if n <= exact_up_to and n_zero == 0:
        counts = _null_counts(n)
        return float(min(1.0, 2 * counts[: math.floor(statistic) + 1].sum() / 2.0**n))
    mean = n * (n + 1) / 4
    variance = n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48
    if variance <= 0:
        return float("nan")
    return math.erfc(abs(statistic - mean) / math.sqrt(variance) / math.sqrt(2))


def _p_values(exact_up_to: int):
    @F.pandas_udf("double")
    def p_value(n: pd.Series, statistic: pd.Series, tie_term: pd.Series, n_zero: pd.Series) -> pd.Series:
        values = [
            signed_rank_p(int(a), b, c, int(d), exact_up_to) for a, b, c, d in zip(n, statistic, tie_term, n_zero)
        ]
        return pd.Series([None if math.isnan(v) else v for v in values], dtype="float64")

    return p_value


def mean_p_value(tests: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    return tests.groupBy(*by).agg(F.avg("p_value").alias("p_value"))


def adjust_fdr(tests: DataFrame, experiment: Sequence[str] = (), p: str = "p_value") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values, over all rows of each experiment together.

    Equal p-values are counted first. Ranks (running counts) and the running
    minimum from the largest value are taken inside buckets of distinct values
    and then over the few bucket totals.
    """
    keys = list(experiment)
    distinct = (
        tests.where(F.col(p).isNotNull()).groupBy(*keys, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    )
    placed = value_buckets(distinct, keys, "_p")
    sizes = placed.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_size"))
    group = Window.partitionBy(*keys if keys else [F.lit(0)])
    before = F.coalesce(F.sum("_size").over(group.orderBy("_bucket").rowsBetween(_FIRST, -1)), F.lit(0))
    offsets = sizes.select(*keys, "_bucket", before.alias("_before"), F.sum("_size").over(group).alias("_m"))
    bucket = Window.partitionBy(*keys, "_bucket")
    rank = F.col("_before") + F.sum("_n").over(bucket.orderBy("_p").rowsBetween(_FIRST, 0))
    raw = placed.join(offsets, [*keys, "_bucket"]).withColumn("_raw", F.col("_p") * F.col("_m") / rank)
    lowest = raw.groupBy(*keys, "_bucket").agg(F.min("_raw").alias("_low"))
    later = lowest.select(
        *keys, "_bucket", F.min("_low").over(group.orderBy(F.desc("_bucket")).rowsBetween(_FIRST, -1)).alias("_later")
    )
    running = F.min("_raw").over(bucket.orderBy(F.desc("_p")).rowsBetween(_FIRST, 0))
    adjusted = (
        raw.join(later, [*keys, "_bucket"])
        .withColumn("p_adjusted", F.least(F.lit(1.0), running, F.coalesce("_later", F.lit(1.0))))
        .select(*keys, "_p", "p_adjusted")
    )
    same = F.col("_p") == F.col(f"t.{p}")
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"t.{k}"))
    return tests.alias("t").join(adjusted.alias("a"), same, "left").select("t.*", "a.p_adjusted")


def decision_shares(
    tests: DataFrame, level: float = 0.05, by: Sequence[str] = ("filter",), p: str = "p_adjusted"
) -> DataFrame:
    """Accepted and rejected fractions per group (rejected: p <= level)."""
    rejected = F.avg((F.col(p) <= level).cast("int"))
    return tests.groupBy(*by).agg(
        F.count(p).alias("n"), (1 - rejected).alias("accepted"), rejected.alias("rejected")
    )


def p_value_summary(
    tests: DataFrame,
    filters: Mapping[str, str] | None = None,
    level: float | None = None,
    fdr: bool = True,
    experiment: Sequence[str] = (),
) -> DataFrame:
    """Per filter: the distribution of p-values, or the decisions at a level.

    The false-discovery correction runs over the values of all filters together.
    """
    filtered = by_filter(tests, filters)
    by = [*experiment, "filter"]
    if level is None:
        return box_summary(filtered, "p_value", by)
    if not fdr:
        return decision_shares(filtered, level, by, "p_value")
    return decision_shares(adjust_fdr(filtered, experiment), level, by)


def sorted_by_name(results: DataFrame, name: str = "model") -> DataFrame:
    """Order by name, ignoring case."""
    return results.orderBy(F.lower(F.col(name)), F.col(name))


