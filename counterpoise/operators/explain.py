"""Model-agnostic explanations: partial dependence, accumulated local effects,
permutation importance.

A score is a function ``score(df) -> Column | DataFrame``: an expression over the
feature columns, or a frame with an added ``p1`` column (for example
``FittedModel.score``). The test part is explained.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from counterpoise.functions import columns as C
from counterpoise.functions.draws import draw
from counterpoise.operators import evaluate
from counterpoise.operators.model import FittedModel
from counterpoise.operators.selection import dense_index, sample_rows
from counterpoise.task import RID, Task
from counterpoise.workspace import run_jobs, spread

GRID_STEPS = 100
KERNEL_SPAN = 0.25
CATEGORY_LIMIT = 100_000
VARIABLES_PER_PASS = 8
JOINED_ROWS = 500_000

Score = Callable[[DataFrame], "Column | DataFrame"]

CURVE_SCHEMA = "model string, type string, variable string, grid_idx int, x_num double, x_cat string, y_hat double"
CURVE_COLUMNS = ["model", "type", "variable", "grid_idx", "x_num", "x_cat", "y_hat"]


def scored(rows: DataFrame, score: Score) -> DataFrame:
    result = score(rows)
    return rows.withColumn("p1", result) if isinstance(result, Column) else result


def _split_variables(task: Task, variables: Sequence[str] | None) -> tuple[list[str], list[str]]:
    wanted = list(task.features) if variables is None else [v for v in variables if v in task.features]
    declared = task.categorical
    categorical = set(C.categorical_for_models(task.df, task.features) if declared is None else declared)
    return [v for v in wanted if v not in categorical], [v for v in wanted if v in categorical]


def _limits(rows: DataFrame, numeric: Sequence[str]) -> tuple[int, dict[str, tuple[float, float]]]:
    """Row count, and smallest and largest value per numeric variable: one aggregate."""
    row = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(F.col(v).cast("double")).alias(f"lo_{v}") for v in numeric],
        *[F.max(F.col(v).cast("double")).alias(f"hi_{v}") for v in numeric],
    ).first()
    return row["n"], {v: (row[f"lo_{v}"], row[f"hi_{v}"]) for v in numeric if row[f"lo_{v}"] is not None}


def grid_points(low: float, high: float, steps: int = GRID_STEPS) -> list[float]:
    """``steps + 1`` uniform points from low to high; one point for an empty range."""
    if low == high:
        return [low]
    return [low + i * ((high - low) / steps) for i in range(steps + 1)]


def _categories(rows: DataFrame, variable: str) -> list:
    """Sorted distinct values; their number is checked before they are collected."""
    found = rows.select(variable).where(F.col(variable).isNotNull()).distinct().limit(CATEGORY_LIMIT + 1).collect()
    if len(found) > CATEGORY_LIMIT:
        raise ValueError(f"{variable} has more than {CATEGORY_LIMIT} categories")
    return sorted(r[0] for r in found)


@dataclass(frozen=True)
class _Grid:
    """Grid of one variable: numeric from low in steps, or a list of categories."""

    variable: str
    length: int
    low: float | None = None
    step: float = 0.0
    categories: tuple = ()

    @property
    def numeric(self) -> bool:
        return self.low is not None

    def at(self, position: Column) -> Column:
        if self.numeric:
            return F.lit(self.low) + position * F.lit(self.step)
        return F.get(F.array(*[F.lit(c) for c in self.categories]), position)

    def label(self, position: Column) -> tuple[Column, Column]:
        """(x_num, x_cat) of a grid position."""
        if self.numeric:
            return self.at(position).cast("double"), F.lit(None).cast("string")
        return F.lit(None).cast("double"), self.at(position).cast("string")


def _grids(
    rows: DataFrame, task: Task, variables: Sequence[str] | None, steps: int
) -> tuple[DataFrame, list[_Grid]]:
    """The rows to score, spread if few, and the grids of their variables."""
    numeric, categorical = _split_variables(task, variables)
    n, limits = _limits(rows, numeric)
    grids = []
    for v, (low, high) in limits.items():
        grids.append(_Grid(v, len(grid_points(low, high, steps)), low, (high - low) / steps))
    for v in categorical:
        values = _categories(rows, v)
        if values:
            grids.append(_Grid(v, len(values), categories=tuple(values)))
    if not grids:
        raise ValueError("nothing to explain")
    return spread(rows.select(*task.features), n), grids


def _passes(grids: Sequence[_Grid]) -> list[list[_Grid]]:
    """Grids of equal length share one pass over the rows, a few at a time."""
    by_length: dict[int, list[_Grid]] = {}
    for g in grids:
        by_length.setdefault(g.length, []).append(g)
    return [
        group[i : i + VARIABLES_PER_PASS]
        for group in by_length.values()
        for i in range(0, len(group), VARIABLES_PER_PASS)
    ]


def _swapped_score(rows: DataFrame, score: Score, variable: str, value: Column, out: str) -> DataFrame:
    """Add column ``out``: the score with one variable overwritten; the rows stay as they were."""
    order = [*rows.columns, out]
    swapped = rows.withColumn("_own", F.col(variable)).withColumn(variable, value)
    return (
        scored(swapped, score)
        .withColumn(out, F.col("p1"))
        .drop(variable)
        .withColumnRenamed("_own", variable)
        .select(*order)
    )


def _grid_sums(
    rows: DataFrame, task: Task, grids: Sequence[_Grid], score: Score, sums: Callable[[_Grid, Column], dict]
) -> DataFrame:
    """Long (variable, grid_idx, x_num, x_cat, sums...) of one pass.

    Every row is repeated once per grid position inside the task that scores it;
    only one partial aggregate per position leaves the task.
    """
    position = F.col("grid_idx")
    work = rows.select(
        *task.features, F.explode(F.sequence(F.lit(0), F.lit(grids[0].length - 1))).alias("grid_idx")
    )
    for i, g in enumerate(grids):
        work = _swapped_score(work, score, g.variable, g.at(position), f"_p{i}")
    names, totals = [], []
    for i, g in enumerate(grids):
        made = sums(g, F.col(f"_p{i}"))
        names = list(made)
        totals.extend(c.alias(f"_{n}{i}") for n, c in made.items())
    wide = work.groupBy("grid_idx").agg(*totals)
    cells = []
    for i, g in enumerate(grids):
        x_num, x_cat = g.label(position)
        cells.append(
            F.struct(
                F.lit(g.variable).alias("variable"),
                x_num.alias("x_num"),
                x_cat.alias("x_cat"),
                *[F.col(f"_{n}{i}").alias(n) for n in names],
            )
        )
    return wide.select("grid_idx", F.inline(F.array(*cells)))


def _united(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def partial_dependence(
    task: Task,
    score: Score,
    variables: Sequence[str] | None = None,
    steps: int = GRID_STEPS,
    n: int | None = None,
    seed: int = 0,
    model: str = "model",
) -> DataFrame:
    """Mean score with each variable set to each of its grid points."""
    rows = sample_rows(task.judging_rows, n, seed)
    dealt, all_grids = _grids(rows, task, variables, steps)
    frames = [
        _grid_sums(dealt, task, grids, score, lambda g, p: {"y_hat": F.avg(p)}) for grids in _passes(all_grids)
    ]
    return _as_curves(_united(frames), model, "PDP")


def _as_curves(curves: DataFrame, model: str, kind: str) -> DataFrame:
    return curves.withColumns({"model": F.lit(model), "type": F.lit(kind)}).select(*CURVE_COLUMNS)


def accumulated_effects(
    task: Task,
    score: Score,
    variables: Sequence[str] | None = None,
    steps: int = GRID_STEPS,
    n: int | None = None,
    seed: int = 0,
    model: str = "model",
    span: float = KERNEL_SPAN,
    center: bool = True,
) -> DataFrame:
    """Accumulated kernel-weighted local differences.

    For grid point g every row adds the difference of its scores at g and g-1
    with a Gaussian weight of its distance from g. The sum of differences is
    taken apart into sums over single scores, so each grid copy is scored once
    and rows are never brought together again. Categories are ordered; their
    distance is 0 or 1. ``center`` adds the mean prediction.
    """
    rows = sample_rows(task.judging_rows, n, seed)

    def weight(g: _Grid, position: Column) -> Column:
        if not g.numeric:
            return F.when(F.col(g.variable) == g.at(position), 1.0).otherwise(math.exp(-1 / (span * span) / 2))
        width = span * g.step * (g.length - 1)
        if width == 0:
            return F.lit(1.0)
        apart = (F.col(g.variable).cast("double") - g.at(position)) / F.lit(width)
        return F.exp(-apart * apart / 2)

    def sums(g: _Grid, p: Column) -> dict:
        here, ahead = weight(g, F.col("grid_idx")), weight(g, F.col("grid_idx") + 1)
        return {"weight": F.sum(here), "here": F.sum(here * p), "there": F.sum(ahead * p)}

    dealt, all_grids = _grids(rows, task, variables, steps)
    totals = _united([_grid_sums(dealt, task, grids, score, sums) for grids in _passes(all_grids)])
    order = Window.partitionBy("variable").orderBy("grid_idx")
    local = F.coalesce((F.col("here") - F.lag("there").over(order)) / F.col("weight"), F.lit(0.0))
    curve = totals.withColumn("_local", local).withColumn("y_hat", F.sum("_local").over(order))
    if center:
        mean = scored(rows, score).agg(F.avg("p1").alias("mean")).first()["mean"]
        curve = curve.withColumn("y_hat", F.col("y_hat") + F.lit(mean))
    return _as_curves(curve, model, "ALE")


def permutation_importance(
    task: Task,
    score: Score,
    variables: Sequence[str] | None = None,
    rounds: int = 10,
    loss: str = "1-auc",
    n: int | None = None,
    seed: int = 0,
    model: str = "model",
    majority=None,
) -> DataFrame:
    """(model, variable, dropout_loss): loss after permuting a variable, averaged over rounds.

    Rows are numbered once in the order of a draw. A round's permutation maps the
    numbers one to one (``shuffles``), so it is an equi-join without a sort: both sides
    are dealt into parts of at most about ``JOINED_ROWS`` rows of the numbered side, which
    a task can hash. The join serves all variables, which are then swapped in one at a
    time where the joined row lies.
    """
    task = task if majority is None else replace(task, majority=majority)
    numeric, categorical = _split_variables(task, variables)
    names = numeric + categorical
    rows = sample_rows(task.judging_rows, n, seed)
    rows = _labelled(task, rows).select(RID, "y", *task.features)
    numbered = dense_index(rows, draw(seed, "base", F.col(RID)), out="place").drop(RID)
    partner = F.lit(None).cast("bigint")
    n_rows = numbered.count()
    for number, (multiplier, shift) in enumerate(shuffles(n_rows, rounds, seed)):
        moved = (F.col("place") * F.lit(multiplier) + F.lit(shift)) % F.lit(max(n_rows, 1))
        partner = F.when(F.col("round") == number, moved).otherwise(partner)
    asked = numbered.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("_partner", partner)
    others = numbered.select(F.col("place").alias("_partner"), *[F.col(v).alias(f"_p_{v}") for v in names])
    parts = max(numbered.sparkSession.sparkContext.defaultParallelism, -(-n_rows // JOINED_ROWS))
    joined = asked.repartition(parts, "_partner").join(others.repartition(parts, "_partner").hint("shuffle_hash"), "_partner")
    work = joined.drop("place", "_partner")
    for v in names:
        work = _swapped_score(work, score, v, F.col(f"_p_{v}"), f"_s_{v}")
    cells = F.array(*[F.struct(F.lit(i).alias("_number"), F.col(f"_s_{v}").alias("p1")) for i, v in enumerate(names)])
    swapped = work.select("round", "y", F.inline(cells))
    losses = _loss(swapped, ["_number", "round"], loss)
    variable = F.element_at(F.array(*[F.lit(v) for v in names]), F.col("_number") + 1).alias("variable")
    return losses.groupBy("_number").agg(F.avg("loss").alias("dropout_loss")).select(
        F.lit(model).alias("model"), variable, "dropout_loss"
    )


def shuffles(n: int, rounds: int, seed: int) -> list[tuple[int, int]]:
    """Multiplier and shift of each round: ``i -> (multiplier * i + shift) mod n`` is one to one.

    The multiplier is the first number from a drawn one on that has no factor in
    common with ``n``; it is small enough for products to fit 64 bits up to 10**11 rows.
    """
    def number(tag: str, k: int) -> int:
        return int(hashlib.md5(f"{seed}|{tag}|{k}".encode()).hexdigest()[:15], 16)

    out = []
    for k in range(rounds):
        multiplier = 10_000_000 + number("multiplier", k) % 10_000_000
        while math.gcd(multiplier, max(n, 1)) != 1:
            multiplier += 1
        out.append((multiplier, number("shift", k) % max(n, 1)))
    return out


def _labelled(task: Task, rows: DataFrame) -> DataFrame:
    from counterpoise.operators.model import encode_target
    from counterpoise.operators.prepare import class_counts, majority_of

    majority = task.majority if task.majority is not None else majority_of(class_counts(task, whole=True))
    return encode_target(rows, task.require_label(), majority)


def _loss(predictions: DataFrame, by: Sequence[str], loss: str) -> DataFrame:
    if loss == "1-auc":
        return evaluate.roc_auc(predictions, by).withColumn("loss", 1 - F.col("roc_auc")).drop("roc_auc")
    if loss == "rmse":
        gap = F.col("y") - F.col("p1")
        return predictions.groupBy(*by).agg(F.sqrt(F.avg(gap * gap)).alias("loss"))
    raise ValueError(f"unknown loss {loss}")


def centered(curves: DataFrame) -> DataFrame:
    """Shift every curve to start at 0."""
    order = Window.partitionBy("model", "type", "variable").orderBy("grid_idx")
    return curves.withColumn("y_hat", F.col("y_hat") - F.first("y_hat").over(order))


def with_performance(explanations: DataFrame, metrics: DataFrame, metric: str = "balanced_accuracy") -> DataFrame:
    """Attach each model's performance value."""
    values = metrics.where(F.col("metric") == metric).select("model", F.col("value").alias("performance"))
    return explanations.join(values, "model", "left")


def of_variable(explanations: DataFrame, variables: str | Sequence[str]) -> DataFrame:
    """Rows of one or several variables."""
    names = [variables] if isinstance(variables, str) else list(variables)
    return explanations.where(F.col("variable").isin(names))


EXPLANATIONS = {
    "PDP": partial_dependence,
    "ALE": accumulated_effects,
    "VI": permutation_importance,
}


def explain_all(
    models: Mapping[tuple[str, ...], FittedModel],
    kind: str,
    variables: Sequence[str] | None = None,
    concurrency: int = 4,
    **settings,
) -> DataFrame:
    """Explanations of many models as one long table with a ``path`` column.

    Requested variables are intersected with each model's features; where no model
    has any of them the table is empty. Losses are taken against the label that each
    model was trained to see as the majority.
    """
    explain = EXPLANATIONS[kind]

    def one(path, fitted):
        wanted = None if variables is None else [v for v in variables if v in fitted.features]
        if wanted == []:
            return None
        own = {"majority": fitted.majority, **settings} if kind == "VI" else settings
        frame = explain(fitted.task, fitted.score, wanted, model=fitted.name, **own)
        return frame.withColumn("path", F.lit("/".join(path)))

    parts = [p for p in run_jobs([lambda p=p, m=m: one(p, m) for p, m in models.items()], concurrency) if p is not None]
    if not parts:
        schema = "model string, variable string, dropout_loss double" if kind == "VI" else CURVE_SCHEMA
        return SparkSession.active().createDataFrame([], f"{schema}, path string")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
