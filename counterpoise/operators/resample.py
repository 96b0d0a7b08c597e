"""Rebalancing the train part: random, neighbour-based and synthetic sampling.

Every operator takes the train rows once and answers for all requested ratios,
as one long table ``(variant, rid, features..., label, origin)``. The test part
never enters. Ratios are majority/minority after sampling; ``alpha = 1/ratio``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.functions import columns as C
from counterpoise.functions.draws import draw, uniform, with_draw
from counterpoise.operators.knn import nearest, tomek_links, vector_of
from counterpoise.operators.prepare import class_counts, majority_of
from counterpoise.operators.selection import DRAW_BOUNDS, dense_index, exact_cuts, up_to
from counterpoise.task import RID, Task
from counterpoise.workspace import materialize, salted_join

ORIGINAL, COPY, SYNTHETIC = "original", "copy", "synthetic"
ROWS_PER_SLICE = 2_000_000


class BalancingError(ValueError):
    """The task or ratio cannot be served by this method."""


@dataclass(frozen=True)
class Classes:
    """Label values and train counts that every method starts from."""

    majority: Any
    minority: Any
    n_majority: int
    n_minority: int

    @property
    def ratio(self) -> float:
        return self.n_majority / self.n_minority


def classes_of(task: Task) -> Classes:
    counts = class_counts(task)
    if len(counts) != 2:
        raise BalancingError(f"task {task.name} needs two classes in its train part")
    biggest = majority_of(counts)
    smallest = next(g for g in counts if g != biggest)
    return Classes(biggest, smallest, counts[biggest], counts[smallest])


def kept_majority(n_minority: int, ratio: float) -> int:
    """Majority rows left by undersampling."""
    return math.floor(n_minority / (1 / ratio))


def added_minority(n_majority: int, n_minority: int, ratio: float) -> int:
    """Minority rows added by oversampling."""
    return math.floor(1 / ratio * n_majority) - n_minority


Ratios = Mapping[str, float]


def _ratios(ratios: Ratios | float) -> dict[str, float]:
    return dict(ratios) if isinstance(ratios, Mapping) else {"balanced": float(ratios)}


def _columns(task: Task) -> list[str]:
    return [*task.features, task.require_label()]


def _variants_of(sizes: Mapping[str, int], test: Callable[[int], Column]) -> Column:
    """One output row per variant the row belongs to; the scan is shared.

    Variants are nested: a row that passes for some size passes for every larger
    one, so the number of passed tests picks a prefix of the size-ordered names.
    """
    names = sorted(sizes, key=lambda v: -sizes[v])
    passed = F.lit(0)
    for v in names:
        passed = passed + test(sizes[v]).cast("int")
    return F.explode(F.slice(F.array(*[F.lit(v) for v in names]), F.lit(1), passed))


def _every(names: Sequence[str]) -> Column:
    return F.explode(F.array(*[F.lit(v) for v in names]))


def _originals(rows: DataFrame, task: Task, variants: Column) -> DataFrame:
    return rows.select(
        variants.alias("variant"),
        F.col(RID).cast("string").alias(RID),
        *_columns(task),
        F.lit(ORIGINAL).alias("origin"),
    )


def _checked_under(classes: Classes, ratios: Mapping[str, float]) -> dict[str, int]:
    kept = {v: kept_majority(classes.n_minority, r) for v, r in ratios.items()}
    for v, n in kept.items():
        if n > classes.n_majority:
            raise BalancingError(f"{v}: undersampling cannot raise the ratio to {ratios[v]}")
    return kept


def _checked_over(classes: Classes, ratios: Mapping[str, float]) -> dict[str, int]:
    added = {v: added_minority(classes.n_majority, classes.n_minority, r) for v, r in ratios.items()}
    for v, n in added.items():
        if n < 0:
            raise BalancingError(f"{v}: oversampling cannot raise the ratio to {ratios[v]}")
    return added


def random_under(task: Task, ratios: Ratios | float = 1.0, seed: int = 0) -> DataFrame:
    """Keep all minority rows and the majority rows with the smallest draws.

    One histogram of the draws serves all ratios; the result is a single scan
    with constant cut positions, and larger ratios contain the smaller ones.
    """
    ratios = _ratios(ratios)
    classes = classes_of(task)
    kept = _checked_under(classes, ratios)
    rows, label = task.fitting_rows, task.require_label()
    order = draw(seed, "under", F.col(RID))
    majority_rows = rows.where(F.col(label) == F.lit(classes.majority))
    _, cuts = exact_cuts(
        majority_rows, label, [order], lambda counts: {classes.majority: sorted(set(kept.values()))}, bounds=DRAW_BOUNDS
    )
    drawn = with_draw(rows, "_h", order)
    minority = F.col(label) == F.lit(classes.minority)
    chosen = _variants_of(kept, lambda n: minority | up_to(cuts[(classes.majority, n)], [F.col("_h")]))
    return _originals(drawn.where(F.col(label).isNotNull()), task, chosen)


def random_over(task: Task, ratios: Ratios | float = 1.0, seed: int = 0) -> DataFrame:
    """All rows plus minority copies drawn with replacement."""
    ratios = _ratios(ratios)
    classes = classes_of(task)
    added = _checked_over(classes, ratios)
    rows, label = task.fitting_rows, task.require_label()
    minority = rows.where(F.col(label) == F.lit(classes.minority))
    numbered = dense_index(minority, draw(seed, "index", F.col(RID)))
    draws = _draws(task, added).withColumn(
        "idx", F.pmod(draw(seed, "copy", F.col("draw")), F.lit(classes.n_minority))
    )
    copies = draws.join(numbered, "idx").select(
        "variant", _copy_id(), *_columns(task), F.lit(COPY).alias("origin")
    )
    return _originals(rows, task, _every(list(ratios))).unionByName(copies)


def _copy_id() -> Column:
    return F.concat_ws("|", F.lit("new"), F.col("draw").cast("string")).alias(RID)


def _draws(task: Task, added: Mapping[str, int]) -> DataFrame:
    """Numbered draws per variant; smaller variants are prefixes of larger ones."""
    spark = task.df.sparkSession
    most = max([*added.values(), 0])
    slices = max(spark.sparkContext.defaultParallelism, most // ROWS_PER_SLICE + 1)
    numbers = spark.range(0, most, 1, slices).withColumnRenamed("id", "draw")
    return numbers.select("draw", _variants_of(added, lambda n: F.col("draw") < n).alias("variant"))


def near_miss(task: Task, ratios: Ratios | float = 1.0, neighbours: int = 3, seed: int = 0) -> DataFrame:
    """Keep the majority rows with the smallest mean distance to their nearest minority rows.

    Equal distances are ordered by a draw. One neighbour join serves all ratios.
    """
    ratios = _ratios(ratios)
    classes = classes_of(task)
    kept = _checked_under(classes, ratios)
    _require_numeric(task)
    if classes.n_minority < neighbours:
        raise BalancingError(f"needs {neighbours} minority rows")
    rows, label = task.fitting_rows, task.require_label()
    _require_complete(rows, task.features, task)
    points = rows.select(RID, label, vector_of(rows, task.features).alias("vec"))
    majority = points.where(F.col(label) == F.lit(classes.majority)).drop(label)
    minority = points.where(F.col(label) == F.lit(classes.minority)).drop(label)
    closeness = materialize(
        nearest(majority, minority, neighbours, exclude_self=False, n_queries=classes.n_majority)
        .groupBy(RID)
        .agg(F.avg("dist").alias("_d"))
        .withColumn("_all", F.lit(0)),
        "closeness",
    )
    order = [F.round("_d", 12), draw(seed, "near", F.col(RID))]
    _, cuts = exact_cuts(closeness, "_all", order, lambda counts: {0: sorted(set(kept.values()))})
    variants = _variants_of(kept, lambda n: up_to(cuts[(0, n)], order))
    chosen = closeness.select(RID, variants.alias("variant"))
    kept_rows = chosen.join(rows, RID).select(
        "variant", F.col(RID).cast("string").alias(RID), *_columns(task), F.lit(ORIGINAL).alias("origin")
    )
    all_minority = rows.where(F.col(label) == F.lit(classes.minority))
    return kept_rows.unionByName(_originals(all_minority, task, _every(list(ratios))))


def categorical_features(task: Task) -> list[str]:
    """Declared categorical features, else strings, booleans and integers."""
    if task.categorical is not None:
        return [c for c in task.features if c in task.categorical]
    return C.categorical_for_balancing(task.df, task.features)


def smote(
    task: Task,
    ratios: Ratios | float = 1.0,
    k: int = 5,
    seed: int = 0,
    penalty_factor: float = 0.5,
    bases: DataFrame | None = None,
) -> DataFrame:
    """All rows plus synthetic minority rows between a row and one of its neighbours.

    Numeric features are interpolated. With some categorical features these take
    the most frequent value among the base row's neighbours, and a differing
    category adds ``penalty_factor * median(std of numeric features)**2`` to the
    squared distance. With only categorical features the value-difference metric
    is used and every feature takes the most frequent neighbour value.
    """
    ratios = _ratios(ratios)
    classes = classes_of(task)
    added = _checked_over(classes, ratios)
    rows = task.fitting_rows
    everything = _originals(rows, task, _every(list(ratios)))
    categorical = categorical_features(task)
    if max(added.values()) == 0:
        return everything
    if not categorical:
        made = _interpolated(task, classes, added, k, seed, bases)
    elif len(categorical) == len(task.features):
        made = _voted(task, classes, added, k, seed)
    else:
        made = _mixed(task, classes, added, k, seed, categorical, penalty_factor)
    return everything.unionByName(made)


def _neighbour_count(classes: Classes, k: int) -> int:
    if classes.n_minority < 2:
        raise BalancingError("synthetic rows need at least two minority rows")
    return min(k, classes.n_minority - 1)


def _minority(task: Task, classes: Classes) -> DataFrame:
    return task.fitting_rows.where(F.col(task.require_label()) == F.lit(classes.minority))


def _interpolated(task, classes, added, k, seed, bases) -> DataFrame:
    """Base row, neighbour and weight come from three draws per new row."""
    minority = _minority(task, classes)
    _require_complete(minority, task.features, task)
    points = minority.select(RID, vector_of(minority, task.features).alias("vec"))
    starts = points if bases is None else points.join(bases.select(RID), RID, "left_semi")
    segments, n_bases, k = _segments(starts, points, classes, k, seed)
    if n_bases == 0:
        return _empty_like(task)
    drawn = _base_draws(task, added, n_bases, seed).withColumn(
        "rank", 1 + F.pmod(draw(seed, "neighbour", F.col("draw")), F.lit(k))
    )
    weight = uniform(seed, "weight", F.col("draw"))
    mixed = drawn.join(segments, ["idx", "rank"]).withColumn("_u", weight)
    new = F.zip_with("vec", "other", lambda a, b: a + (b - a) * F.col("_u"))
    return mixed.withColumn("_new", new).select(
        "variant",
        _copy_id(),
        *_unpacked(task, task.features, "_new"),
        F.lit(classes.minority).cast(task.df.schema[task.label].dataType).alias(task.label),
        F.lit(SYNTHETIC).alias("origin"),
    )


def _segments(starts: DataFrame, points: DataFrame, classes: Classes, k: int, seed: int):
    """Numbered base rows with the vectors of their neighbours: (idx, rank, vec, other)."""
    k = _neighbour_count(classes, k)
    pairs = nearest(starts, points, k, carry=True, n_queries=classes.n_minority)
    numbered = dense_index(starts, draw(seed, "index", F.col(RID)))
    segments = materialize(
        pairs.join(numbered, RID).select("idx", "rank", "vec", F.col("other_vec").alias("other")), "segments"
    )
    n_bases = segments.where(F.col("rank") == 1).count()
    return segments, n_bases, k


def _base_draws(task: Task, added: Mapping[str, int], n_bases: int, seed: int) -> DataFrame:
    return _draws(task, added).withColumn("idx", F.pmod(draw(seed, "base", F.col("draw")), F.lit(n_bases)))


def _unpacked(task: Task, names: Sequence[str], vector: str) -> list[Column]:
    """The entries of a vector column as the named features, in their own types."""
    if len(names) == 1 and C.is_vector(task.df, names[0]):
        return [F.col(vector).cast(task.df.schema[names[0]].dataType).alias(names[0])]
    out = []
    for i, c in enumerate(names):
        kind = task.df.schema[c].dataType
        value = F.get(vector, F.lit(i))
        out.append((F.round(value) if isinstance(kind, C.INTEGER_TYPES) else value).cast(kind).alias(c))
    return out


def _empty_like(task: Task) -> DataFrame:
    label = task.require_label()
    return task.df.limit(0).select(
        F.lit("").alias("variant"), F.lit("").alias(RID), *task.features, label, F.lit(SYNTHETIC).alias("origin")
    )


# Stands for null among the texts of categories, so that null is a category like any other.
_NULL_TEXT = "\u0000null"


def _texts(names: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("string"), F.lit(_NULL_TEXT)) for c in names])


def _from_texts(task: Task, names: Sequence[str]) -> list[Column]:
    """The carried categories of a neighbour, in the features' own types."""
    text = [F.when(F.col("other_cats")[i] != _NULL_TEXT, F.col("other_cats")[i]) for i in range(len(names))]
    return [text[i].cast(task.df.schema[c].dataType).alias(c) for i, c in enumerate(names)]


def _require_complete(rows: DataFrame, names: Sequence[str], task: Task) -> None:
    """Synthetic rows are made from numbers; a missing one would have no neighbours."""
    kinds = {c: rows.schema[c].dataType for c in names}
    missing = F.lit(False)
    for c, kind in kinds.items():
        missing = missing | F.col(c).isNull()
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            missing = missing | F.isnan(c)
        elif isinstance(kind, T.ArrayType):
            missing = missing | F.exists(c, lambda x: x.isNull() | F.isnan(x.cast("double")))
    if rows.where(missing).limit(1).collect():
        raise BalancingError(f"task {task.name} has missing values in numeric features; remove or fill them first")


def _mixed(task, classes, added, k, seed, categorical, penalty_factor) -> DataFrame:
    numeric = [c for c in task.features if c not in categorical]
    k = _neighbour_count(classes, k)
    minority = _minority(task, classes)
    _require_complete(minority, numeric, task)
    spreads = minority.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in numeric]).first()
    ordered = sorted(spreads[c] for c in numeric)
    middle = (ordered[(len(ordered) - 1) // 2] + ordered[len(ordered) // 2]) / 2
    points = minority.select(
        RID,
        vector_of(minority, numeric).alias("vec"),
        _texts(categorical).alias("cats"),
    )
    penalty = penalty_factor * middle * middle
    found = nearest(points, points, k, penalty=penalty, digits=9, carry=True, n_queries=classes.n_minority)
    beside = materialize(
        found.select(RID, "rank", F.col("other_vec").alias("other"), *_from_texts(task, categorical)),
        "mixed-neighbours",
    )
    votes = beside.groupBy(RID).agg(*[F.mode(c, True).alias(c) for c in categorical])
    numbered = dense_index(points.drop("cats"), draw(seed, "index", F.col(RID)))
    segments = materialize(
        beside.select(RID, "rank", "other")
        .join(numbered.join(votes, RID), RID)
        .select("idx", "rank", "vec", "other", *categorical),
        "mixed-segments",
    )
    drawn = _base_draws(task, added, classes.n_minority, seed).withColumn(
        "rank", 1 + F.pmod(draw(seed, "neighbour", F.col("draw")), F.lit(k))
    )
    new = F.zip_with("vec", "other", lambda a, b: a + (b - a) * F.col("_u"))
    mixed = (
        drawn.join(segments, ["idx", "rank"])
        .withColumn("_u", uniform(seed, "weight", F.col("draw")))
        .withColumn("_new", new)
    )
    values = {c: F.col(c) for c in categorical}
    for i, column in enumerate(_unpacked(task, numeric, "_new")):
        values[numeric[i]] = column
    return mixed.select(
        "variant",
        _copy_id(),
        *[values[c].alias(c) for c in task.features],
        F.lit(classes.minority).cast(task.df.schema[task.label].dataType).alias(task.label),
        F.lit(SYNTHETIC).alias("origin"),
    )


def value_differences(task: Task, classes: Classes) -> dict[str, DataFrame]:
    """Per categorical feature: value and twice its minority share.

    With two classes the value-difference metric between two values is the
    absolute difference of these numbers. Null is a value like any other.
    """
    rows, label = task.fitting_rows, task.require_label()
    share = 2 * F.avg((F.col(label) == F.lit(classes.minority)).cast("double"))
    return {
        c: rows.groupBy(F.col(c)).agg(F.round(share, 9).alias(f"_v_{c}")) for c in task.features
    }


def _voted(task, classes, added, k, seed) -> DataFrame:
    k = _neighbour_count(classes, k)
    minority = _minority(task, classes)
    coded = minority
    for c, table in value_differences(task, classes).items():
        text = F.coalesce(F.col(c).cast("string"), F.lit(_NULL_TEXT))
        keyed = table.withColumn("_key", text).select("_key", f"_v_{c}")
        coded = salted_join(coded.withColumn("_key", text), keyed, "_key").drop("_key")
    points = coded.select(
        RID, F.array(*[F.col(f"_v_{c}") for c in task.features]).alias("vec"), _texts(task.features).alias("cats")
    )
    found = nearest(points, points, k, digits=9, carry=True, n_queries=classes.n_minority)
    votes = (
        found.select(RID, *_from_texts(task, task.features))
        .groupBy(RID)
        .agg(*[F.mode(c, True).alias(c) for c in task.features])
    )
    numbered = dense_index(minority.select(RID), draw(seed, "index", F.col(RID)))
    voted = materialize(numbered.join(votes, RID).drop(RID), "votes")
    return (
        _base_draws(task, added, classes.n_minority, seed)
        .join(voted, "idx")
        .select(
            "variant",
            _copy_id(),
            *task.features,
            F.lit(classes.minority).cast(task.df.schema[task.label].dataType).alias(task.label),
            F.lit(SYNTHETIC).alias("origin"),
        )
    )


def endangered(task: Task, classes: Classes, m: int = 10) -> DataFrame:
    """Minority rows with at least half, but not all, of their m neighbours in the majority."""
    rows, label = task.fitting_rows, task.require_label()
    points = rows.select(
        RID, vector_of(rows, task.features).alias("vec"), _texts([label]).alias("cats")
    )
    minority = points.where(F.col("cats")[0] == F.lit(classes.minority).cast("string"))
    m = min(m, classes.n_majority + classes.n_minority - 1)
    against = F.sum((F.col("other_cats")[0] == F.lit(classes.majority).cast("string")).cast("int"))
    return (
        nearest(minority, points, m, carry=["cats"], n_queries=classes.n_minority)
        .groupBy(RID)
        .agg(against.alias("_against"))
        .where((F.col("_against") * 2 >= m) & (F.col("_against") < m))
        .select(RID)
    )


def borderline_smote(
    task: Task, ratios: Ratios | float = 1.0, k: int = 5, m: int = 10, seed: int = 0
) -> DataFrame:
    """SMOTE whose base rows are only the endangered ones; without any, nothing is added."""
    classes = classes_of(task)
    _require_numeric(task)
    bases = materialize(endangered(task, classes, m), "endangered")
    return smote(task, ratios, k=k, seed=seed, bases=bases)


def _require_numeric(task: Task) -> None:
    if any(isinstance(C.type_of(task.df, c), C.TEXT_TYPES) for c in task.features):
        raise BalancingError("this method needs numeric features")


def smote_tomek(task: Task, ratios: Ratios | float = 1.0, k: int = 5, seed: int = 0) -> DataFrame:
    """SMOTE, then both ends of every Tomek link are removed, for each ratio."""
    ratios = _ratios(ratios)
    label = task.require_label()
    _require_numeric(task)
    grown = materialize(smote(task, ratios, k=k, seed=seed), "grown", ["variant"])
    out = None
    for variant in ratios:
        rows = grown.where(F.col("variant") == variant)
        points = rows.select(RID, label, vector_of(rows, task.features).alias("vec"))
        links = tomek_links(points, label).select(RID)
        cleaned = rows.join(links, RID, "left_anti")
        out = cleaned if out is None else out.unionByName(cleaned)
    return out.select("variant", RID, *_columns(task), "origin")


Resampler = Callable[[DataFrame, str, float, int], DataFrame]


def custom(task: Task, resample: Resampler, ratios: Ratios | float = 1.0, seed: int = 0) -> DataFrame:
    """Adapter for user resamplers ``f(train_df, label, ratio, seed) -> DataFrame``.

    The result must keep the train part's columns and types.
    """
    label = task.require_label()
    rows = task.fitting_rows
    out = None
    for variant, ratio in _ratios(ratios).items():
        made = resample(rows, label, ratio, seed)
        for c in _columns(task):
            if c not in made.columns or made.schema[c].dataType != rows.schema[c].dataType:
                raise BalancingError(f"resampler changed column {c}")
        if RID not in made.columns:
            raise BalancingError("resampler dropped the row id")
        origin = F.col("origin") if "origin" in made.columns else F.lit(ORIGINAL)
        part = made.select(
            F.lit(variant).alias("variant"), F.col(RID).cast("string").alias(RID), *_columns(task), origin.alias("origin")
        )
        out = part if out is None else out.unionByName(part)
    return out
