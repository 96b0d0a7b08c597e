"""Ratio ladders, method families and parameter sweeps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.errors import (
    AnalysisException,
    ArithmeticException,
    ArrayIndexOutOfBoundsException,
    DateTimeException,
    NumberFormatException,
    PythonException,
    SparkRuntimeException,
)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from counterpoise.operators import resample
from counterpoise.operators.prepare import custom_split, with_majority
from counterpoise.operators.resample import Classes, classes_of
from counterpoise.task import RID, Task, TaskSet
from counterpoise.workspace import materialize, shared_folder

ORIGINAL_VARIANT = "original"

Method = Callable[[Task, Mapping[str, float], int], DataFrame]

# Method names as they appear in variant names, with the family order.
RANDOM_UNDER = "UNDERSAMPLING__Random"
NEAR_MISS = "UNDERSAMPLING__Near_Miss"
RANDOM_OVER = "OVERSAMPLING__Random"
SMOTE = "OVERSAMPLING__SMOTE"
BORDERLINE_SMOTE = "OVERSAMPLING__Borderline_SMOTE"
SMOTE_TOMEK = "COMBINED__SMOTE_Tomek"
BASIC = (RANDOM_UNDER, RANDOM_OVER, SMOTE)
EXTENSION = (NEAR_MISS, BORDERLINE_SMOTE, SMOTE_TOMEK)
AUTOMATIC = (RANDOM_UNDER, NEAR_MISS, RANDOM_OVER, SMOTE, BORDERLINE_SMOTE, SMOTE_TOMEK)

METHODS: dict[str, Method] = {
    RANDOM_UNDER: lambda t, r, s: resample.random_under(t, r, s),
    NEAR_MISS: lambda t, r, s: resample.near_miss(t, r, seed=s),
    RANDOM_OVER: lambda t, r, s: resample.random_over(t, r, s),
    SMOTE: lambda t, r, s: resample.smote(t, r, seed=s),
    BORDERLINE_SMOTE: lambda t, r, s: resample.borderline_smote(t, r, seed=s),
    SMOTE_TOMEK: lambda t, r, s: resample.smote_tomek(t, r, seed=s),
}


def ladder_ratios(classes: Classes, n: int, min_samples_to_modify: int | None = None) -> list[float]:
    """Evenly spaced ratios from just below the present one down to 1.

    With ``min_samples_to_modify`` the step is widened (and the ladder shortened)
    until every step adds or removes at least that many rows.
    """
    ratio = classes.ratio
    if ratio == 1:
        return []
    span = ratio - 1
    step = span / n
    if min_samples_to_modify is not None:
        few, many = classes.n_minority, classes.n_majority
        removed = step * few
        added = many * few / (many - removed) - few
        if min(removed, added) < min_samples_to_modify:
            step = max(min_samples_to_modify / few, many * (1 / few - 1 / (few + min_samples_to_modify)))
            n = 1 if round(step, 3) == round(span, 3) else int(span // step + 1)
    return [max(ratio - i * step, 1.0) for i in range(1, n + 1)]


@dataclass(frozen=True)
class Variant:
    name: str
    method: str
    ir: float
    ir_frac_base: float
    ir_frac_range: float


def variant_of(dataset: str, method: str, ratio: float, base: float, precision: int = 2) -> Variant:
    """A variant with the rendered name that later name filters rely on."""
    of_base, of_range = ratio / base, (ratio - 1) / (base - 1)
    shown = [round(x, precision) for x in (ratio, of_base, of_range)]
    name = f"{dataset}_transformed_{method}_IR={shown[0]}={shown[1]}BASE_IR={shown[2]}IR_RANGE"
    return Variant(name, method, ratio, of_base, of_range)


@dataclass(frozen=True)
class Ladder:
    """``rows``: long table of the rebalanced train rows of all variants;
    ``variants`` and ``failures``: small tables.

    ``branches`` are the independent parts of ``rows`` (one method with all its
    ratios, one parameter set, the original) with the variant names each makes;
    ``ledger`` (after ``stored``) says for every variant whether its branch was
    committed, with its stored row count, or why it failed.
    """

    rows: DataFrame | None
    variants: DataFrame
    failures: DataFrame
    names: tuple[str, ...]
    majority: Any = None
    branches: tuple[tuple[tuple[str, ...], DataFrame], ...] = ()
    ledger: DataFrame | None = None
    base: DataFrame | None = None
    overlays: tuple[tuple[tuple[str, ...], DataFrame, DataFrame], ...] = ()

    def stored(self) -> "Ladder":
        """Every branch written and counted in its own job, in its own folder, one directory per variant.

        A branch whose tasks raise (user code, a value refused while rows are
        made) is written to the failure ledger with its reason and left out; the
        rows are the union of the committed folders only, so a fit reads its own
        variant and a lost branch spoils no other. Failures of the cluster (lost
        executors after their retries, full disks) are raised.
        """
        if self.rows is None:
            return self
        if not self.branches:
            return replace(self, rows=materialize(self.rows, "variants", ["variant"]))
        spark = self.rows.sparkSession
        context = spark.sparkContext
        root = f"{shared_folder(spark)}/variants-{uuid.uuid4().hex}"
        dataset = _dataset_of(self)
        base = None
        if self.base is not None:
            base = materialize(self.base, "variant-base")
            n_base = base.count()
        kept, failed, entries, overlays = [], [], [], []
        for i, (names, part) in enumerate(self.branches):
            path = f"{root}/branch-{i}"
            context.setJobGroup(f"{root}/{i}", "variants " + ", ".join(names))
            try:
                if base is None:
                    part.write.partitionBy("variant").parquet(path)
                    back = spark.read.schema(part.schema).parquet(path)
                    counted = dict(back.groupBy("variant").count().collect())
                else:
                    added, removed = _difference(part, base, names)
                    added.write.partitionBy("variant").parquet(f"{path}/added")
                    removed.write.partitionBy("variant").parquet(f"{path}/removed")
                    back_added = spark.read.schema(added.schema).parquet(f"{path}/added")
                    back_removed = spark.read.schema(removed.schema).parquet(f"{path}/removed")
                    back = _overlay(base, back_added, back_removed, names, part.columns)
                    plus = dict(back_added.groupBy("variant").count().collect())
                    minus = dict(back_removed.groupBy("variant").count().collect())
                    counted = {n: n_base - minus.get(n, 0) + plus.get(n, 0) for n in names}
            except RAISED_IN_TASKS + UNSUITABLE as error:
                if isinstance(error, SparkRuntimeException) and error.getCondition() != "USER_RAISED_EXCEPTION":
                    raise
                reason = _reason(error)
                failed.extend((dataset, name, reason) for name in names)
                entries.extend((name, False, None, reason) for name in names)
                continue
            finally:
                context.setLocalProperty("spark.jobGroup.id", None)
                context.setLocalProperty("spark.job.description", None)
            kept.append((names, back))
            if base is not None:
                overlays.append((tuple(names), back_added, back_removed))
            entries.extend((name, True, int(counted.get(name, 0)), None) for name in names)
        committed = [name for name, ok, _, _ in entries if ok]
        rows = reduce(lambda a, b: a.unionByName(b), [back for _, back in kept]) if kept else None
        lost = spark.createDataFrame(failed, "path string, variant string, reason string")
        return replace(
            self,
            rows=rows,
            variants=self.variants.where(F.col("variant").isin(committed)),
            failures=self.failures.unionByName(lost),
            names=tuple(n for n in self.names if n in committed),
            branches=tuple(kept),
            base=base if base is not None else self.base,
            overlays=tuple(overlays),
            ledger=spark.createDataFrame(entries, "variant string, committed boolean, n_rows long, reason string"),
        )

    def variant_rows(self, variant: str) -> DataFrame:
        """Rows of one variant; a stored one reads only the base and its own differences."""
        for names, added, removed in self.overlays:
            if variant in names:
                gone = removed.where(F.col("variant") == variant).select(RID)
                own = self.base.join(gone, RID, "left_anti").select(F.lit(variant).alias("variant"), *self.base.columns)
                return own.select(*self.rows.columns).unionByName(added.where(F.col("variant") == variant).select(*self.rows.columns))
        return self.rows.where(F.col("variant") == variant)

    def task(self, base: Task, variant: str) -> Task:
        """One variant as a task; the test part is the base task's, untouched."""
        rows = self.variant_rows(variant).drop("variant", "origin")
        majority = self.majority if base.majority is None else base.majority
        whole = replace(base, name=variant, df=rows, majority=majority)
        if not base.was_split:
            return whole
        test = base.test.df.withColumn(RID, F.col(RID).cast("string"))
        return custom_split(whole, rows, test.select(*rows.columns))


def rebalance_ladder(
    task: Task,
    methods: Sequence[str] | Mapping[str, Method] = AUTOMATIC,
    n_per_method: int = 5,
    seed: int = 0,
    keep_original: bool = True,
    min_samples_to_modify: int | None = None,
    precision: int = 2,
) -> Ladder:
    """Every method at every ratio; the original comes last.

    Each method builds its neighbour or index tables once for all ratios. A
    method that cannot serve this task is reported in ``failures``; the others
    survive.
    """
    chosen = dict(methods) if isinstance(methods, Mapping) else {m: METHODS[m] for m in methods}
    classes = classes_of(task)
    task = with_majority(task)
    ratios = ladder_ratios(classes, n_per_method, min_samples_to_modify)
    rows, variants, failures, branches = None, [], [], []
    for method, build in chosen.items():
        made = [variant_of(task.name, method, r, classes.ratio, precision) for r in ratios]
        wanted = _unique_names(made)
        for served, part in _served(lambda some, build=build: build(task, some, seed), wanted, task, failures):
            variants.extend((name, wanted[name]) for name in served)
            branches.append((tuple(served), part))
            rows = part if rows is None else rows.unionByName(part)
    names = [name for name, _ in variants]
    if keep_original:
        base = _original_rows(task)
        branches.append(((task.name,), base))
        rows = base if rows is None else rows.unionByName(base)
        names.append(task.name)
        variants.append((task.name, Variant(task.name, ORIGINAL_VARIANT, classes.ratio, 1.0, 1.0)))
    return Ladder(
        rows,
        _variants_table(task, variants),
        _failures_table(task, failures),
        tuple(names),
        task.majority,
        tuple(branches),
        base=_original_rows(task).drop("variant"),
    )


# What an operator raises when a task, ratio or parameter does not suit it. Failures of
# the cluster (lost executors, full disks) are none of these and are not hidden.
UNSUITABLE = (ValueError, TypeError, KeyError, AnalysisException)
# What the same refusal looks like when it happens inside tasks, while rows are made.
RAISED_IN_TASKS = (
    PythonException,
    ArithmeticException,
    ArrayIndexOutOfBoundsException,
    DateTimeException,
    NumberFormatException,
    SparkRuntimeException,
)


def _difference(part: DataFrame, base: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """A branch as differences from the base rows: rows to add, and ids of base rows to remove, per variant.

    A row counts as the base row when its origin is original, it equals the base
    row of its id in every column (nulls equal) and is the first of its id in the
    variant; every other row (copies, synthetic rows, changed or repeated
    originals) is added as it is.
    """
    columns = [c for c in part.columns if c not in ("variant", RID, "origin")]
    b = base.select(F.col(RID).alias("_base_rid"), *[F.col(c).alias(f"_base_{c}") for c in columns], F.lit(True).alias("_in_base"))
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_base_{c}")), columns, F.col("origin") == resample.ORIGINAL)
    marked = part.join(b, part[RID] == b["_base_rid"], "left").withColumn("_same", F.coalesce(F.col("_in_base") & same, F.lit(False)))
    first = F.row_number().over(Window.partitionBy("variant", RID, "_same").orderBy(F.lit(1))) == 1
    marked = marked.withColumn("_kept", F.col("_same") & first)
    added = marked.where(~F.col("_kept")).select(*part.columns)
    kept = marked.where(F.col("_kept")).select("variant", RID)
    every = base.select(RID, F.explode(F.array(*[F.lit(n) for n in names])).alias("variant"))
    return added, every.join(kept, ["variant", RID], "left_anti").select("variant", RID)


def _overlay(base: DataFrame, added: DataFrame, removed: DataFrame, names: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of the variants: base rows without the removed ids, with the added rows."""
    every = base.select(F.explode(F.array(*[F.lit(n) for n in names])).alias("variant"), *base.columns)
    return every.join(removed, ["variant", RID], "left_anti").select(*columns).unionByName(added.select(*columns))


def _reason(error: Exception) -> str:
    """The first line that names the error, without the JVM's stack."""
    text = str(error).strip()
    lines = [line.strip() for line in text.splitlines() if line.strip()]
    named = [line for line in lines if "Error:" in line or "Exception:" in line or "]" in line[:60]]
    return (named[-1] if isinstance(error, PythonException) and named else (lines[0] if lines else type(error).__name__))[:500]


def _dataset_of(ladder: Ladder) -> str:
    first = ladder.variants.select("dataset").limit(1).collect()
    return first[0][0] if first else ""


def _served(build, wanted: Mapping[str, Variant], task: Task, failures: list) -> list[tuple[list[str], DataFrame]]:
    """All ratios in one go; if the method refuses, ratio by ratio, so that one bad ratio spoils no other."""
    if not wanted:
        return []
    try:
        return [(list(wanted), build({n: v.ir for n, v in wanted.items()}))]
    except UNSUITABLE as error:
        if len(wanted) == 1:
            failures.append((task.name, next(iter(wanted)), str(error)))
            return []
    return [done for n, v in wanted.items() for done in _served(build, {n: v}, task, failures)]


def _unique_names(made: Sequence[Variant]) -> dict[str, Variant]:
    """Clashing rendered names get a running number."""
    out: dict[str, Variant] = {}
    for variant in made:
        name, i = variant.name, 1
        while name in out:
            name, i = f"{variant.name}_{i}", i + 1
        out[name] = replace(variant, name=name)
    return out


def _original_rows(task: Task) -> DataFrame:
    return task.fitting_rows.select(
        F.lit(task.name).alias("variant"),
        F.col("rid").cast("string").alias("rid"),
        *task.features,
        task.require_label(),
        F.lit(resample.ORIGINAL).alias("origin"),
    )


def _variants_table(task: Task, variants) -> DataFrame:
    rows = [
        (task.name, name, v.method, float(v.ir), float(v.ir_frac_base), float(v.ir_frac_range), v.method == ORIGINAL_VARIANT)
        for name, v in variants
    ]
    schema = (
        "dataset string, variant string, method string, ir double, "
        "ir_frac_base double, ir_frac_range double, is_base boolean"
    )
    return task.df.sparkSession.createDataFrame(rows, schema)


def _failures_table(task: Task, failures) -> DataFrame:
    return task.df.sparkSession.createDataFrame(failures, "path string, variant string, reason string")


def sweep(task: Task, op: Callable[..., DataFrame], params: Sequence[Mapping[str, Any]], suffixes=None) -> Ladder:
    """One operator with a list of parameter sets; one variant per set.

    ``op(task, **params)`` returns a single-variant long table. ``ratio`` (or its
    inverse ``alpha``) among the parameters is passed on as the ratio.
    """
    if suffixes is not None and len(suffixes) != len(params):
        raise ValueError("one suffix per parameter set is needed")
    rows, variants, failures, branches = None, [], [], []
    base = classes_of(task).ratio
    taken: set[str] = set()
    for i, given in enumerate(params):
        settings = dict(given)
        if "alpha" in settings:
            settings["ratio"] = 1 / settings.pop("alpha")
        ratio = float(settings.pop("ratio", 1.0))
        stem = name = f"{task.name}{suffixes[i] if suffixes else f'_transformed_{i}'}"
        number = 1
        while name in taken:
            name, number = f"{stem}_{number}", number + 1
        taken.add(name)
        try:
            part = op(task, {name: ratio}, **settings)
        except UNSUITABLE as error:
            failures.append((task.name, name, str(error)))
            continue
        of_range = (ratio - 1) / (base - 1) if base != 1 else 0.0
        variants.append((name, Variant(name, op.__name__, ratio, ratio / base, of_range)))
        branches.append(((name,), part))
        rows = part if rows is None else rows.unionByName(part)
    names = tuple(n for n, _ in variants)
    majority = with_majority(task).majority
    base_rows = _original_rows(task).drop("variant")
    return Ladder(rows, _variants_table(task, variants), _failures_table(task, failures), names, majority, tuple(branches), base=base_rows)


def sweep_all(tasks: TaskSet, op: Callable[..., DataFrame], params) -> dict[tuple[str, ...], Ladder]:
    """A sweep per member, path kept. ``params``: one list for all, or one list per member."""
    nested = bool(params) and isinstance(params[0], (list, tuple))
    if nested and len(params) != len(tasks):
        raise ValueError("one parameter list per task is needed")
    return {
        path: sweep(member, op, params[i] if nested else params) for i, (path, member) in enumerate(tasks.members)
    }


def ladder_all(tasks: TaskSet, **settings) -> dict[tuple[str, ...], Ladder]:
    """A ladder per member, path kept."""
    return {path: rebalance_ladder(member, **settings) for path, member in tasks.members}
