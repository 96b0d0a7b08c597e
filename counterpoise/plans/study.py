"""The whole study: rebalance, train, evaluate, explain, compare, summarise."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpoise.operators import compare, evaluate, explain, model
from counterpoise.operators.prepare import class_counts, majority_of
from counterpoise.plans import ladder
from counterpoise.task import Task
from counterpoise.workspace import materialize, run_jobs

GROUPINGS = ("dataset_type", "method", "level", "dataset")


def grouped_by_variant(values: DataFrame, variants: DataFrame, groupings: Sequence[str] = GROUPINGS) -> DataFrame:
    """One copy of each row per grouping: (grouping, group, ...).

    ``dataset_type`` tells balanced from original; ``level`` is the remaining
    share of the imbalance and leaves the original out.
    """
    level = F.round("ir_frac_range", 2).cast("string")
    groups = {
        "dataset_type": F.when(F.col("is_base"), "Original").otherwise("Balanced"),
        "method": F.col("method"),
        "level": F.when(~F.col("is_base"), level),
        "dataset": F.col("dataset"),
    }
    keys = variants.select("variant", "dataset", "method", "ir_frac_range", "is_base")
    cells = F.array(*[F.struct(F.lit(g).alias("grouping"), groups[g].alias("group")) for g in groupings])
    kept = [c for c in values.columns if c != "dataset"]
    return (
        values.drop("dataset")
        .join(keys, "variant")
        .select(*kept, F.inline(cells))
        .where(F.col("group").isNotNull())
    )


def metric_report(values: DataFrame, variants: DataFrame, by: Sequence[str] = ("metric",)) -> DataFrame:
    """Distribution of a metric per grouping; ``values`` has (variant, metric, value, ...)."""
    grouped = grouped_by_variant(values, variants)
    return compare.box_summary(grouped, "value", ["grouping", "group", *by])


def distance_report(distances: DataFrame, variants: DataFrame) -> DataFrame:
    """Distribution of SDD per grouping, without the base."""
    named = distances.withColumnRenamed("model", "variant")
    grouped = grouped_by_variant(named, variants, ("method", "level", "dataset"))
    return compare.box_summary(grouped, "sdd", ["grouping", "group"])


def decision_report(tests: DataFrame, variants: DataFrame, level: float = 0.05) -> DataFrame:
    """Accepted and rejected fractions per grouping after one correction over all tests."""
    adjusted = compare.adjust_fdr(tests).withColumnRenamed("model", "variant")
    grouped = grouped_by_variant(adjusted, variants, ("method", "level", "dataset"))
    return compare.decision_shares(grouped, level, ["grouping", "group"])


@dataclass(frozen=True)
class Study:
    """Result tables of one data set's study."""

    variants: DataFrame
    failures: DataFrame
    metrics: DataFrame
    curves: DataFrame
    importance: DataFrame
    distances: DataFrame
    tests: DataFrame

    def metric_report(self) -> DataFrame:
        return metric_report(self.metrics.withColumnRenamed("model", "variant"), self.variants)

    def distance_report(self) -> DataFrame:
        return distance_report(self.distances, self.variants)

    def decision_report(self, level: float = 0.05) -> DataFrame:
        return decision_report(self.tests, self.variants, level)


def run_study(
    task: Task,
    estimator: Estimator,
    methods: Sequence[str] = ladder.AUTOMATIC,
    n_per_method: int = 5,
    seed: int = 0,
    balanced_weights: bool = False,
    curve_type: str = "PDP",
    steps: int = explain.GRID_STEPS,
    rounds: int = 10,
    concurrency: int = 4,
) -> Study:
    """Run every stage for one split task; result tables are small and kept."""
    made = ladder.rebalance_ladder(task, methods, n_per_method, seed).stored()
    majority = majority_of(class_counts(task))

    def fit(name):
        variant = made.task(task, name)
        variant = variant.with_df(variant.df, majority=majority)
        return model.fit_model(variant, estimator, seed=seed, balanced_weights=balanced_weights, name=name)

    names = list(made.names)
    models = dict(
        zip([(n,) for n in names], run_jobs([lambda n=n: fit(n) for n in names], concurrency))
    )
    predictions = materialize(model.predict_all(models), "predictions")
    metrics = materialize(evaluate.report(predictions, ["model"]), "metrics")
    curves = explain.explain_all(models, curve_type, concurrency=concurrency, steps=steps)
    importance = explain.explain_all(models, "VI", concurrency=concurrency, rounds=rounds, seed=seed)

    def marked(frame, stem):
        stored = materialize(frame.withColumn("dataset", F.lit(task.name)), stem)
        return compare.mark_base(stored, task.name)

    curves, importance = marked(curves, "curves"), marked(importance, "importance")
    return Study(
        variants=made.variants,
        failures=made.failures,
        metrics=metrics,
        curves=curves,
        importance=importance,
        distances=compare.curve_distance(curves),
        tests=compare.wilcoxon(importance),
    )
