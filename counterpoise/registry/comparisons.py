"""Registered queries: comparisons of explanations and summaries over variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from counterpoise.operators import compare, evaluate, explain
from counterpoise.plans import study
from counterpoise.registry import explanations as E
from counterpoise.registry import fixtures as X
from counterpoise.registry import models as M
from counterpoise.workspace import dealt_out

BASE = "original"
FILTERS = {"sampling": "under|over", "all": ".*"}


def _curves(spark, sf):
    """Partial dependence of every score expression, base marked."""
    items = X.line_items(spark, sf)
    out = None
    for name in X.SCORE_WEIGHTS:
        part = explain.partial_dependence(items, E._score(name), E.NUMERIC, model=name)
        out = part if out is None else out.unionByName(part)
    return compare.mark_base(out.withColumn("dataset", F.lit("lineitem")), BASE)


CURVES = (
    f"{X.LINE_ITEMS}, {E._grid_sql()}, curves AS ("
    + " UNION ALL ".join(f"({E._pdp_sql(m)})" for m in X.SCORE_WEIGHTS)
    + ")"
)
SDD = """
sdd AS (
  SELECT o.model, o.variable, stddev_pop(o.y_hat - b.y_hat) AS sdd
  FROM curves o JOIN curves b USING (variable, grid_idx) WHERE b.model = 'original' AND o.model <> 'original'
  GROUP BY o.model, o.variable
)"""


def sdd(spark, sf):
    return compare.curve_distance(_curves(spark, sf)).withColumn("sdd", F.round("sdd", 6))


SDD_SQL = f"""
WITH {CURVES}, {SDD}
SELECT 'lineitem' AS dataset, model, variable, round(sdd, 6) AS sdd, 0 AS grid_mismatch FROM sdd
"""


def asdd(spark, sf):
    """Mean over variables per model, and over models per variable."""
    distances = compare.curve_distance(_curves(spark, sf))
    per_model = compare.averaged_distance(distances).select(F.col("model").alias("name"), "asdd")
    per_variable = compare.averaged_distance(distances, ["variable"]).select(F.col("variable").alias("name"), "asdd")
    return per_model.unionByName(per_variable).withColumn("asdd", F.round("asdd", 6))


ASDD_SQL = f"""
WITH {CURVES}, {SDD}
SELECT model AS name, round(avg(sdd), 6) AS asdd FROM sdd GROUP BY model
UNION ALL SELECT variable, round(avg(sdd), 6) FROM sdd GROUP BY variable
"""


def _metrics(spark, sf):
    report = evaluate.class_report(M._predictions(spark, sf), ["model"], ["balanced_accuracy", "f1", "recall"])
    return compare.mark_base(report.withColumn("dataset", F.lit("lineitem")), BASE)


def perf_diff(spark, sf):
    """Differences and relative differences to the base."""
    metrics = _metrics(spark, sf)
    plain = compare.performance_change(metrics).withColumn("kind", F.lit("difference"))
    relative = compare.performance_change(metrics, percent=True).withColumn("kind", F.lit("percent"))
    return plain.unionByName(relative).withColumn("change", F.round("change", 6)).drop("dataset")


PERF_DIFF = f"""
WITH {M.PREDICTIONS}, {M.CONFUSION},
j AS (
  SELECT o.model, o.metric, o.value, b.value AS v0 FROM metrics o JOIN metrics b USING (metric)
  WHERE b.model = 'original' AND o.model <> 'original' AND o.metric IN ('balanced_accuracy', 'f1', 'recall')
)
SELECT model, metric, round(value - v0, 6) AS change, 'difference' AS kind FROM j
UNION ALL SELECT model, metric, round((value - v0) / v0, 6), 'percent' FROM j
"""


# Importances: mean absolute effect of a feature on the score, by plain aggregates.
FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _importance(spark, sf):
    """A large family of importances: |correlation| of each feature with each score, per supplier group.

    ``dataset`` is the ship year, so each year's models are tested against their own base.
    """
    rows = dealt_out(X.table(spark, sf, "lineitem")).withColumn("dataset", F.year("l_shipdate").cast("string"))
    cells = F.array(
        *[
            F.struct(
                F.lit(m).alias("model"), *[(X.score_of(m) * F.col(v)).alias(v) for v in FEATURES]
            )
            for m in X.SCORE_WEIGHTS
        ]
    )
    wide = rows.select("dataset", F.inline(cells)).groupBy("dataset", "model").agg(
        *[F.round(F.avg(v), 6).alias(v) for v in FEATURES]
    )
    long = wide.select(
        "dataset",
        "model",
        F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).alias("dropout_loss")) for v in FEATURES])),
    )
    return compare.mark_base(long, BASE)


IMPORTANCE = "imp AS (" + " UNION ALL ".join(
    f"""SELECT year(l_shipdate)::VARCHAR AS dataset, '{m}' AS model, '{v}' AS variable,
        round(avg({X.sql_score(m)} * {v}), 6) AS dropout_loss FROM lineitem GROUP BY ALL"""
    for m in X.SCORE_WEIGHTS
    for v in FEATURES
) + ")"

WILCOXON = """
pairs AS (
  SELECT o.dataset, o.model, b.dropout_loss - o.dropout_loss AS d
  FROM imp o JOIN imp b USING (dataset, variable) WHERE b.model = 'original' AND o.model <> 'original'
),
ranked AS (
  SELECT dataset, model, d, rank() OVER (PARTITION BY dataset, model ORDER BY abs(d))
         + (count(*) OVER (PARTITION BY dataset, model, abs(d)) - 1) / 2.0 AS r
  FROM pairs WHERE d <> 0
),
w AS (
  SELECT dataset, model, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS w_plus,
         sum(CASE WHEN d < 0 THEN r ELSE 0 END)::DOUBLE AS w_minus
  FROM ranked GROUP BY ALL
)"""


def wilcoxon_stat(spark, sf):
    tests = compare.wilcoxon_statistics(_importance(spark, sf))
    return tests.select("dataset", "model", "n", "w_plus", "w_minus", "statistic")


WILCOXON_STAT = f"""
WITH {IMPORTANCE}, {WILCOXON}
SELECT dataset, model, n, w_plus, w_minus, least(w_plus, w_minus) AS statistic FROM w
"""


def wilcoxon_p(spark, sf):
    """Exact two-sided p-values."""
    tests = compare.wilcoxon(_importance(spark, sf))
    return tests.select("dataset", "model", F.round("p_value", 6).alias("p_value"))


# The exact null distribution: all sign patterns of ranks 1..n, counted.
P_VALUES = """
signs AS (
  SELECT n, b, (SELECT coalesce(sum(k), 0) FROM range(1, n + 1) t(k) WHERE (b >> (k - 1)) & 1 = 1) AS t
  FROM (SELECT DISTINCT n FROM w) ns, range(16) p(b) WHERE b < (1 << n)
),
p_values AS (
  SELECT w.dataset, w.model, least(1.0::DOUBLE, 2 * count(*) FILTER (t <= floor(least(w_plus, w_minus))) / (1 << w.n)::DOUBLE) AS p_value
  FROM w JOIN signs USING (n) GROUP BY w.dataset, w.model, w.n, w_plus, w_minus
)"""

WILCOXON_P = f"""
WITH {IMPORTANCE}, {WILCOXON}, {P_VALUES} SELECT dataset, model, round(p_value, 6) AS p_value FROM p_values
"""


def mean_p(spark, sf):
    tests = compare.wilcoxon(_importance(spark, sf))
    return compare.mean_p_value(tests, ["model"]).withColumn("p_value", F.round("p_value", 6))


MEAN_P = f"""
WITH {IMPORTANCE}, {WILCOXON}, {P_VALUES} SELECT model, round(avg(p_value), 6) AS p_value FROM p_values GROUP BY model
"""


def top_variables(spark, sf):
    """The two smallest base importances per data set, and the other models aligned to them."""
    importance = _importance(spark, sf)
    top = compare.top_variables(importance, 2)
    return importance.join(top, ["dataset", "variable"]).select(
        "dataset", "model", "variable", "position", "dropout_loss"
    )


TOP_VARIABLES = f"""
WITH {IMPORTANCE},
t AS (
  SELECT dataset, variable, row_number() OVER (PARTITION BY dataset ORDER BY dropout_loss, variable) AS position
  FROM imp WHERE model = 'original'
)
SELECT dataset, model, variable, position, dropout_loss FROM imp JOIN t USING (dataset, variable) WHERE position <= 2
"""


def _feature_tests(spark, sf):
    """A p-value-like number per supplier and model: share of its rows a score ranks high."""
    rows = dealt_out(X.table(spark, sf, "lineitem"))
    cells = F.array(*[F.struct(F.lit(m).alias("model"), X.score_of(m).alias("s")) for m in X.SCORE_WEIGHTS])
    return (
        rows.select("l_suppkey", F.inline(cells))
        .groupBy("l_suppkey", "model")
        .agg(F.round(F.avg((F.col("s") > 0.9).cast("double")) / 4, 6).alias("p_value"))
    )


TESTS = "tests AS (" + " UNION ALL ".join(
    f"""SELECT l_suppkey, '{m}' AS model, round(avg(CASE WHEN {X.sql_score(m)} > 0.9 THEN 1.0::DOUBLE ELSE 0.0 END) / 4, 6) AS p_value
        FROM lineitem GROUP BY l_suppkey"""
    for m in X.SCORE_WEIGHTS
) + ")"


def fdr_bh(spark, sf):
    """Adjusted p-values within each model's family of tests."""
    adjusted = compare.adjust_fdr(_feature_tests(spark, sf), ["model"])
    return adjusted.withColumn("p_adjusted", F.round("p_adjusted", 6))


FDR_BH = f"""
WITH {TESTS},
r AS (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY p_value) AS k, count(*) OVER (PARTITION BY model) AS m FROM tests
),
a AS (
  SELECT *, min(p_value * m / k) OVER (PARTITION BY model ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS q FROM r
)
SELECT l_suppkey, model, p_value, round(least(1.0, q), 6) AS p_adjusted FROM a
"""


def accept_reject(spark, sf):
    """Decisions at a level after one correction over the values of all filters."""
    out = compare.p_value_summary(_feature_tests(spark, sf), FILTERS, level=0.1)
    return out.withColumns({c: F.round(c, 6) for c in ("accepted", "rejected")})


ACCEPT_REJECT = f"""
WITH {TESTS},
f AS (
  SELECT 'sampling' AS "filter", p_value FROM tests WHERE regexp_matches(model, 'under|over')
  UNION ALL SELECT 'all', p_value FROM tests
),
r AS (SELECT *, row_number() OVER (ORDER BY p_value) AS k, count(*) OVER () AS m FROM f),
a AS (SELECT *, least(1.0, min(p_value * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r)
SELECT "filter", count(*) AS n, round(1 - avg(CASE WHEN q <= 0.1 THEN 1 ELSE 0 END), 6) AS accepted,
       round(avg(CASE WHEN q <= 0.1 THEN 1 ELSE 0 END), 6) AS rejected
FROM a GROUP BY 1
"""


def _rounded_box(frame):
    names = ("min", "q1", "median", "q3", "max", "mean", "whisker_low", "whisker_high")
    return frame.withColumns({c: F.round(c, 6) for c in names})


def box_summary(spark, sf):
    """Box-plot data of p-values per name filter."""
    return _rounded_box(compare.p_value_summary(_feature_tests(spark, sf), FILTERS))


def _box_sql(source, value, by):
    return f"""
q AS (
  SELECT {by}, count({value}) AS n, min({value}) AS min, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
         quantile_cont({value}, 0.75) AS q3, max({value}) AS max, avg({value}) AS mean
  FROM {source} GROUP BY {by}
),
ends AS (
  SELECT {by}, min({value}) AS whisker_low, max({value}) AS whisker_high FROM {source} JOIN q USING ({by})
  WHERE {value} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY {by}
),
box AS (
  SELECT {by}, n, round(min, 6) AS min, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
         round(max, 6) AS max, round(mean, 6) AS mean, round(whisker_low, 6) AS whisker_low, round(whisker_high, 6) AS whisker_high
  FROM q JOIN ends USING ({by})
)"""


BOX_SUMMARY = f"""
WITH {TESTS},
f AS (
  SELECT 'sampling' AS flt, p_value FROM tests WHERE regexp_matches(model, 'under|over') UNION ALL SELECT 'all', p_value FROM tests
), {_box_sql('f', 'p_value', 'flt')}
SELECT * EXCLUDE (flt), flt AS "filter" FROM box
"""


def gain_points(spark, sf):
    """Performance change against averaged curve distance, per filter."""
    changes = compare.performance_change(_metrics(spark, sf)).where(F.col("metric") == "balanced_accuracy")
    points = compare.gain_points(compare.curve_distance(_curves(spark, sf)), changes, FILTERS)
    return points.select("filter", "model", F.round("change", 6).alias("change"), F.round("asdd", 6).alias("asdd"))


GAIN_POINTS = f"""
WITH {M.PREDICTIONS}, {M.CONFUSION}, {E._grid_sql()}, curves AS ({" UNION ALL ".join(f"({E._pdp_sql(m)})" for m in X.SCORE_WEIGHTS)}), {SDD},
p AS (
  SELECT s.model, avg(sdd) AS asdd,
         min((SELECT value FROM metrics x WHERE x.model = s.model AND metric = 'balanced_accuracy'))
         - min((SELECT value FROM metrics x WHERE x.model = 'original' AND metric = 'balanced_accuracy')) AS change
  FROM sdd s GROUP BY s.model
)
SELECT 'sampling' AS "filter", model, round(change, 6) AS change, round(asdd, 6) AS asdd FROM p WHERE regexp_matches(model, 'under|over')
UNION ALL SELECT 'all', model, round(change, 6), round(asdd, 6) FROM p
"""


def common_variables(spark, sf):
    """Models that have all requested variables, sorted by name regardless of case."""
    importance = _importance(spark, sf)
    lacking = importance.where((F.col("model") != "near") | (F.col("variable") != "l_tax"))
    complete = compare.with_all_variables(lacking, ["l_tax", "l_discount"])
    return compare.sorted_by_name(complete.select("dataset", "model").distinct())


COMMON_VARIABLES = f"""
WITH {IMPORTANCE} SELECT DISTINCT dataset, model FROM imp WHERE model <> 'near'
"""


def _study_values(spark, sf):
    """Balanced accuracy of every score expression on each undersampled variant of the line items."""
    from counterpoise.plans import ladder

    made = ladder.rebalance_ladder(X.line_items(spark, sf), [ladder.RANDOM_UNDER, ladder.RANDOM_OVER], 5, X.SEED)
    cells = F.array(
        *[F.struct(F.lit(m).alias("scorer"), (X.score_of(m) > 0.5).cast("int").alias("y_hat")) for m in X.SCORE_WEIGHTS]
    )
    rows = made.rows.select("variant", "y", F.inline(cells))
    values = evaluate.class_report(rows, ["variant", "scorer"], ["balanced_accuracy", "f1"])
    return values, made.variants


def study_by_method(spark, sf):
    """Study report: metric distribution by data set kind, by method and by ratio level."""
    values, variants = _study_values(spark, sf)
    report = study.metric_report(values, variants)
    return _rounded_box(report)


def _ladder_metrics_sql():
    scores = " UNION ALL ".join(
        f"SELECT '{m}' AS scorer, rid, y, CASE WHEN {X.sql_score(m)} > 0.5 THEN 1 ELSE 0 END AS y_hat FROM items"
        for m in X.SCORE_WEIGHTS
    )
    draw_index = X.sql_draw("index", "rid")
    draw_under = X.sql_draw("under", "rid")
    draw_copy = X.sql_draw("copy", "k")
    return f"""
counts AS (SELECT sum(y)::BIGINT AS few, (count(*) - sum(y))::BIGINT AS many FROM items),
steps AS (
  SELECT few, many, many::DOUBLE / few AS ratio, i, greatest(many::DOUBLE / few - i * ((many::DOUBLE / few - 1) / 5), 1.0::DOUBLE) AS r
  FROM counts, range(1, 6) t(i)
),
scored AS ({scores}),
ranked AS (SELECT rid, row_number() OVER (PARTITION BY y ORDER BY {draw_under}, rid) AS rn FROM items),
numbered AS (SELECT rid, row_number() OVER (ORDER BY {draw_index}, rid) - 1 AS idx FROM items WHERE y = 1),
draws AS (
  SELECT i, k FROM steps, range((SELECT max(floor(1 / r * many)::BIGINT - few) FROM steps)) t(k) WHERE k < floor(1 / r * many)::BIGINT - few
),
drawn AS (SELECT i, rid FROM draws JOIN numbered ON idx = {draw_copy} % (SELECT few FROM counts)),
members AS (
  SELECT 'UNDERSAMPLING__Random' AS method, i, rid FROM ranked JOIN items USING (rid), steps WHERE y = 1 OR rn <= floor(few / (1 / r))
  UNION ALL SELECT 'OVERSAMPLING__Random', i, rid FROM items, steps
  UNION ALL SELECT 'OVERSAMPLING__Random', i, rid FROM drawn
  UNION ALL SELECT 'original', 0, rid FROM items
),
cells AS (
  SELECT method, i, scorer, sum(CASE WHEN y = 1 AND y_hat = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp,
         sum(CASE WHEN y = 0 AND y_hat = 1 THEN 1 ELSE 0 END)::DOUBLE AS fp,
         sum(CASE WHEN y = 1 AND y_hat = 0 THEN 1 ELSE 0 END)::DOUBLE AS fn,
         sum(CASE WHEN y = 0 AND y_hat = 0 THEN 1 ELSE 0 END)::DOUBLE AS tn
  FROM members JOIN scored USING (rid) GROUP BY ALL
),
study AS (
  SELECT c.method, c.i, 'balanced_accuracy' AS metric, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS value,
         CASE WHEN c.i = 0 THEN 1 ELSE round((r - 1) / (ratio - 1), 2) END AS level
  FROM cells c LEFT JOIN steps s ON c.i = s.i
  UNION ALL SELECT c.method, c.i, 'f1', 2 * tp / (2 * tp + fp + fn), CASE WHEN c.i = 0 THEN 1 ELSE round((r - 1) / (ratio - 1), 2) END
  FROM cells c LEFT JOIN steps s ON c.i = s.i
),
grouped AS (
  SELECT 'dataset_type' AS grouping, CASE WHEN i = 0 THEN 'Original' ELSE 'Balanced' END AS "group", metric, value FROM study
  UNION ALL SELECT 'method', method, metric, value FROM study
  UNION ALL SELECT 'level', level::VARCHAR, metric, value FROM study WHERE i > 0
  UNION ALL SELECT 'dataset', 'lineitem', metric, value FROM study
),
keyed AS (SELECT grouping || '/' || "group" || '/' || metric AS gk, * FROM grouped)"""


STUDY_BY_METHOD = f"""
WITH {X.LINE_ITEMS}, {_ladder_metrics_sql()}, {_box_sql('keyed', 'value', 'gk')},
names AS (SELECT DISTINCT gk, grouping, "group", metric FROM keyed)
SELECT grouping, "group", metric, box.* EXCLUDE (gk) FROM box JOIN names USING (gk)
"""

QUERIES = {
    "sdd": (sdd, SDD_SQL),
    "asdd": (asdd, ASDD_SQL),
    "perf_diff": (perf_diff, PERF_DIFF),
    "wilcoxon_stat": (wilcoxon_stat, WILCOXON_STAT),
    "wilcoxon_p": (wilcoxon_p, WILCOXON_P),
    "mean_p": (mean_p, MEAN_P),
    "top_variables": (top_variables, TOP_VARIABLES),
    "fdr_bh": (fdr_bh, FDR_BH),
    "accept_reject": (accept_reject, ACCEPT_REJECT),
    "box_summary": (box_summary, BOX_SUMMARY),
    "gain_points": (gain_points, GAIN_POINTS),
    "common_variables": (common_variables, COMMON_VARIABLES),
    "study_by_method": (study_by_method, STUDY_BY_METHOD),
}
