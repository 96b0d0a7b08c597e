"""Registered queries: explanations of score expressions over all line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from counterpoise.operators import explain, model
from counterpoise.registry import fixtures as X
from counterpoise.registry.fixtures import sql_draw, sql_score

MODEL = "original"
NUMERIC = ("l_quantity", "l_discount")


def _score(model_name=MODEL):
    return lambda df: X.score_of(model_name)


def _rounded(curves, digits=6):
    return curves.withColumn("y_hat", F.round("y_hat", digits)).withColumn("x_num", F.round("x_num", digits))


def _grid_sql(variables=NUMERIC):
    return "grid AS (" + " UNION ALL ".join(
        f"""SELECT '{v}' AS variable, g::INT AS grid_idx, lo + g * ((hi - lo) / 100) AS z, lo, hi
            FROM (SELECT min({v}) AS lo, max({v}) AS hi FROM items), range(101) t(g)"""
        for v in variables
    ) + ")"


def _swapped(v, name):
    return f"CASE WHEN variable = '{name}' THEN z ELSE {v} END"


def sql_swapped_score(model_name):
    q, d, t = (_swapped(v, v) for v in ("l_quantity", "l_discount", "l_tax"))
    return sql_score(model_name, f"({q})", f"({d})", f"({t})")


def pdp_num(spark, sf):
    return _rounded(explain.partial_dependence(X.line_items(spark, sf), _score(), NUMERIC, model=MODEL))


def _pdp_sql(model_name, variables=NUMERIC):
    return f"""
SELECT '{model_name}' AS model, variable, grid_idx, min(z) AS x, avg({sql_swapped_score(model_name)}) AS y_hat
FROM items, grid GROUP BY variable, grid_idx"""


PDP_NUM = f"""
WITH {X.LINE_ITEMS}, {_grid_sql()}, p AS ({_pdp_sql(MODEL)})
SELECT model, 'PDP' AS type, variable, grid_idx, round(x, 6) AS x_num, NULL::VARCHAR AS x_cat, round(y_hat, 6) AS y_hat FROM p
"""

# A score with a text feature: the status shifts it.
STATUS_SHIFT = {"F": -0.3, "O": 0.2, "P": 0.5}


def _status_score(df):
    shift = F.lit(0.0)
    for status, value in STATUS_SHIFT.items():
        shift = F.when(F.col("o_orderstatus") == status, F.lit(value)).otherwise(shift)
    z = F.col("o_totalprice") / 250000.0 - F.lit(1.0) + shift * (F.lit(1.0) + F.col("o_totalprice") / 500000.0)
    return F.lit(0.5) + F.lit(0.5) * z / (F.lit(1.0) + F.abs(z))


def _status_sql(status):
    shift = "CASE " + " ".join(f"WHEN {status} = '{s}' THEN {v}::DOUBLE" for s, v in STATUS_SHIFT.items()) + " ELSE 0 END"
    z = f"(o_totalprice / 250000.0::DOUBLE - 1.0::DOUBLE + ({shift}) * (1.0::DOUBLE + o_totalprice / 500000.0::DOUBLE))"
    return f"(0.5::DOUBLE + 0.5::DOUBLE * {z} / (1.0::DOUBLE + abs({z})))"


CATEGORIES = "cats AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS g FROM (SELECT DISTINCT o_orderstatus AS s FROM urgent))"


def pdp_cat(spark, sf):
    return _rounded(explain.partial_dependence(X.orders(spark, sf), _status_score, ["o_orderstatus"], model=MODEL))


PDP_CAT = f"""
WITH {X.ORDERS}, {CATEGORIES}
SELECT 'original' AS model, 'PDP' AS type, 'o_orderstatus' AS variable, g AS grid_idx, NULL::DOUBLE AS x_num, s AS x_cat,
       round(avg({_status_sql('s')}), 6) AS y_hat
FROM urgent, cats GROUP BY g, s
"""


def ale_num(spark, sf):
    return _rounded(explain.accumulated_effects(X.line_items(spark, sf), _score(), NUMERIC, model=MODEL))


def _ale_sql(name):
    """The definition itself: per row and grid point the difference of two scores, weighted."""
    here = sql_score(MODEL, *[("z" if v == name else v) for v in ("l_quantity", "l_discount", "l_tax")])
    before = sql_score(MODEL, *[("z0" if v == name else v) for v in ("l_quantity", "l_discount", "l_tax")])
    return f"""
SELECT '{name}' AS variable, grid_idx, min(z) AS z,
       coalesce(sum(exp(-(({name} - z) / (0.25 * (hi - lo))) * (({name} - z) / (0.25 * (hi - lo))) / 2) * ({here} - {before}))
         / sum(exp(-(({name} - z) / (0.25 * (hi - lo))) * (({name} - z) / (0.25 * (hi - lo))) / 2)), 0) AS step
FROM items, steps WHERE variable = '{name}' GROUP BY grid_idx"""


ALE_NUM = f"""
WITH {X.LINE_ITEMS}, {_grid_sql()},
steps AS (SELECT *, lag(z) OVER (PARTITION BY variable ORDER BY grid_idx) AS z0 FROM grid),
local AS ({_ale_sql('l_quantity')} UNION ALL {_ale_sql('l_discount')}),
mean AS (SELECT avg({sql_score(MODEL)}) AS m FROM items)
SELECT 'original' AS model, 'ALE' AS type, variable, grid_idx, round(z, 6) AS x_num, NULL::VARCHAR AS x_cat,
       round(sum(step) OVER (PARTITION BY variable ORDER BY grid_idx) + m, 6) AS y_hat
FROM local, mean
"""


def ale_cat(spark, sf):
    return _rounded(explain.accumulated_effects(X.orders(spark, sf), _status_score, ["o_orderstatus"], model=MODEL))


ALE_CAT = f"""
WITH {X.ORDERS}, {CATEGORIES}, c2 AS (SELECT g, s, lag(s) OVER (ORDER BY g) AS s0 FROM cats),
local AS (
  SELECT g, s, coalesce(sum(CASE WHEN o_orderstatus = s THEN 1 ELSE exp(-8.0::DOUBLE) END * ({_status_sql('s')} - {_status_sql('s0')}))
         / sum(CASE WHEN o_orderstatus = s THEN 1 ELSE exp(-8.0::DOUBLE) END), 0) AS step,
         max(s0) AS s0
  FROM urgent, c2 GROUP BY g, s
),
mean AS (SELECT avg({_status_sql('o_orderstatus')}) AS m FROM urgent)
SELECT 'original' AS model, 'ALE' AS type, 'o_orderstatus' AS variable, g AS grid_idx, NULL::DOUBLE AS x_num, s AS x_cat,
       round(sum(CASE WHEN s0 IS NULL THEN 0 ELSE step END) OVER (ORDER BY g) + m, 6) AS y_hat
FROM local, mean
"""


def perm_importance(spark, sf):
    return _rounded_loss(
        explain.permutation_importance(
            X.line_items(spark, sf), _score(), ["l_quantity", "l_discount", "l_tax"], rounds=10, seed=X.SEED, model=MODEL
        )
    )


def _rounded_loss(frame):
    return frame.withColumn("dropout_loss", F.round("dropout_loss", 6))


def _permuted_sql(rounds):
    """Rows paired with their round's permutation, one column swapped at a time."""
    return f"""
base AS (SELECT *, row_number() OVER (ORDER BY {sql_draw('base', 'rid')}, rid) AS place FROM items),
moves AS MATERIALIZED (
  SELECT b AS round, n, list_filter(range(10000000 + {sql_draw('multiplier', 'b')} % 10000000, 10000200 + {sql_draw('multiplier', 'b')} % 10000000),
    lambda c: gcd(c, n) = 1)[1] AS m, {sql_draw('shift', 'b')} % n AS s
  FROM range({rounds}) r(b), (SELECT count(*) AS n FROM items)
),
asked AS MATERIALIZED (SELECT round, place, 1 + ((place - 1) * m + s) % n AS partner FROM moves, base),
perm AS (
  SELECT round, p.l_quantity AS q, p.l_discount AS d, p.l_tax AS t, a.place FROM asked a JOIN base p ON p.place = a.partner
),
swapped AS (
  SELECT round, v AS variable, y, CASE WHEN v = 'l_quantity' THEN q ELSE l_quantity END AS q2,
         CASE WHEN v = 'l_discount' THEN d ELSE l_discount END AS d2, CASE WHEN v = 'l_tax' THEN t ELSE l_tax END AS t2
  FROM base JOIN perm USING (place), (VALUES ('l_quantity'), ('l_discount'), ('l_tax')) vs(v)
)"""


def _importance_sql(name, rounds):
    return f"""
s_{name} AS (SELECT round, variable, y, {sql_score(name, 'q2', 'd2', 't2')} AS p1 FROM swapped),
g_{name} AS (SELECT round, variable, p1, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM s_{name} GROUP BY ALL),
w_{name} AS (SELECT *, sum(n) OVER (PARTITION BY round, variable ORDER BY p1 ROWS UNBOUNDED PRECEDING) - n + (n + 1) / 2 AS r FROM g_{name}),
a_{name} AS (
  SELECT round, variable, (sum(pos * r) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * (sum(n) - sum(pos))) AS auc
  FROM w_{name} GROUP BY round, variable
),
i_{name} AS (SELECT '{name}' AS model, variable, avg(1 - auc) AS dropout_loss FROM a_{name} GROUP BY variable)"""


PERM_IMPORTANCE = f"""
WITH {X.LINE_ITEMS}, {_permuted_sql(10)}, {_importance_sql(MODEL, 10)}
SELECT model, variable, round(dropout_loss, 6) AS dropout_loss FROM i_{MODEL}
"""


def perm_importance_rmse(spark, sf):
    return _rounded_loss(
        explain.permutation_importance(
            X.line_items(spark, sf), _score(), ["l_quantity", "l_discount", "l_tax"], rounds=10, loss="rmse", seed=X.SEED, model=MODEL
        )
    )


PERM_IMPORTANCE_RMSE = f"""
WITH {X.LINE_ITEMS}, {_permuted_sql(10)},
l AS (
  SELECT round, variable, sqrt(avg((y - {sql_score(MODEL, 'q2', 'd2', 't2')}) * (y - {sql_score(MODEL, 'q2', 'd2', 't2')}))) AS loss
  FROM swapped GROUP BY round, variable
)
SELECT 'original' AS model, variable, round(avg(loss), 6) AS dropout_loss FROM l GROUP BY variable
"""


def center_curve(spark, sf):
    curves = explain.partial_dependence(X.line_items(spark, sf), _score(), ["l_tax"], model=MODEL)
    return _rounded(explain.centered(curves)).select("variable", "grid_idx", "y_hat")


CENTER_CURVE = f"""
WITH {X.LINE_ITEMS}, {_grid_sql(['l_tax'])}, p AS ({_pdp_sql(MODEL)})
SELECT variable, grid_idx, round(y_hat - first_value(y_hat) OVER (PARTITION BY variable ORDER BY grid_idx), 6) AS y_hat FROM p
"""


def pdp_sampled(spark, sf):
    """The N parameter: exactly 500 rows with the smallest draws are explained."""
    curves = explain.partial_dependence(X.line_items(spark, sf), _score(), NUMERIC, steps=20, n=500, seed=X.SEED, model=MODEL)
    return _rounded(curves).select("variable", "grid_idx", "x_num", "y_hat")


PDP_SAMPLED = f"""
WITH {X.LINE_ITEMS.replace('items AS', 'whole AS')},
items AS (SELECT * FROM whole ORDER BY {sql_draw('sample', 'rid')}, rid LIMIT 500),
{_grid_sql().replace('/ 100)', '/ 20)').replace('range(101)', 'range(21)')}, p AS ({_pdp_sql(MODEL)})
SELECT variable, grid_idx, round(x, 6) AS x_num, round(y_hat, 6) AS y_hat FROM p
"""


def explain_forest(spark, sf):
    """Partial dependence and importance of a fitted forest with a text feature, on its test part."""
    orders = X.orders(spark, sf)
    fitted = model.fit_model(orders, model.random_forest(trees=10, depth=4), test_size=0.2, seed=X.SEED)
    curves = explain.partial_dependence(fitted.task, fitted.score, model=fitted.name)
    parts = explain.permutation_importance(fitted.task, fitted.score, model=fitted.name, majority=fitted.majority)
    shaped = parts.select(
        "model", F.lit("VI").alias("type"), "variable", F.lit(0).alias("grid_idx"),
        F.lit(None).cast("double").alias("x_num"), F.lit(None).cast("string").alias("x_cat"),
        F.col("dropout_loss").alias("y_hat"),
    )
    return explain.with_performance(curves.unionByName(shaped), fitted.evaluate())


QUERIES = {
    "pdp_num": (pdp_num, PDP_NUM),
    "pdp_cat": (pdp_cat, PDP_CAT),
    "pdp_sampled": (pdp_sampled, PDP_SAMPLED),
    "ale_num": (ale_num, ALE_NUM),
    "ale_cat": (ale_cat, ALE_CAT),
    "perm_importance": (perm_importance, PERM_IMPORTANCE),
    "perm_importance_rmse": (perm_importance_rmse, PERM_IMPORTANCE_RMSE),
    "center_curve": (center_curve, CENTER_CURVE),
    "explain_forest": (explain_forest, None),
}

