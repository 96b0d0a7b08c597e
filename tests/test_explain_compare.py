import math
import random

import pytest
from pyspark.sql import functions as F

from counterpoise.operators import compare, evaluate, explain
from counterpoise.sources.tables import task


def items(spark, n=200):
    pick = random.Random(3)
    rows = [(i, pick.uniform(0, 10), pick.uniform(-1, 1), pick.choice("pq"), int(pick.random() < 0.3)) for i in range(n)]
    return task(spark.createDataFrame(rows, "id int, u double, v double, c string, y int"), "y", key="id")


def linear(df):
    return 0.05 * F.col("u") + 0.1


def curve(df, variable):
    return [r["y_hat"] for r in df.where(F.col("variable") == variable).orderBy("grid_idx").collect()]


def test_linear_score_gives_straight_lines(spark):
    t = items(spark)
    for make in (explain.partial_dependence, explain.accumulated_effects):
        curves = make(t, linear, ["u", "v"], steps=10)
        u, v = curve(curves, "u"), curve(curves, "v")
        gaps = [b - a for a, b in zip(u, u[1:])]
        assert len(u) == 11 and max(gaps) - min(gaps) < 1e-9 and gaps[0] > 0
        assert max(v) - min(v) < 1e-9


def test_categorical_curves(spark):
    t = items(spark)
    score = lambda df: F.when(F.col("c") == "p", 0.2).otherwise(0.7)
    pdp = explain.partial_dependence(t, score, ["c"]).orderBy("grid_idx").collect()
    assert [(r["x_cat"], round(r["y_hat"], 9)) for r in pdp] == [("p", 0.2), ("q", 0.7)]
    ale = curve(explain.accumulated_effects(t, score, ["c"]), "c")
    assert abs(ale[1] - ale[0] - 0.5) < 1e-9


def test_zero_range_variable_is_one_point(spark):
    t = items(spark)
    flat = t.with_df(t.df.withColumn("v", F.lit(4.0)))
    for make in (explain.partial_dependence, explain.accumulated_effects):
        points = make(flat, linear, ["v"]).collect()
        mean = flat.df.agg(F.avg(linear(None))).first()[0]
        assert len(points) == 1 and points[0]["x_num"] == 4.0 and abs(points[0]["y_hat"] - mean) < 1e-9


def test_unused_variable_keeps_the_full_loss(spark):
    t = items(spark)
    parts = explain.permutation_importance(t, linear, ["u", "v"], rounds=3, seed=2)
    loss = {r["variable"]: r["dropout_loss"] for r in parts.collect()}
    scored = t.df.withColumn("p1", linear(None)).withColumn("m", F.lit("m"))
    full = 1 - evaluate.roc_auc(scored, ["m"]).first()["roc_auc"]
    assert abs(loss["v"] - full) < 1e-12 and abs(loss["u"] - full) > 1e-6


def test_importance_does_not_depend_on_partitions(spark):
    t = items(spark)
    seen = set()
    for n in (1, 4, 17):
        parts = explain.permutation_importance(t.with_df(t.df.repartition(n)), linear, ["u"], rounds=2)
        seen.add(round(parts.first()["dropout_loss"], 12))
    assert len(seen) == 1


def test_centered_and_lookup(spark):
    curves = explain.partial_dependence(items(spark), linear, ["u", "v"], steps=4)
    assert curve(explain.centered(curves), "u")[0] == 0
    assert explain.of_variable(curves, "v").count() == 5


def fake_curves(spark):
    rows = []
    for model, shift, tilt in (("base", 0, 0), ("moved", 3, 0), ("tilted_IR=1", 0, 2)):
        for g in range(3):
            rows.append(("d", model, "PDP", "u", g, float(g), None, 1.0 + shift + tilt * g))
    schema = "dataset string, model string, type string, variable string, grid_idx int, x_num double, x_cat string, y_hat double"
    return compare.mark_base(spark.createDataFrame(rows, schema), "base")


def test_distance_is_a_standard_deviation(spark):
    found = {r["model"]: r for r in compare.curve_distance(fake_curves(spark)).collect()}
    assert found["moved"]["sdd"] == 0
    assert abs(found["tilted_IR=1"]["sdd"] - math.sqrt(8 / 3)) < 1e-12
    assert all(r["grid_mismatch"] == 0 for r in found.values())


def test_filters(spark):
    curves = fake_curves(spark)
    assert {r["model"] for r in compare.filter_models(curves, "IR=").select("model").distinct().collect()} == {"base", "tilted_IR=1"}
    with pytest.raises(ValueError):
        compare.by_filter(curves, {"a": "x"}, labels=["one", "two"])
    assert compare.by_filter(curves, None).first()["filter"] == "All values"


def test_last_position_is_the_default_base(spark):
    rows = spark.createDataFrame([("d", "a", 0), ("d", "b", 1), ("e", "c", 5)], "dataset string, model string, position int")
    marked = {r["model"]: r["is_base"] for r in compare.mark_base(rows).collect()}
    assert marked == {"a": False, "b": True, "c": True}


def importance(spark, values):
    rows = [("d", m, f"v{i}", float(x)) for m, xs in values.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "dataset string, model string, variable string, dropout_loss double")
    return compare.mark_base(df, "base")


def test_wilcoxon_known_values(spark):
    table = importance(spark, {"base": [1, 2, 3, 4, 5], "up": [2, 4, 6, 8, 10], "same": [1, 2, 3, 4, 5]})
    found = {r["model"]: r for r in compare.wilcoxon(table).collect()}
    assert found["up"]["p_value"] == 0.0625 and found["up"]["statistic"] == 0
    assert found["same"]["p_value"] is None and found["same"]["status"] != "ok"


def test_signed_rank_distribution():
    # Published two-sided critical values: n = 8, T = 3 is below 0.05; T = 4 is above.
    assert compare.signed_rank_p(8, 3, 0, 0) < 0.05 < compare.signed_rank_p(8, 4, 0, 0)
    assert abs(compare.signed_rank_p(6, 0, 0, 0) - 2 / 64) < 1e-15
    # The normal approximation joins the exact values smoothly.
    assert abs(compare.signed_rank_p(25, 100, 0, 0) - compare.signed_rank_p(25, 100, 0, 0, exact_up_to=0)) < 0.01
    assert abs(compare.signed_rank_p(100, 100 * 101 / 4, 0, 0) - 1) < 1e-12


def test_top_variables_take_the_smallest(spark):
    table = importance(spark, {"base": [5, 1, 3], "other": [1, 2, 3]})
    top = compare.top_variables(table, 2).orderBy("position").collect()
    assert [r["variable"] for r in top] == ["v1", "v2"]
    assert compare.wilcoxon(table, max_variables=2).first()["n"] == 1


def test_variables_must_agree(spark):
    table = importance(spark, {"base": [5, 1, 3], "other": [1, 2]})
    assert not compare.same_variables(table)
    with pytest.raises(ValueError):
        compare.require_variables(table, None)
    with pytest.raises(ValueError):
        compare.require_variables(table, ["v0", "zz"])
    assert compare.require_variables(table, "v2").select("model").distinct().count() == 1
    assert compare.with_all_variables(table, ["v0", "v1"]).select("model").distinct().count() == 2


def test_fdr_known_values(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.04]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p_value double")
    got = [round(r["p_adjusted"], 6) for r in compare.adjust_fdr(df).orderBy("i").collect()]
    assert got == [0.025, 0.04, 0.04, 0.025, 0.04]


def test_fdr_against_the_definition(spark):
    pick = random.Random(1)
    p = [round(pick.random() ** 3, 4) for _ in range(500)]
    df = spark.createDataFrame([("e", i, x) for i, x in enumerate(p)], "e string, i int, p_value double")
    got = [r["p_adjusted"] for r in compare.adjust_fdr(df, ["e"]).orderBy("i").collect()]
    order = sorted(range(500), key=lambda i: p[i])
    low, want = 1.0, {}
    for k in range(499, -1, -1):
        low = min(low, p[order[k]] * 500 / (k + 1))
        want[order[k]] = low
    assert all(abs(got[i] - want[i]) < 1e-12 for i in range(500))


def test_performance_change_works_for_curves_and_importances(spark):
    df = spark.createDataFrame(
        [("d", "base", "f1", 0.5, True), ("d", "other", "f1", 0.6, False)],
        "dataset string, model string, metric string, value double, is_base boolean",
    )
    assert abs(compare.performance_change(df).first()["change"] - 0.1) < 1e-12
    assert abs(compare.performance_change(df, percent=True).first()["change"] - 0.2) < 1e-12


def test_sorting_ignores_case(spark):
    df = spark.createDataFrame([("b",), ("A",), ("C",)], "model string")
    assert [r["model"] for r in compare.sorted_by_name(df).collect()] == ["A", "b", "C"]
