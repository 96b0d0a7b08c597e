"""Registered queries on ids, names, missing labels and the meaning of the classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from counterpoise.operators import explain, prepare, resample
from counterpoise.plans import ladder
from counterpoise.registry import fixtures as X
from counterpoise.registry.balancing import RATIOS, RATIOS_SQL, _counts_sql
from counterpoise.registry.explanations import MODEL, _permuted_sql, _importance_sql, _rounded_loss, _score
from counterpoise.sources.tables import task

def _two_keys():
    """A key of two columns, either of which may be null or hold the separator."""
    first = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.col("o_orderstatus"), F.lit("|"), F.col("o_orderkey").cast("string")))
    second = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("\\"), F.col("o_orderpriority"), F.lit("|")))
    return first.alias("one"), second.alias("two")


def row_ids_nulls(spark, sf):
    """Joined ids of keys with nulls and separators."""
    rows = X.table(spark, sf, "orders").select("o_totalprice", *_two_keys())
    made = task(rows, None, ["o_totalprice"], ["one", "two"])
    return made.df.select("rid", F.round("o_totalprice", 2).alias("o_totalprice"))


ROW_IDS_NULLS = r"""
SELECT coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus || '\|' || o_orderkey END, '\N') || '|' ||
       coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN '\\' || o_orderpriority || '\|' END, '\N') AS rid,
       round(o_totalprice, 2) AS o_totalprice
FROM orders
"""


def row_ids_distinct(spark, sf):
    """Without a key every row has an id of its own, equal rows and rows that differ in the place of a null included."""
    pairs = X.table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("one"), F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderstatus")).alias("two")
    )
    made = task(pairs, None, ["one", "two"]).df
    return made.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rid").alias("n_ids")).unionByName(
        made.agg(F.lit("all").alias("one"), F.lit("all").alias("two"), F.count(F.lit(1)).alias("n"), F.countDistinct("rid").alias("n_ids"))
    )


ROW_IDS_DISTINCT = """
WITH pairs AS (
  SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS one, CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS two FROM orders)
SELECT one, two, count(*) AS n, count(*) AS n_ids FROM pairs GROUP BY ALL
UNION ALL SELECT 'all', 'all', count(*), count(*) FROM pairs
"""


def reserved_names(spark, sf):
    """Features that are called like columns of the engine keep their values."""
    rows = X.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderpriority").startswith("1-").cast("int").alias("label"),
        F.col("o_custkey").alias("y"), F.col("o_totalprice").alias("split"), F.length("o_orderstatus").alias("code"), F.col("o_custkey").alias("p1"),
    )
    made = prepare.train_test_split(task(rows, "label", ["y", "split", "code", "p1"], "o_orderkey"), 0.2, X.SEED)
    y, split, code, p1 = made.features
    return made.df.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("y"), F.round(F.sum(split), 2).alias("split"), F.sum(code).alias("code"), F.sum(p1).alias("p1")
    )


RESERVED_NAMES = f"""
WITH {X.ORDERS}
SELECT u.y AS label, count(*) AS n, sum(o.o_custkey)::BIGINT AS y, round(sum(o.o_totalprice), 2) AS split,
       sum(length(o.o_orderstatus))::BIGINT AS code, sum(o.o_custkey)::BIGINT AS p1
FROM urgent u JOIN orders o ON o.o_orderkey = u.rid GROUP BY u.y
"""


def null_labels(spark, sf):
    """Rows without a label are in no part, and encode to no class."""
    rows = X.table(spark, sf, "events").withColumn("kind", F.when(F.col("user_id") % 7 != 0, (F.col("event_type") == "error").cast("int")))
    made = prepare.train_test_split(task(rows, "kind", ["value", "user_id"], "event_id"), 0.2, X.SEED)
    parts = made.df.groupBy("kind").agg(F.count("split").alias("n_split"), F.count(F.lit(1)).alias("n"))
    both = made.fitting_rows.groupBy("kind").count().unionByName(made.judging_rows.groupBy("kind").count())
    used = both.groupBy("kind").agg(F.sum("count").alias("n_used"))
    return parts.join(used, parts["kind"].eqNullSafe(used["kind"]), "left").select(F.coalesce(parts["kind"].cast("string"), F.lit("none")).alias("kind"), "n", "n_split", F.coalesce("n_used", F.lit(0)).alias("n_used"))


NULL_LABELS = """
WITH e AS (SELECT CASE WHEN user_id % 7 <> 0 THEN CASE WHEN event_type = 'error' THEN 1 ELSE 0 END END AS kind FROM events)
SELECT coalesce(kind::VARCHAR, 'none') AS kind, count(*) AS n, count(kind) AS n_split, count(kind) AS n_used FROM e GROUP BY kind
"""


def _turned(spark, sf):
    """Line items whose majority has the larger label."""
    base = X.line_items(spark, sf)
    return base.with_df(base.df.withColumn("y", 1 - F.col("y")))


def ladder_majority(spark, sf):
    """The class meaning of every variant, at ratio 1 too."""
    base = _turned(spark, sf)
    made = ladder.rebalance_ladder(base, [ladder.RANDOM_UNDER], n_per_method=5, seed=X.SEED)
    out = None
    for name in made.names:
        variant = made.task(base, name)
        counted = variant.df.agg(
            F.lit(name).alias("variant"), F.lit(variant.majority).alias("majority"),
            F.sum((F.col("y") == variant.majority).cast("bigint")).alias("n_majority"), F.count(F.lit(1)).alias("n"),
        )
        out = counted if out is None else out.unionByName(counted)
    return out.join(made.variants.select("variant", F.round("ir", 6).alias("ir")), "variant").drop("variant")


LADDER_MAJORITY = f"""
WITH {X.LINE_ITEMS}, {_counts_sql('items')},
steps AS (SELECT few, many, greatest(many::DOUBLE / few - i * ((many::DOUBLE / few - 1) / 5), 1.0::DOUBLE) AS r FROM counts, range(1, 6) t(i))
SELECT 1 AS majority, floor(few / (1 / r))::BIGINT AS n_majority, floor(few / (1 / r))::BIGINT + few AS n, round(r, 6) AS ir FROM steps
UNION ALL SELECT 1, many, many + few, round(many::DOUBLE / few, 6) FROM counts
"""


def perm_importance_train_majority(spark, sf):
    """Importance against the label that counts as the majority, which here is the larger one."""
    base = _turned(spark, sf)
    found = explain.permutation_importance(base, _score(), ["l_quantity", "l_discount", "l_tax"], seed=X.SEED, model=MODEL)
    return _rounded_loss(found)


PERM_IMPORTANCE_TRAIN_MAJORITY = f"""
WITH {X.LINE_ITEMS}, {_permuted_sql(10)}, {_importance_sql(MODEL, 10)}
SELECT model, variable, round(dropout_loss, 6) AS dropout_loss FROM i_{MODEL}
"""


def smote_n_nulls(spark, sf):
    """As many synthetic rows as asked for although categories are missing."""
    base = X.customers(spark, sf)
    blanked = base.with_df(base.df.withColumn("c_mktsegment", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))))
    made = resample.smote(blanked, RATIOS, seed=X.SEED)
    return made.groupBy("variant", "origin", "y").agg(F.count(F.lit(1)).alias("n"))


SMOTE_N_NULLS = f"""
WITH {X.CUSTOMERS}, {RATIOS_SQL}, {_counts_sql('debtors')}
SELECT variant, 'original' AS origin, y, count(*) AS n FROM debtors, ratios GROUP BY ALL
UNION ALL SELECT variant, 'synthetic', 1, floor(1 / r * many)::BIGINT - few FROM ratios, counts WHERE floor(1 / r * many)::BIGINT > few
"""


QUERIES = {
    "row_ids_nulls": (row_ids_nulls, ROW_IDS_NULLS),
    "row_ids_distinct": (row_ids_distinct, ROW_IDS_DISTINCT),
    "reserved_names": (reserved_names, RESERVED_NAMES),
    "null_labels": (null_labels, NULL_LABELS),
    "ladder_majority": (ladder_majority, LADDER_MAJORITY),
    "perm_importance_train_majority": (perm_importance_train_majority, PERM_IMPORTANCE_TRAIN_MAJORITY),
    "smote_n_nulls": (smote_n_nulls, SMOTE_N_NULLS),
}
