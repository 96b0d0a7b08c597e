"""Registered queries: sources, cleaning, splitting and describing."""

from __future__ import annotations

from pyspark.sql import functions as F

from counterpoise.operators import collection, prepare
from counterpoise.registry import fixtures as X
from counterpoise.sources.tables import from_csv, from_directory, task
from counterpoise.task import TaskSet
from counterpoise.workspace import shared_folder


def _five(spark, sf):
    return TaskSet.of(
        [X.line_items(spark, sf), X.orders(spark, sf), X.events(spark, sf), X.toxic_documents(spark, sf), X.parts(spark, sf)]
    )


_FIVE = (("lineitem", "items", 4), ("orders", "urgent", 2), ("events", "failed", 2), ("documents", "toxic_documents", 4), ("part", "small_parts", 3))
_FIVE_CTES = ",".join([X.LINE_ITEMS, X.ORDERS, X.EVENTS, X.TOXIC, X.PARTS])


def imbalance_stats(spark, sf):
    return collection.stats(_five(spark, sf)).withColumn("ir", F.round("ir", 6)).drop("position")


def _stats_sql():
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS name, count(*) AS nrow, {ncol} AS ncol,
            sum(y) AS pos, count(*) - sum(y) AS neg FROM {cte}"""
        for name, cte, ncol in _FIVE
    )


IMBALANCE_STATS = f"""
WITH {_FIVE_CTES}, s AS ({_stats_sql()})
SELECT name, round(CAST(greatest(pos, neg) AS DOUBLE) / least(pos, neg), 6) AS ir, nrow, ncol,
       CAST(2 AS BIGINT) AS n_classes, CASE WHEN neg >= pos THEN '0' ELSE '1' END AS majority
FROM s
"""


def select_tasks(spark, sf):
    """Statistics of two sources that share task names; the first source wins."""
    continuous = {"lineitem": 4, "orders": 1, "events": 1, "documents": 0, "part": 1}
    tasks = _five(spark, sf)
    shares = F.create_map(*[F.lit(x) for pair in continuous.items() for x in pair])
    one = collection.stats(tasks).withColumn("source", F.lit(1))
    two = collection.stats(tasks.subset(["orders", "part"])).withColumn("source", F.lit(2))
    table = one.where(F.col("name") != "orders").unionByName(two).withColumn("ncol_continuous", shares[F.col("name")])
    chosen = collection.select_tasks(table, min_ir=1.5, min_rows=1000, exclude=["events"], max_categorical_frac=0.75)
    return chosen.select("source", "name", F.round("ir", 6).alias("ir"), "nrow", "ncol", "ncol_continuous")


SELECT_TASKS = f"""
WITH {_FIVE_CTES}, s AS ({_stats_sql()}),
c(name, ncol_continuous) AS (VALUES ('lineitem', 4), ('orders', 1), ('events', 1), ('documents', 0), ('part', 1)),
both_sources AS (
  SELECT 1 AS source, * FROM s WHERE name <> 'orders' UNION ALL SELECT 2, * FROM s WHERE name IN ('orders', 'part')
),
passing AS (
  SELECT *, greatest(pos, neg)::DOUBLE / least(pos, neg) AS ir, row_number() OVER (PARTITION BY name ORDER BY source) AS rn
  FROM both_sources
  WHERE greatest(pos, neg)::DOUBLE / least(pos, neg) >= 1.5 AND nrow >= 1000 AND name <> 'events'
)
SELECT source, p.name, round(ir, 6) AS ir, nrow, ncol, ncol_continuous
FROM passing p JOIN c ON p.name = c.name WHERE rn = 1 AND ncol_continuous::DOUBLE / ncol >= 0.25
"""


def profile_columns(spark, sf):
    rows = X.table(spark, sf, "part")
    described = task(rows, "p_type", ["p_retailprice", "p_size", "p_brand"], "p_partkey", "part")
    out = prepare.profile(described, exact_percentiles=True)
    rounded = ["mean", "std", "min", "max", "q1", "median", "q3"]
    return out.withColumns({c: F.round(c, 6) for c in rounded})


PROFILE_COLUMNS = """
WITH long AS (
  SELECT 'p_retailprice' AS "column", p_retailprice AS number, CAST(p_retailprice AS VARCHAR) AS text FROM part
  UNION ALL SELECT 'p_size', CAST(p_size AS DOUBLE), CAST(p_size AS VARCHAR) FROM part
  UNION ALL SELECT 'p_brand', NULL, p_brand FROM part
  UNION ALL SELECT 'p_type', NULL, p_type FROM part
),
counted AS (SELECT "column", text, count(*) AS n FROM long WHERE text IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, text) AS r FROM counted),
best AS (SELECT "column", string_agg(text || '=' || n, ', ' ORDER BY r) AS top_values FROM ranked WHERE r <= 3 GROUP BY 1),
dist AS (SELECT "column", count(*) AS n_distinct FROM counted GROUP BY 1),
basic AS (
  SELECT "column", count(*) AS n, sum(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS n_missing,
         round(avg(number), 6) AS mean, round(stddev_samp(number), 6) AS std,
         round(min(number), 6) AS min, round(max(number), 6) AS max,
         sum(CASE WHEN number = 0 THEN 1 WHEN number IS NOT NULL THEN 0 END) AS n_zero,
         round(quantile_cont(number, 0.25), 6) AS q1, round(quantile_cont(number, 0.5), 6) AS median,
         round(quantile_cont(number, 0.75), 6) AS q3
  FROM long GROUP BY 1
)
SELECT b.*, n_distinct, top_values FROM basic b JOIN dist d ON b."column" = d."column" JOIN best t ON b."column" = t."column"
"""


def column_correlations(spark, sf):
    return prepare.correlations(X.line_items(spark, sf)).withColumn("corr", F.round("corr", 6))


COLUMN_CORRELATIONS = f"""
WITH {X.LINE_ITEMS}
""" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM items"
    for a, b in (
        ("l_quantity", "l_extendedprice"),
        ("l_quantity", "l_discount"),
        ("l_quantity", "l_tax"),
        ("l_extendedprice", "l_discount"),
        ("l_extendedprice", "l_tax"),
        ("l_discount", "l_tax"),
    )
)


def drop_missing(spark, sf):
    """Values are blanked by ``nullif``: one column almost fully, one a little, and some labels."""
    rows = X.table(spark, sf, "events")
    blanked = rows.select(
        "event_id",
        F.when(F.col("value") > 120, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
        F.when(F.col("value") > 200, F.col("value")).alias("rare"),
        F.nullif(F.col("user_id"), F.lit(3)).alias("user_id"),
        F.nullif(F.col("event_type"), F.lit("view")).alias("y"),
    )
    out = prepare.remove_missing(task(blanked, "y", ["value", "rare", "user_id"], "event_id"), 0.9)
    return out.df


DROP_MISSING = """
SELECT event_id AS rid, value, user_id, event_type AS y FROM events
WHERE value <= 120 AND user_id <> 3 AND event_type <> 'view'
"""


def drop_outliers(spark, sf):
    return prepare.remove_outliers(X.line_items(spark, sf), 1.2).df.select("rid", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _outlier_steps(names, n):
    steps, last = [], "items"
    for i, c in enumerate(names):
        steps.append(
            f"k{i} AS (SELECT * FROM {last} WHERE {c} BETWEEN (SELECT avg({c}) - {n} * stddev_samp({c}) FROM {last})"
            f" AND (SELECT avg({c}) + {n} * stddev_samp({c}) FROM {last}))"
        )
        last = f"k{i}"
    return ", ".join(steps), last


_STEPS, _LAST = _outlier_steps(("l_quantity", "l_extendedprice", "l_discount", "l_tax"), 1.2)
DROP_OUTLIERS = f"WITH {X.LINE_ITEMS}, {_STEPS} SELECT rid, l_quantity, l_extendedprice, l_discount, l_tax FROM {_LAST}"


def strat_split(spark, sf):
    return prepare.train_test_split(X.events(spark, sf), 0.2, X.SEED).df.select("rid", "y", "split")


STRAT_SPLIT = f"""
WITH {X.EVENTS},
n AS (SELECT y, count(*) AS c FROM failed GROUP BY y),
total AS (SELECT sum(c)::BIGINT AS t, (sum(c) - ceil(0.2 * sum(c)))::BIGINT AS tr FROM n),
shares AS (SELECT y, c, tr * c::DOUBLE / t AS exact, floor(tr * c::DOUBLE / t)::BIGINT AS base, tr FROM n, total),
extra AS (SELECT *, row_number() OVER (ORDER BY exact - base DESC, y) AS r, tr - sum(base) OVER () AS left_over FROM shares),
quota AS (SELECT y, base + CASE WHEN r <= left_over THEN 1 ELSE 0 END AS q FROM extra),
ranked AS (SELECT rid, y, row_number() OVER (PARTITION BY y ORDER BY {X.sql_draw('split', 'rid')}, rid) AS rn FROM failed)
SELECT r.rid, r.y, CASE WHEN rn <= q THEN 'train' ELSE 'test' END AS split FROM ranked r JOIN quota USING (y)
"""


def custom_split(spark, sf):
    """A predicate split, its parts, and the split-aware ratio (train part only)."""
    base = X.orders(spark, sf)
    cut = prepare.split_by(base, F.col("o_totalprice") < 400000.0)
    return cut.df.groupBy("split", "y").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "train_ir", F.round(F.lit(prepare.imbalance_ratio(cut)), 6)
    )


CUSTOM_SPLIT = f"""
WITH {X.ORDERS}, s AS (SELECT CASE WHEN o_totalprice < 400000 THEN 'train' ELSE 'test' END AS split, y FROM urgent),
c AS (SELECT split, y, count(*) AS n FROM s GROUP BY ALL)
SELECT split, y, n, round((SELECT max(n)::DOUBLE / min(n) FROM c WHERE split = 'train'), 6) AS train_ir FROM c
"""


def numeric_only(spark, sf):
    rows = X.table(spark, sf, "customer").withColumn("y", (F.col("c_acctbal") < 0).cast("int"))
    whole = task(rows, "y", ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "c_custkey")
    return prepare.drop_categorical(whole).df


NUMERIC_ONLY = """
SELECT c_custkey AS rid, c_name, c_acctbal, c_mktsegment, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS y FROM customer
"""


def cast_numeric(spark, sf):
    return prepare.to_double(X.customers(spark, sf)).df


CAST_NUMERIC = f"WITH {X.CUSTOMERS} SELECT rid, c_mktsegment, CAST(c_nationkey AS DOUBLE) AS c_nationkey, y FROM debtors"


def drop_prefixed(spark, sf):
    rows = X.table(spark, sf, "part").withColumn("y", (F.col("p_size") <= 5).cast("int"))
    whole = task(rows.withColumnRenamed("p_type", "type"), "y", ["p_name", "p_brand", "type", "p_retailprice"], "p_partkey")
    return prepare.drop_prefixed(whole, "p_", keep=["p_brand"]).df


DROP_PREFIXED = 'SELECT p_partkey AS rid, p_brand, p_type AS "type", CASE WHEN p_size <= 5 THEN 1 ELSE 0 END AS y FROM part'


def head_rows(spark, sf):
    return prepare.head(X.customers(spark, sf), 10).df


HEAD_ROWS = f"WITH {X.CUSTOMERS} SELECT * FROM debtors ORDER BY rid LIMIT 10"


def task_filter(spark, sf):
    """Non-binary and empty members are removed; the rest is reported."""
    from dataclasses import replace

    many = task_of_types(spark, sf)
    none = replace(X.parts(spark, sf), name="nothing")
    none = none.with_df(none.df.where(F.col("p_retailprice") < 0))
    tasks = TaskSet.of([X.customers(spark, sf), many, none, X.parts(spark, sf)])
    kept = collection.without_empty(collection.without_non_binary(tasks))
    return collection.stats(kept).select("name", "nrow")


def task_of_types(spark, sf):
    return task(X.table(spark, sf, "events"), "event_type", ["value", "user_id"], "event_id", "many")


TASK_FILTER = """
SELECT 'customer' AS name, count(*) AS nrow FROM customer UNION ALL SELECT 'part', count(*) FROM part
"""


def task_union(spark, sf):
    """Union of two task sets, subset by name, long form with differing schemas."""
    left = TaskSet.of([X.customers(spark, sf), X.events(spark, sf)])
    right = TaskSet.of([X.parts(spark, sf)])
    both = left.union(right).subset(["customer", "part", "unknown"])
    return both.long().select("dataset", "rid", "y", "c_mktsegment", "p_brand")


TASK_UNION = f"""
WITH {X.CUSTOMERS}, {X.PARTS}
SELECT 'customer' AS dataset, rid, y, c_mktsegment, NULL::VARCHAR AS p_brand FROM debtors
UNION ALL SELECT 'part', rid, y, NULL, p_brand FROM small_parts
"""


def same_rows(spark, sf):
    """Multiset difference of a table and its deduplicated projection."""
    rows = X.table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax")
    return prepare.row_differences(rows, rows.distinct())


SAME_ROWS = """
SELECT l_quantity, l_discount, l_tax, count(*) - 1 AS surplus FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1
"""


def csv_source(spark, sf):
    """A table is written as CSV by Spark and read back as a task (label = last column)."""
    import uuid

    rows = X.table(spark, sf, "customer").select(
        "c_custkey", "c_mktsegment", "c_nationkey", (F.col("c_acctbal") < 0).cast("int").alias("debt")
    )
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    rows.write.option("header", True).csv(path)
    return from_csv(spark, path).df.groupBy("c_mktsegment", "target").agg(
        F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"), F.count_distinct("rid").alias("n_ids")
    )


CSV_SOURCE = """
SELECT c_mktsegment, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS target, count(*) AS n, sum(c_custkey)::BIGINT AS keys,
       count(*) AS n_ids
FROM customer GROUP BY ALL
"""


def directory_source(spark, sf):
    """One CSV file per market segment in one directory; one task per file."""
    import uuid

    rows = X.table(spark, sf, "customer").select(
        "c_mktsegment", "c_custkey", "c_nationkey", (F.col("c_acctbal") < 0).cast("int").alias("debt")
    )
    path = f"{shared_folder(spark)}/dir-{uuid.uuid4().hex}"
    rows.repartition(5, "c_mktsegment").sortWithinPartitions("c_mktsegment").drop("c_mktsegment").write.option(
        "header", True
    ).csv(path)
    tasks = from_directory(spark, path)
    return collection.stats(tasks).agg(F.sum("nrow").alias("nrow"), F.max("ncol").alias("ncol"))


DIRECTORY_SOURCE = "SELECT count(*) AS nrow, 2 AS ncol FROM customer"

QUERIES = {
    "imbalance_stats": (imbalance_stats, IMBALANCE_STATS),
    "select_tasks": (select_tasks, SELECT_TASKS),
    "profile_columns": (profile_columns, PROFILE_COLUMNS),
    "column_correlations": (column_correlations, COLUMN_CORRELATIONS),
    "drop_missing": (drop_missing, DROP_MISSING),
    "drop_outliers": (drop_outliers, DROP_OUTLIERS),
    "strat_split": (strat_split, STRAT_SPLIT),
    "custom_split": (custom_split, CUSTOM_SPLIT),
    "numeric_only": (numeric_only, NUMERIC_ONLY),
    "cast_numeric": (cast_numeric, CAST_NUMERIC),
    "drop_prefixed": (drop_prefixed, DROP_PREFIXED),
    "head_rows": (head_rows, HEAD_ROWS),
    "task_filter": (task_filter, TASK_FILTER),
    "task_union": (task_union, TASK_UNION),
    "same_rows": (same_rows, SAME_ROWS),
    "csv_source": (csv_source, CSV_SOURCE),
    "directory_source": (directory_source, DIRECTORY_SOURCE),
}
