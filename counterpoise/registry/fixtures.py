"""The driver's tables as tasks, and the SQL that defines the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpoise.sources.tables import task
from counterpoise.task import Task
from counterpoise.workspace import dealt_out

SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_items(spark: SparkSession, sf_dir: str) -> Task:
    rows = dealt_out(table(spark, sf_dir, "lineitem"))
    returned = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
    keyed = rows.withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    return task(
        keyed.withColumn("y", returned.cast("int")),
        "y",
        ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "cents"],
        "lineitem",
    )


LINE_ITEMS = """
items AS (
  SELECT concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT)) AS rid,
         l_quantity, l_extendedprice, l_discount, l_tax,
         CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 1 ELSE 0 END AS y
  FROM lineitem
)"""


def orders(spark: SparkSession, sf_dir: str) -> Task:
    rows = table(spark, sf_dir, "orders")
    urgent = F.col("o_orderpriority").startswith("1-").cast("int")
    return task(rows.withColumn("y", urgent), "y", ["o_totalprice", "o_orderstatus"], "o_orderkey", "orders")


ORDERS = """
urgent AS (
  SELECT o_orderkey AS rid, o_totalprice, o_orderstatus,
         CASE WHEN o_orderpriority LIKE '1-%' THEN 1 ELSE 0 END AS y
  FROM orders
)"""


def events(spark: SparkSession, sf_dir: str) -> Task:
    rows = table(spark, sf_dir, "events")
    failed = (F.col("event_type") == "error").cast("int")
    return task(rows.withColumn("y", failed), "y", ["value", "user_id"], "event_id", "events")


EVENTS = """
failed AS (
  SELECT event_id AS rid, value, user_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y FROM events
)"""


def toxic_documents(spark: SparkSession, sf_dir: str) -> Task:
    marks = table(spark, sf_dir, "labels")
    texts = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    rows = marks.join(texts, "doc_id").withColumn("y", (F.col("toxic") == 1).cast("int"))
    return task(rows, "y", ["n_chars", "lang", "source", "quality"], "doc_id", "documents")


TOXIC = """
toxic_documents AS (
  SELECT l.doc_id AS rid, d.n_chars, d.lang, d.source, l.quality, CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END AS y
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
)"""


def embeddings(spark: SparkSession, sf_dir: str) -> Task:
    rows = table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") == 0).cast("int"))
    return task(rows, "y", ["embedding"], "vec_id", "embeddings")


EMBEDDINGS = """
vectors AS (
  SELECT vec_id AS rid, CAST(embedding AS DOUBLE[]) AS vec, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y FROM embeddings
)"""


def parts(spark: SparkSession, sf_dir: str) -> Task:
    rows = table(spark, sf_dir, "part").withColumn("y", (F.col("p_size") <= 5).cast("int"))
    return task(rows, "y", ["p_retailprice", "p_brand", "p_type"], "p_partkey", "part")


PARTS = """
small_parts AS (
  SELECT p_partkey AS rid, p_retailprice, p_brand, p_type, CASE WHEN p_size <= 5 THEN 1 ELSE 0 END AS y FROM part
)"""


def customers(spark: SparkSession, sf_dir: str) -> Task:
    rows = table(spark, sf_dir, "customer").withColumn("y", (F.col("c_acctbal") < 0).cast("int"))
    return task(rows, "y", ["c_mktsegment", "c_nationkey"], "c_custkey", "customer")


CUSTOMERS = """
debtors AS (
  SELECT c_custkey AS rid, c_mktsegment, c_nationkey, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS y FROM customer
)"""


def sql_draw(tag: str, *keys: str, seed: int = SEED) -> str:
    """The SQL twin of ``functions.draws.draw``."""
    listed = ", ".join(keys)
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', '{tag}', {listed})), 1, 15) AS BIGINT)"


def sql_uniform(tag: str, *keys: str) -> str:
    return f"({sql_draw(tag, *keys)} / 1152921504606846976.0::DOUBLE)"


# Scores as expressions: only + - * / and abs, so that every engine agrees to the last bit.
SCORE_WEIGHTS = {
    "original": (0.02, 6.0, 10.0, 0.4),
    "under": (0.03, 4.0, 12.0, 0.7),
    "over": (0.015, 8.0, 6.0, 0.2),
    "near": (0.05, -3.0, 9.0, 1.1),
}


def score_of(model: str) -> Column:
    """A squashed linear score with one interaction, in (0, 1)."""
    quantity, discount, tax, mixed = SCORE_WEIGHTS[model]
    z = (
        F.lit(quantity) * (F.col("l_quantity") - F.lit(25.0))
        + F.lit(discount) * (F.col("l_discount") - F.lit(0.05))
        - F.lit(tax) * F.col("l_tax")
        + F.lit(mixed) * (F.col("l_quantity") * F.col("l_discount") - F.lit(1.0))
    )
    return F.lit(0.5) + F.lit(0.5) * z / (F.lit(1.0) + F.abs(z))


def sql_score(model: str, quantity="l_quantity", discount="l_discount", tax="l_tax") -> str:
    a, b, c, d = (f"{w}::DOUBLE" for w in SCORE_WEIGHTS[model])
    z = (
        f"({a} * ({quantity} - 25.0::DOUBLE) + {b} * ({discount} - 0.05::DOUBLE) - {c} * {tax}"
        f" + {d} * ({quantity} * {discount} - 1.0::DOUBLE))"
    )
    return f"(0.5::DOUBLE + 0.5::DOUBLE * {z} / (1.0::DOUBLE + abs({z})))"
