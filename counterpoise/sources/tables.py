"""Tasks from tables, CSV files and directories."""

from __future__ import annotations

import io
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpoise.task import LABELS_ALLOWED, RID, Task, TaskSet, stored_names
from counterpoise.workspace import run_jobs, ship_package

COPIES_PER_ROW = 1_000_000


def _key_part(name: str) -> Column:
    """A key column as text in which ``|`` and null can't be mistaken for anything else."""
    text = F.replace(F.replace(F.col(name).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.coalesce(text, F.lit("\\N"))


def row_ids(df: DataFrame, key: Sequence[str] | None) -> DataFrame:
    """Add the unique ``rid``: the key itself, joined key columns, or a row hash.

    Joined key columns are escaped, so different keys never give one id. The row
    hash covers which columns are null, as hashing passes over nulls.

    Without a key, equal rows are counted first (partial aggregation, so copies
    of one row never meet in one task) and then numbered while being expanded
    again in chunks that are spread over the cluster.
    """
    if key:
        if len(key) == 1:
            return df if key[0] == RID else df.withColumn(RID, F.col(key[0]))
        return df.withColumn(RID, F.concat_ws("|", *[_key_part(k) for k in key]))
    names = df.columns
    spark = df.sparkSession
    counted = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies"))
    chunks = counted.withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / COPIES_PER_ROW)))
    )
    spread = chunks.repartition(spark.sparkContext.defaultParallelism * 4, F.xxhash64(*names), F.col("_chunk"))
    first = F.col("_chunk") * COPIES_PER_ROW
    last = F.least(F.col("_copies"), first + COPIES_PER_ROW) - 1
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in names])
    digest = F.concat(F.hex(F.xxhash64(nulls, *names)), F.hex(F.xxhash64(F.lit("second"), nulls, *names)))
    return spread.withColumn("_copy", F.explode(F.sequence(first, last))).select(
        *names, F.concat_ws("|", digest, F.col("_copy").cast("string")).alias(RID)
    )


def task(
    df: DataFrame,
    label: str | None,
    features: Sequence[str] | None = None,
    key: Sequence[str] | str | None = None,
    name: str = "dataset",
    categorical: Sequence[str] | None = None,
    majority=None,
    check_key: bool = False,
) -> Task:
    """A task from any DataFrame. Features default to all non-key, non-label columns.

    Columns whose names operators use themselves (``RESERVED``) are kept under
    another name. ``check_key`` counts the ids and refuses a key that repeats.
    """
    key = [key] if isinstance(key, str) else list(key or [])
    if features is None:
        features = [c for c in df.columns if c != label and c not in key and c != RID]
    features = list(features)
    stored = stored_names(features, [label] if label else [])
    if label:
        stored = {**stored, **stored_names([label], stored.values(), LABELS_ALLOWED)}
    keyed = row_ids(df.select(*key, *features, *([label] if label else [])) if not key else df, key)
    own_ids = key == [RID]
    columns = [F.col(RID), *[F.col(c).alias(stored[c]) for c in features]] + ([F.col(label).alias(stored[label])] if label else [])
    if RID in features and not own_ids:
        # The id column replaced the feature of this name: take the feature from before.
        keyed = row_ids(df.withColumnRenamed(RID, stored[RID]), key) if key else keyed
        columns = [F.col(RID), *[F.col(stored[c] if c == RID else c).alias(stored[c]) for c in features]] + columns[1 + len(features) :]
    if check_key and (repeated := keyed.groupBy(RID).count().where("count > 1").limit(1).collect()):
        raise ValueError(f"the key of {name} repeats, e.g. {repeated[0][RID]}")
    return Task(
        name=name,
        df=keyed.select(*columns),
        features=tuple(stored[c] for c in features),
        label=stored[label] if label else None,
        categorical=None if categorical is None else tuple(stored.get(c, c) for c in categorical),
        majority=majority,
    )


def from_csv(spark: SparkSession, path: str, target: str | None = None, name: str = "dataset", **options) -> Task:
    """CSV source; the label is ``target`` or the last column, renamed ``target``."""
    settings = {"header": "true", "inferSchema": "true", **options}
    df = spark.read.options(**settings).csv(path)
    return _labelled(df, target, name)


def _labelled(df: DataFrame, target: str | None, name: str) -> Task:
    label = target if target is not None else df.columns[-1]
    if label not in df.columns:
        raise ValueError(f"no column {label} in {name}")
    return task(df.withColumnRenamed(label, "target"), "target", name=name)


def _list_files(spark: SparkSession, path: str) -> list[str]:
    """File names of a directory, through the Hadoop file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        raise FileNotFoundError(path)
    if not fs.getFileStatus(target).isDirectory():
        raise NotADirectoryError(path)
    found = [s.getPath().toString() for s in fs.listStatus(target) if s.isFile()]
    return sorted(found)


def from_directory(spark: SparkSession, path: str, name: str = "tasks", **options) -> TaskSet:
    """One task per ``*.csv`` and numeric ``*.npy`` file; other files are ignored."""
    def reader(file, stem):
        if stem.endswith(".csv"):
            return lambda: from_csv(spark, file, name=stem[: -len(".csv")], **options)
        return lambda: from_npy(spark, file, stem[: -len(".npy")])

    ship_package(spark)
    files = [(f, f.rsplit("/", 1)[-1]) for f in _list_files(spark, path)]
    jobs = [reader(f, stem) for f, stem in files if stem.endswith((".csv", ".npy"))]
    return TaskSet.of(run_jobs(jobs), name)


def from_npy(spark: SparkSession, path: str, name: str = "dataset") -> Task:
    """Numeric 2-D ``.npy`` file; the last column is the label. One file is one Spark task."""
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path)
    width = files.mapInPandas(_npy_width, "width int").first()["width"]
    names = [f"c{i}" for i in range(width - 1)] + ["target"]

    def rows(batches):
        for batch in batches:
            for content in batch["content"]:
                yield pd.DataFrame(_load(content).astype("float64"), columns=names)

    df = files.select("content").mapInPandas(rows, ", ".join(f"{c} double" for c in names))
    return task(df, "target", name=name)


def _load(content: bytes) -> np.ndarray:
    values = np.load(io.BytesIO(content), allow_pickle=False)
    if values.ndim != 2:
        raise ValueError("expected a two-dimensional array")
    return values


def _npy_width(batches):
    for batch in batches:
        for content in batch["content"]:
            yield pd.DataFrame({"width": [_load(content).shape[1]]})
