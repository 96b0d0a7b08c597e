"""Shared intermediate tables.

Expensive results that several later jobs read (neighbour tables, indexed
minority rows, fitted-model scores) are written once to the folder the cluster
names in ``spark.checkpoint.dir``.  A written table cuts the lineage, survives
the loss of executors, keeps column pruning, and carries file sizes that the
optimizer checks before it decides to broadcast.
"""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPREAD_ROWS = 50_000_000
FIT_ROWS = 100_000

_SETTING = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables, visible to every executor."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        _local_folders[app] = tempfile.mkdtemp(prefix="counterpoise-")
    return _local_folders[app]


def materialize(df: DataFrame, name: str = "table", partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    ``partition_by`` columns become directories, so that later reads of one
    value skip the others.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, n_rows: int) -> DataFrame:
    """Deal a short frame out to all cores before heavy per-row work.

    A long frame already comes in many partitions and is not moved.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if n_rows <= SPREAD_ROWS else df


def dealt_out(scan: DataFrame) -> DataFrame:
    """Spread a file scan that has fewer partitions than the cluster has cores.

    Only short inputs (few files, few row groups) are moved; a long one already
    comes in enough scan partitions and is returned as it is.
    """
    slots = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= slots else scan.repartition(slots)


def cut_by_rows(rows: DataFrame, n_rows: int) -> DataFrame:
    """At most about ``FIT_ROWS`` rows a partition for fits that keep decoded rows.

    Scan partitions are sized in bytes, and a byte of a well compressed file may
    decode to hundreds; a frame that is short enough is returned as it is.
    """
    needed = -(-n_rows // FIT_ROWS)
    return rows if rows.rdd.getNumPartitions() >= needed else rows.repartition(needed)


def small_table(spark: SparkSession, columns: dict[str, Sequence[int]]) -> DataFrame:
    """Whole numbers of the driver as a table, handed over in Arrow: no Python worker is started to read them."""
    return spark.createDataFrame(pa.table({name: pa.array(values, pa.int32()) for name, values in columns.items()}))


def salted_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """Join with a small-per-key table when one key may hold a large share of ``rows``.

    Rows of a key are dealt over salts by the partition they lie in; the table is
    copied once per salt.
    """
    left = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def run_jobs(jobs: Sequence[Callable[[], Any]], concurrency: int = 4) -> list:
    """Submit Spark work from a bounded number of driver threads; order is kept."""
    with ThreadPoolExecutor(max_workers=concurrency) as pool:
        return list(pool.map(lambda job: job(), jobs))


def drop_tables(spark: SparkSession) -> int:
    """Delete the tables this application materialized; returns how many."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    return len(paths)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="counterpoise-zip-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
