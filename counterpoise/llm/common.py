"""What several operators of this package share: words, folds and row keys."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpoise.workspace import ship_package

# Bytes of UTF-8 that belong to a word: digits, lower-case letters after folding A-Z, everything beyond ASCII.
_WORD_BYTES = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
_FOLD = bytes(b if b in _WORD_BYTES else 0x20 for b in bytes(range(256)).lower())


def words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, then runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text modulo ``n``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(n)).cast("int")


def held_out(id_col: str, n: int, remainder: int) -> Column:
    """True where the fold is ``remainder``; a row without an id is not held out."""
    return F.coalesce(fold(id_col, n) == remainder, F.lit(False))


def learnable(id_col: str, n: int, remainder: int) -> Column:
    """True where the fold is known and is not ``remainder``."""
    return F.coalesce(fold(id_col, n) != remainder, F.lit(False))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet, one for each wanted name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        free = next(n for n in itertools.chain([name], (f"{name}_{i}" for i in itertools.count(1))) if n.lower() not in taken)
        taken.add(free.lower())
        out.append(free)
    return out


ROWS_AT_ONCE = 1000

Batches = Iterator[pa.RecordBatch]


def map_batches(df: DataFrame, function: Callable[[Batches], Batches], schema) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors.

    The function gets views of few rows, so that only their texts become Python
    objects at a time, however many rows Spark hands over at once.
    """
    ship_package(df.sparkSession)

    def in_views(batches: Batches) -> Batches:
        return function(batch.slice(at, ROWS_AT_ONCE) for batch in batches for at in range(0, batch.num_rows, ROWS_AT_ONCE))

    return df.mapInArrow(in_views, schema)


def sha256_of(values: Column) -> Column:
    return F.sha2(F.coalesce(values, F.lit("")), 256)


def pack_whole(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest of them takes (1, 2, 4 or 8)."""
    largest = int(values.max(initial=0))
    return values.astype(next(f"<u{b}" for b in (1, 2, 4, 8) if largest < 1 << 8 * b)).tobytes()


def unpack_whole(data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that ``pack_whole`` packed."""
    return np.frombuffer(data, f"<u{len(data) // n}" if n else "<u1").astype(np.int64)
