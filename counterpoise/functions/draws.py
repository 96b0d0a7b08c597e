"""Deterministic pseudo-random numbers derived from row keys.

A draw depends only on (seed, tag, key), never on partitioning, task order or
recomputation after a lost executor, and every SQL engine with ``md5`` can
repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DRAW_BITS = 60
DRAW_RANGE = float(2**DRAW_BITS)


def draw(seed: int, tag: str, *keys: Column) -> Column:
    """Uniform integer in [0, 2**60) for the integer or string ``keys``."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def uniform(seed: int, tag: str, *keys: Column) -> Column:
    """Uniform double in [0, 1)."""
    return draw(seed, tag, *keys).cast("double") / F.lit(DRAW_RANGE)


def with_draw(df: DataFrame, name: str, order: Column) -> DataFrame:
    """Add a draw that is hashed exactly once per row.

    A one-element generator keeps filters on the draw above it; pushed below,
    they would repeat the hashing once per comparison.
    """
    return df.select("*", F.explode(F.array(order)).alias(name))
