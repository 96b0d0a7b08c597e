"""Mixing of sources to target weights by iterative proportional fitting.

Documents are summed to cells, one for each combination of the values of the
dimensions (source, language, topic).  The token weights of the cells are raked:
scaled to the target share of every value of one dimension after the other, again
and again, until all marginals agree.  The quotient of raked and observed tokens
of a cell, times one factor for the wanted amount of tokens, is the probability
with which each of its documents is drawn.

Cells are a table like any other: a sweep is a sum by value and a join for each
dimension, and its result is written.  The draw is a hash of the id, so a document
is drawn or not whatever the partitions are.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.llm import common
from counterpoise.workspace import materialize

NULL = "(null)"
SWEEPS = 8
KEEP_SHARE = 0.8
CALIBRATION_STEPS = 8
SEED = "mix"
GROUPS = 4
LONG_WORD = 5
WORDS = r"[^\x20\x09-\x0D]+"


def value(name: str) -> Column:
    """A dimension as text; null is a value of its own."""
    return F.coalesce(F.col(name).cast("string"), F.lit(NULL))


def with_facts(docs: DataFrame, text: str, tokens: str, topic: str) -> DataFrame:
    """Adds the number of words and the vocabulary group that most long words belong to.

    A word of five letters or more belongs to group (code point of its first letter
    + length) mod 4; the smaller group wins ties; texts without such words are
    ``none``.
    """
    (found,) = common.fresh(docs, "_found")
    split = docs.withColumn(found, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORDS), F.lit(0)))
    (groups,) = common.fresh(split, "_groups")
    long_words = F.filter(found, lambda w: F.length(w) >= LONG_WORD)
    split = split.withColumn(groups, F.transform(long_words, lambda w: (F.ascii(w) + F.length(w)) % GROUPS))
    counts = [F.size(F.filter(groups, _is(i))) for i in range(GROUPS)]
    most = F.greatest(*counts)
    named = F.when(F.size(groups) == 0, "none")
    for i, n in enumerate(counts):
        named = named.when(n == most, f"group{i}")
    return split.withColumn(tokens, F.size(found).cast("bigint")).withColumn(topic, named).drop(found, groups)


def _is(group: int) -> Callable[[Column], Column]:
    return lambda g: g == group


def cells(rows: DataFrame, dims: Sequence[str], tokens: str) -> DataFrame:
    """Tokens of each combination of values; combinations without tokens are left out."""
    summed = rows.groupBy(*[value(d).alias(d) for d in dims]).agg(F.sum(tokens).cast("double").alias("tokens")).where("tokens > 0")
    return materialize(summed, "cells")


def rake(table: DataFrame, targets: Mapping[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """``table`` (dimensions and ``tokens``) with ``weight``: raked tokens, as many as there were.

    ``targets`` has for each dimension a table of value and ``share``.  Shares are
    taken in proportion over the values that occur.  A value without a target keeps
    the share that it has; the targets share the rest.
    """
    total = table.agg(F.sum("tokens")).first()[0] or 0.0
    goals = {}
    for dim, wanted in targets.items():
        known = table.groupBy(dim).agg(F.sum("tokens").alias("has")).join(wanted.select(value(dim).alias(dim), F.col("share").cast("double")), dim, "left")
        sums = known.agg(F.sum("share"), F.sum(F.when(F.col("share").isNull(), F.col("has")))).first()
        free = total - (sums[1] or 0.0)
        goals[dim] = materialize(known.select(dim, F.coalesce(F.col("share") / F.lit(sums[0] or 1.0) * free, "has").alias("goal")), "goal")
    raked = table.withColumn("weight", F.col("tokens"))
    for _ in range(sweeps):
        for dim, goal in goals.items():
            has = raked.groupBy(dim).agg(F.sum("weight").alias("has")).join(goal, dim).select(dim, (F.col("goal") / F.col("has")).alias("factor"))
            raked = raked.join(has, dim).withColumn("weight", F.col("weight") * F.col("factor")).select(*table.columns, "weight")
        raked = materialize(raked, "raked")
    return raked


def probabilities(raked: DataFrame, keep_share: float = KEEP_SHARE, steps: int = CALIBRATION_STEPS) -> DataFrame:
    """``raked`` with ``probability``: min(1, factor * weight / tokens).

    The factor is fitted in a few steps so that ``keep_share`` of all tokens is
    expected to stay, although no probability passes 1.
    """
    ratio = F.col("weight") / F.col("tokens")
    total = raked.agg(F.sum("tokens")).first()[0]
    if total is None:
        return raked.withColumn("probability", F.lit(0.0))
    factor = keep_share
    for _ in range(steps):
        kept = raked.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), ratio * F.lit(factor)))).first()[0]
        factor = factor * keep_share * total / kept if kept else factor
    return raked.withColumn("probability", F.least(F.lit(1.0), ratio * F.lit(factor)))


def draw(id_col: str, text: str, seed: str = SEED) -> Column:
    """Uniform number in [0, 1) of an id, or of the text where the id is null."""
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text).cast("binary")), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key).cast("binary")), 1, 13), 16, 10).cast("double") / float(16**13)


Targets = Callable[[DataFrame], Mapping[str, DataFrame]]


def default_targets(table: DataFrame) -> dict[str, DataFrame]:
    """Sources and topics alike; languages by the square root of their tokens."""
    by = lambda d, share: table.groupBy(d).agg(share.alias("share"))
    return {"source": by("source", F.lit(1.0)), "lang": by("lang", F.sqrt(F.sum("tokens"))), "topic": by("topic", F.lit(1.0))}


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", targets: Targets = default_targets, keep_share: float = KEEP_SHARE, seed: str = SEED) -> DataFrame:
    """``docs`` with ``tokens``, ``topic``, ``probability`` and ``kept``.

    Nulls of a dimension are one value.  Texts without words, null ones too, weigh
    nothing; they have no cell, probability 0 and are not kept.  Repeated rows share
    their draw.  The new columns get a number behind their name where ``docs`` has
    that name.  An empty table stays empty.
    """
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = with_facts(inner, at[text], "tokens", "topic")
    rows = rows.withColumn("source", value(at[source])).withColumn("lang", value(at[lang]))
    dims = ["source", "lang", "topic"]
    table = cells(rows.select(*dims, "tokens"), dims, "tokens")
    chances = materialize(probabilities(rake(table, targets(table)), keep_share).select(*dims, "probability"), "chances")
    out = rows.join(chances, dims, "left").withColumn("probability", F.when(F.col("tokens") > 0, F.col("probability")).otherwise(0.0))
    out = out.withColumn("kept", draw(at[id_col], at[text], seed) < F.col("probability"))
    names = common.fresh(docs, "tokens", "topic", "probability", "kept")
    return out.select(*inner.columns, "tokens", "topic", "probability", "kept").toDF(*docs.columns, *names)
