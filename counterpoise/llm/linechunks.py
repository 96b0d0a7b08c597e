"""Removal of repeated passages by content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines decides where chunks end, so
equal runs of lines are cut alike wherever they stand; an inserted line moves
only the cuts beside it.  A line of ``solo_words`` words or more is a passage of
its own and forms a chunk alone.  Chunks that occur more than once in the whole
corpus are removed except for their first occurrence (smallest id, then
position).

Only hashes and positions are grouped at first.  Chunks whose hash repeats are
then compared byte by byte: their texts are made distinct by (hash, text), with a
partial step in each task so that copies of a hot passage do not travel.  Where
different texts share a hash, the first occurrence is found anew for each text.

Rows with the same id and text are one document; null ids come last in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.llm import common
from counterpoise.workspace import materialize

DIVISOR = 2
MULTIPLIER = 31
MIN_WORDS = 10
SOLO_WORDS = 50


def line_hash(line: bytes) -> int:
    return int.from_bytes(hashlib.md5(line, usedforsecurity=False).digest()[:4], "big")


def cut(lines: list[bytes], divisor: int = DIVISOR, min_words: int = MIN_WORDS, solo_words: int = SOLO_WORDS) -> list[tuple[int, int]]:
    """Chunks [start, end) of lines that may be removed: solo lines, and chunks of two lines and ``min_words`` words or more.

    A line whose rolled hash is divisible ends a chunk, unless that of the line before
    is divisible too or only one line follows: so hardly a line stays alone.
    """
    sizes = [len(line.split()) for line in lines]
    out, start, before, hit_before = [], 0, 0, True
    for i, line in enumerate(lines):
        code = line_hash(line)
        hit = (before * MULTIPLIER + code) % 2**32 % divisor == 0
        before = code
        solo = sizes[i] >= solo_words
        last = i + 1 == len(lines)
        ends = hit and not hit_before and i + 2 < len(lines)
        hit_before = hit
        if last or solo or sizes[i + 1] >= solo_words or ends:
            if solo or (i > start and sum(sizes[start : i + 1]) >= min_words):
                out.append((start, i + 1))
            start = i + 1
    return out


def chunk_hash(chunk: bytes) -> int:
    return xxhash.xxh3_64_intdigest(chunk) - 2**63


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """All columns of ``docs`` as c0, c1, ... behind a key that equal (id, text) share."""
    renamed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {c: F.col(f"c{i}") for i, c in enumerate(docs.columns)}
    key = F.concat_ws(":", F.coalesce(at[id_col].cast("string"), F.lit("-")), F.xxhash64(at[text]).cast("string"))
    return renamed.select(key.alias("key"), at[id_col].isNull().alias("no_id"), at[id_col].alias("id"), "*")


def _lines(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split(b"\n") if text else []


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    divisor: int = DIVISOR,
    min_words: int = MIN_WORDS,
    solo_words: int = SOLO_WORDS,
    hashed: Callable[[bytes], int] = chunk_hash,
) -> DataFrame:
    """``docs`` with ``text`` less its repeated chunks, and ``n_lines``, ``n_removed`` (lines).

    The two columns get a number behind their name where ``docs`` has that name.
    Null texts stay null and have no lines; an empty text has none either.  A text
    that loses all of its lines becomes empty.  An empty table stays empty.
    """
    keyed = _keyed(docs, id_col, text)
    columns = [f"c{i}" for i in range(len(docs.columns))]
    spot = docs.columns.index(text)
    body = columns[spot]
    id_type = docs.schema[id_col].dataType

    def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, starts, ends, hashes = [], [], [], []
            for r, content in enumerate(batch.column(3).to_pylist()):
                lines = _lines(content)
                for a, b in cut(lines, divisor, min_words, solo_words):
                    row.append(r)
                    starts.append(a)
                    ends.append(b)
                    hashes.append(hashed(b"\n".join(lines[a:b])))
            picked = batch.select([0, 1, 2]).take(pa.array(row, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*picked.columns, pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(hashes, pa.int64())],
                names=["key", "no_id", "id", "start", "end", "hash"],
            )

    schema = T.StructType().add("key", "string").add("no_id", "boolean").add("id", id_type).add("start", "integer").add("end", "integer").add("hash", "long")
    order = F.struct("no_id", "id", "key", "start")
    chunks = materialize(common.map_batches(keyed.select("key", "no_id", "id", body), chunks_of, schema), "chunks")
    repeated = chunks.groupBy("hash").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    marked = (
        chunks.join(repeated, "hash")
        .withColumn("drop", order != F.col("first"))
        .groupBy("key")
        .agg(F.array_sort(F.collect_set(F.struct("start", "end", "hash", "drop"))).alias("marks"))
    )
    marked = materialize(marked, "marked")
    joined = keyed.join(marked, "key", "left")

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, starts, hashes, texts = [], [], [], []
            for r, (content, marks) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                lines = _lines(content)
                for m in marks:
                    row.append(r)
                    starts.append(m["start"])
                    hashes.append(m["hash"])
                    texts.append(b"\n".join(lines[m["start"] : m["end"]]))
            picked = batch.select([0, 1, 2]).take(pa.array(row, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*picked.columns, pa.array(starts, pa.int32()), pa.array(hashes, pa.int64()), pa.array(texts, pa.binary())],
                names=["key", "no_id", "id", "start", "hash", "chunk"],
            )

    schema = T.StructType().add("key", "string").add("no_id", "boolean").add("id", id_type).add("start", "integer").add("hash", "long").add("chunk", "binary")
    marked_texts = keyed.select("key", "no_id", "id", body).join(marked, "key")
    texts = common.map_batches(marked_texts, texts_of, schema)
    clashes = materialize(texts.select("hash", "chunk").distinct().groupBy("hash").count().where("count > 1").select("hash"), "clashes")
    if not clashes.isEmpty():
        told_apart = materialize(texts.join(clashes, "hash", "left_semi"), "apart")
        first = told_apart.groupBy("hash", "chunk").agg(F.min(order).alias("first"))
        stay = (
            told_apart.join(first, ["hash", "chunk"])
            .where(order == F.col("first"))
            .groupBy("key")
            .agg(F.collect_set("start").alias("stay"))
        )
        alone = told_apart.select("hash").distinct().withColumn("clash", F.lit(True))
        # Marks whose hash clashes are dropped unless they are the first of their own text.
        clashing = told_apart.join(alone, "hash").groupBy("key").agg(F.collect_set("start").alias("clashing"))
        joined = joined.join(clashing, "key", "left").join(stay, "key", "left")
        joined = joined.withColumn(
            "marks",
            F.transform(
                "marks",
                lambda m: F.struct(
                    m["start"].alias("start"),
                    m["end"].alias("end"),
                    m["hash"].alias("hash"),
                    F.when(
                        F.coalesce(F.array_contains("clashing", m["start"]), F.lit(False)),
                        ~F.coalesce(F.array_contains("stay", m["start"]), F.lit(False)),
                    )
                    .otherwise(m["drop"])
                    .alias("drop"),
                ),
            ),
        ).drop("clashing", "stay")

    names = common.fresh(docs, "n_lines", "n_removed")
    out = T.StructType()
    for field, name in zip(docs.schema.fields, docs.columns):
        out = out.add(name, field.dataType, True)
    out = out.add(names[0], "long").add(names[1], "long")

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, n_lines, n_removed = [], [], []
            for content, marks in zip(batch.column(spot).to_pylist(), batch.column(len(columns)).to_pylist()):
                lines = _lines(content)
                n_lines.append(len(lines))
                gone = [m for m in marks or () if m["drop"]]
                n_removed.append(sum(m["end"] - m["start"] for m in gone))
                if gone:
                    kept, at = [], 0
                    for m in gone:
                        kept += lines[at : m["start"]]
                        at = m["end"]
                    content = b"\n".join([*kept, *lines[at:]]).decode("utf-8", "surrogatepass")
                bodies.append(content)
            arrays = list(batch.columns[: len(columns)])
            arrays[spot] = pa.array(bodies, batch.schema.field(spot).type)
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], names=out.names)

    return common.map_batches(joined.select(*columns, "marks"), without, out)
