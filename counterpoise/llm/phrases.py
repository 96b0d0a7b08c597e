"""Phrase collocation mining with weighted acyclic automata kept as tables.

A weighted acyclic automaton over words accepts every phrase of one to four
words, and the weight of a path is the number of its contiguous occurrences.
Its states are word paths, so a table keyed by (lang, phrase) holds the whole
automaton; the state of a phrase's first ``k`` words is the row of that prefix.

* **Per shard.** Each scan task splits its texts, numbers their words and sums the weights
  of the n-gram paths it sees: the count transducer of that shard. Frequent words
  are numbered, so a path is one or two 64-bit numbers made of its word numbers
  (exact, no hash). Paths are built level by level; a path of k words is counted only
  where both its parts of k - 1 words may be frequent (a path can only be frequent
  if its parts are), read from a bitmap of bounded size over the level before. The
  bitmap never denies a frequent path; what it lets through wrongly is counted
  exactly and dropped by its count. A task sums the paths of some million words and
  sends them as one binary block for each segment of the paths' hashes. With more frequent words than are handed out,
  the same levels are counted by semi-joins (``_levels_by_joins``).
* **Union.** The shard automata are unioned and their weights summed per path by
  one exchange of the blocks; a hot path (a frequent word) is summed inside each
  shard first and reaches the exchange once a shard. The number of segments follows
  the length of the corpus, so that one task merges some megabytes at a time.
* **Composition for parts.** A candidate's cut into first part and rest is looked
  up by composing the candidate transducer with the count transducer: an equi-join
  of part paths with counted paths. Parts are at least as frequent as the whole,
  so only paths of weight ``>= MIN_COUNT`` are kept for it.

Rules (fixed by the contract): A-Z lower-cased; pieces split at
``[.,;:!?\\x0A-\\x0D]``; words ``[^\\x20\\x09]+``; lang null is ``und``. ``n`` counts
all words of a lang; candidates have 2 to 4 words and ``a >= MIN_COUNT``; the
score of a cut after ``k`` words is ``floor(2000000 * a / (l + r))`` in exact
decimals with integral division, the lowest cut counts and ties go to the smallest ``k``. A candidate
whose words lie contiguously inside a longer candidate with
``100 * f(longer) >= 80 * a`` is dropped. Each lang keeps its first ``TOP`` by
score descending, ``a`` descending, phrase ascending (UTF-8 bytes).

Odd input: null text is empty, null lang is ``und``; repeated rows count again;
an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from counterpoise.llm import common
from counterpoise.workspace import materialize

MAX_WORDS = 4
MIN_COUNT = 30
TOP = 2000
SCALE = 2_000_000
KEEP_NUMERATOR, KEEP_DENOMINATOR = 80, 100

PIECE_BREAKS = r"[.,;:!?\n\x0B\x0C\r]"
WORD_BREAKS = r"[ \t]+"

_EXACT = "decimal(38,0)"



# Frequent words are numbered and handed to the tasks when they are at most this many (counted first); beyond it paths are
# counted as text, with semi-joins against the level before, broadcast up to this many rows. The result is the same.
BROADCAST_PATHS = 2_000_000
WORD_BITS = 21  # numbers from 1 to BROADCAST_PATHS; three fit one long
HELD_TOKENS = 2_000_000
LEAST_SEGMENTS = 32
SEGMENT_TOKENS = 1 << 20
HELD_WORDS = 400_000
FILTER_BITS = 27
ROWS_OUT = 100_000

# One byte table: A-Z lower-cased, every piece break a full stop. No word holds a full stop, so it stands for the break.
_FOLD = bytes(b"."[0] if b in b".,;:!?\n\x0b\x0c\r" else b for b in bytes(range(256)).lower())
_A = np.uint64(0x9E3779B97F4A7C15)


def _tokens(text: bytes | None) -> list[bytes]:
    """Words of a text in order, with a full stop between pieces."""
    return text.translate(_FOLD).replace(b".", b" . ").split() if text else []


def _bodies(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").cast("binary").alias("body"))


def _word_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Words of weight ``>= MIN_COUNT`` (lang, word, f), and for each lang a row with a null word and all its words."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(name, Counter()).update(_tokens(body))
            if sum(map(len, held.values())) >= HELD_WORDS:
                yield from told(held)
                held = {}
        yield from told(held)

    def told(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for name, found in held.items():
            found.pop(b".", None)
            words, counts = [None, *found], [found.total(), *found.values()]
            yield from _in_rows([pa.array([name]).take(pa.array(np.zeros(len(words), np.int32))), pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["lang", "word", "f"])

    counted = common.map_batches(_bodies(docs, text, lang), tally, "lang string, word binary, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    return materialize(counted.where(F.col("word").isNull() | (F.col("f") >= MIN_COUNT)), "phrase-words")


def _in_rows(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, names=names)
    return (whole.slice(at, ROWS_OUT) for at in range(0, whole.num_rows, ROWS_OUT))


class Vocabulary:
    """Frequent words of all langs, numbered from 1. The dictionary is made once in a worker."""

    def __init__(self, words: pa.Table):
        self.langs, self.words = words["lang"].combine_chunks(), words["word"].combine_chunks()

    def __getstate__(self):
        return {"langs": self.langs, "words": self.words}

    @functools.cached_property
    def numbers(self) -> dict[str, dict[bytes, int]]:
        out: dict[str, dict[bytes, int]] = {}
        for number, (lang, word) in enumerate(zip(self.langs.to_pylist(), self.words.to_pylist()), 1):
            out.setdefault(lang, {})[word] = number
        return out


def _path_keys(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Runs of k numbered words: first number, second number (four words only) and where they begin."""
    m = max(len(a) - k + 1, 0)
    whole = np.ones(m, bool)
    for i in range(k):
        whole &= a[i : i + m] > 0
    at = np.flatnonzero(whole)
    joined = lambda first, n: functools.reduce(lambda key, i: key << WORD_BITS | a[at + i], range(first + 1, first + n), a[at + first])
    return (joined(0, k), None, at) if k < MAX_WORDS else (joined(0, 2), joined(2, 2), at)


def _spots(keys: np.ndarray, bits: int) -> np.ndarray:
    h = keys.astype(np.uint64) * _A
    return (h ^ (h >> np.uint64(32))) * _A >> np.uint64(64 - bits)


def _may_be_frequent(level: DataFrame) -> tuple[np.ndarray, int]:
    """Bitmap with a bit for every path of the level, of at most ``2 ** FILTER_BITS`` bits."""
    bits = min(FILTER_BITS, max(16, (16 * level.count()).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = _spots(batch.column(0).to_numpy(), bits)
            yield pa.RecordBatch.from_arrays([pa.array((spots >> np.uint64(3)).astype(np.int64)), pa.array((1 << (spots & np.uint64(7)).astype(np.int32)).astype(np.int32))], names=["place", "marks"])

    marked = common.map_batches(level.select("hi"), mark, "place bigint, marks int").groupBy("place").agg(F.bit_or("marks").alias("marks")).toArrow()
    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    bitmap[marked["place"].to_numpy()] = marked["marks"].to_numpy()
    return bitmap, bits


def _numbered(docs: DataFrame, text: str, lang: str, vocabulary) -> DataFrame:
    """Every text as the numbers of its words (32 bits each; 0 for a rare word, between pieces and at the end), written."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = vocabulary.value.numbers
        for batch in batches:
            flat, ends = [], [0]
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                flat.extend(map(numbers.get(name, {}).get, _tokens(body), repeat(0)))
                flat.append(0)
                ends.append(4 * len(flat))
            data = [None, pa.py_buffer(np.array(ends, np.int32)), pa.py_buffer(np.array(flat, np.int32))]
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(ends) - 1, data)], names=["numbers"])

    return materialize(common.map_batches(_bodies(docs, text, lang), number, "numbers binary"), "phrase-numbers")


def _summed(hi: np.ndarray, lo: np.ndarray | None, counts: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct paths in order (hi, lo of four words only) and their weights."""
    order = np.argsort(hi, kind="stable") if lo is None else np.lexsort((lo, hi))
    hi, lo = hi[order], lo if lo is None else lo[order]
    counts = np.ones(len(hi), np.int64) if counts is None else counts[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(hi), 1), bool), (hi[1:] != hi[:-1]) | (False if lo is None else lo[1:] != lo[:-1]))))
    return hi[first], *(() if lo is None else (lo[first],)), np.add.reduceat(counts, first) if len(first) else counts


def _segments(numbered: DataFrame) -> int:
    size = numbered.agg(F.sum(F.length("numbers"))).first()[0] or 0
    return max(LEAST_SEGMENTS, -(-size // (4 * SEGMENT_TOKENS)))


def _level(numbered: DataFrame, k: int, before, segments: int) -> DataFrame:
    """Paths of k words and of weight ``>= MIN_COUNT``: hi, lo (four words only), f."""
    names = ["hi", "lo"] if k == MAX_WORDS else ["hi"]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            parts.append(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32))
            held += len(parts[-1])
            if held >= HELD_TOKENS:
                yield from told(np.concatenate(parts).astype(np.int64))
                parts, held = [], 0
        if held:
            yield from told(np.concatenate(parts).astype(np.int64))

    def told(a: np.ndarray) -> Iterator[pa.RecordBatch]:
        if k > 2:
            bitmap, bits = before.value
            part, _, at = _path_keys(a, k - 1)
            spots = _spots(part, bits)
            at = at[(bitmap[spots >> np.uint64(3)] >> (spots & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)]
            inside = np.zeros(len(a) + 1, bool)
            inside[at] = True
            # A word that begins no run of which both parts may be frequent, and is in none, cannot be in a path of this level.
            begins = np.flatnonzero(inside[:-1] & inside[1:])
            needed = np.zeros(len(a), bool)
            for i in range(k):
                needed[begins + i] = True
            hi, lo, where = _path_keys(np.where(needed, a, 0), k)
            both = inside[where] & inside[where + 1]
            hi, lo = hi[both], lo if lo is None else lo[both]
        else:
            hi, lo, _ = _path_keys(a, k)
        *paths, counts = _summed(hi, lo)
        segment = functools.reduce(lambda h, x: (h ^ x.astype(np.uint64)) * _A ^ (h >> np.uint64(29)), paths, _A)
        segment = ((segment ^ (segment >> np.uint64(32))) * _A >> np.uint64(40)) % np.uint64(segments)
        order = np.argsort(segment.astype(np.int32), kind="stable")
        edges = np.searchsorted(segment[order], np.arange(segments + 1).astype(np.uint64))
        for s in np.flatnonzero(np.diff(edges)):
            at = order[edges[s] : edges[s + 1]]
            row = [pa.array([x], pa.binary()) for x in (*(x[at].tobytes() for x in paths), common.pack_whole(counts[at]))]
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *row], names=["segment", *names, "f"])

    def merge(part: pa.Table) -> pa.Table:
        paths = [np.frombuffer(b"".join(part.column(c).to_pylist()), np.int64) for c in names]
        counts = [common.unpack_whole(f, len(hi) // 8) for hi, f in zip(part.column("hi").to_pylist(), part.column("f").to_pylist())]
        *paths, counts = _summed(paths[0], paths[1] if k == MAX_WORDS else None, np.concatenate(counts))
        often = counts >= MIN_COUNT
        return pa.table({name: pa.array(x[often]) for name, x in zip([*names, "f"], [*paths, counts])})

    blocks = common.map_batches(numbered, tally, ", ".join(["segment int", *(f"{n} binary" for n in [*names, "f"])]))
    return materialize(blocks.groupBy("segment").applyInArrow(merge, ", ".join(f"{n} bigint" for n in [*names, "f"])), f"phrase-paths-{k}")


def _spelled(level: DataFrame, k: int, vocabulary) -> DataFrame:
    """Paths of a level as text: lang, k, phrase, f."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, langs = vocabulary.value.words, vocabulary.value.langs
        for batch in batches:
            numbers = batch.columns[:-1]
            each = [k] if k < MAX_WORDS else [2, 2]
            at = [column.to_numpy() >> (WORD_BITS * (n - 1 - i)) & ((1 << WORD_BITS) - 1) for column, n in zip(numbers, each) for i in range(n)]
            phrase = pc.binary_join_element_wise(*(words.take(pa.array(x - 1)) for x in at), b" ")
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(at[0] - 1)), pa.array(np.full(len(phrase), k, np.int32)), phrase.cast(pa.string()), batch.columns[-1]], names=["lang", "k", "phrase", "f"])

    return common.map_batches(level, spell, "lang string, k int, phrase string, f bigint")


def _pieces(docs: DataFrame, text: str, lang: str) -> DataFrame:
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(lowered, PIECE_BREAKS)).alias("piece"))
    return rows.select("lang", F.array_remove(F.split("piece", WORD_BREAKS), "").alias("w"))


def _runs(pieces: DataFrame, k: int) -> DataFrame:
    """Every run of k words with its two parts of k - 1 words: lang, first, last, phrase.

    Runs are made by Spark ML's n-gram transformer (space-joined sliding windows);
    the run at position i has the parts at positions i and i + 1 of the shorter runs.
    """
    from pyspark.ml.feature import NGram  # not needed in the tasks, whose workers import this module

    shorter = NGram(n=k - 1, inputCol="w", outputCol="parts").transform(pieces)
    both = NGram(n=k, inputCol="w", outputCol="runs").transform(shorter).where(F.size("runs") > 0)
    m = F.size("runs")
    zipped = F.arrays_zip(F.slice("parts", 1, m).alias("first"), F.slice("parts", 2, m).alias("last"), F.col("runs").alias("phrase"))
    return both.select("lang", F.explode(zipped).alias("r")).select("lang", "r.first", "r.last", "r.phrase")


def _frequent_side(level: DataFrame, name: str) -> DataFrame:
    side = level.select("lang", F.col("phrase").alias(name))
    return F.broadcast(side) if level.count() <= BROADCAST_PATHS else side


def count_paths(docs: DataFrame, text: str = "text", lang: str = "lang", most_words: int = BROADCAST_PATHS) -> tuple[DataFrame, DataFrame]:
    """Counted paths of weight ``>= MIN_COUNT`` (lang, k, phrase, f) and words per lang (lang, n).

    Level by level: a path of k words can only reach ``MIN_COUNT`` if both its
    parts of k - 1 words do, so a level counts only runs whose two parts are
    frequent paths of the level before; the counts themselves are exact. More
    than ``most_words`` frequent words are not handed out but joined.
    """
    words = _word_counts(docs, text, lang)
    totals = words.where(F.col("word").isNull()).select("lang", F.col("f").alias("n"))
    first = words.where(F.col("word").isNotNull())
    single = first.select("lang", F.lit(1).alias("k"), F.col("word").cast("string").alias("phrase"), "f")
    n_words = first.count()
    if not n_words:
        return single, totals
    if n_words > most_words:
        return _levels_by_joins(docs, text, lang, single), totals
    context = docs.sparkSession.sparkContext
    vocabulary = context.broadcast(Vocabulary(first.select("lang", "word").toArrow()))
    numbered = _numbered(docs, text, lang, vocabulary)
    before, levels, segments = None, [single], _segments(numbered)
    for k in range(2, MAX_WORDS + 1):
        level = _level(numbered, k, before, segments)
        levels.append(_spelled(level, k, vocabulary))
        if k < MAX_WORDS:
            before = context.broadcast(_may_be_frequent(level))
    return materialize(functools.reduce(DataFrame.unionByName, levels), "phrase-paths"), totals


def _levels_by_joins(docs: DataFrame, text: str, lang: str, single: DataFrame) -> DataFrame:
    """Counted paths as in ``count_paths``, where the frequent words are too many to be handed out."""
    level, levels = single, [single]
    for k in range(2, MAX_WORDS + 1):
        runs = _runs(_pieces(docs, text, lang), k)
        runs = runs.join(_frequent_side(level, "first"), ["lang", "first"], "left_semi").join(_frequent_side(level, "last"), ["lang", "last"], "left_semi")
        counted = runs.groupBy("lang", "phrase").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") >= MIN_COUNT)
        level = materialize(counted, f"phrase-paths-{k}")
        levels.append(level.select("lang", F.lit(k).alias("k"), "phrase", "f"))
    return functools.reduce(DataFrame.unionByName, levels)


def _cuts(candidates: DataFrame, counted: DataFrame) -> DataFrame:
    """Lowest-scoring cut of each candidate: composition with the counted paths."""
    words = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("j"))
    cuts = cuts.select(
        "lang", "phrase", "a", "j",
        F.array_join(F.slice(words, F.lit(1), F.col("j")), " ").alias("first"),
        F.array_join(F.slice(words, F.col("j") + 1, F.col("k") - F.col("j")), " ").alias("rest"),
    )
    parts = counted.select("lang", F.col("phrase").alias("part"), "f")
    looked = (
        cuts.join(parts.withColumnRenamed("part", "first").withColumnRenamed("f", "l"), ["lang", "first"])
        .join(parts.withColumnRenamed("part", "rest").withColumnRenamed("f", "r"), ["lang", "rest"])
    )
    score = F.expr(f"(CAST(a AS {_EXACT}) * {SCALE}) div CAST(l + r AS {_EXACT})")
    best = looked.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "j", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def _covered(candidates: DataFrame) -> DataFrame:
    """(lang, phrase) of candidates inside a longer candidate with 100 f(longer) >= 80 a."""
    words = F.split("phrase", " ")
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("k") - 1),
            lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " ")),
        )
    )
    longer = candidates.where(F.col("k") >= 3).select("lang", F.col("a").alias("outer"), F.explode(inner).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    return (
        candidates.join(longer, ["lang", "phrase"])
        .where(F.lit(KEEP_DENOMINATOR) * F.col("outer") >= F.lit(KEEP_NUMERATOR) * F.col("a"))
        .select("lang", "phrase")
    )


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> DataFrame:
    """Collocations of every lang: lang, rank, phrase, a, l, r, n, score (numbers long), first ``top`` a lang."""
    counted, totals = count_paths(docs, text, lang)
    candidates = counted.where(F.col("k") >= 2).select("lang", "phrase", "k", F.col("f").alias("a"))
    kept = candidates.join(_covered(candidates), ["lang", "phrase"], "left_anti")
    scored = _cuts(kept, counted)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
