"""Similarity join of word shingles by chosen paths.

Every text is the set of its runs of five words.  In each of several runs a set is
split by the tokens that a random function chooses for it, about ``1/similarity``
of them, and again within each part: two sets meet where both choose the same
tokens, which alike sets do far more often than others.  A part is split further
only while it is large; small parts are searched by brute force, and what is
still large after the last level is searched in blocks, pair of blocks by pair of
blocks.  The number of runs follows from the wanted recall.

* Equal sets are one row with a count from the start, so copies never meet.
* All paths of a set are computed from the set alone, before any shuffle, as
  numbers; the sets themselves are sent only to the parts in which a pair is to be
  compared.
* A pair that meets several times is compared in the part with the smallest number
  that both share.  Parts return the count of links of each member and a spanning
  forest, never all pairs.
* Candidates are compared exactly: sizes of intersection and union of whole sets
  (shingles as 40-bit numbers).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.llm import common
from counterpoise.llm.graph import components
from counterpoise.workspace import materialize

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.999
LEVELS = 3
SMALL = 256
# A part that stays larger is compared in blocks of so many times SMALL: a member travels once for each block of its part.
BLOCK_OF_SMALL = 4
TOKEN_BYTES = 5

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_TOP = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _A
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct shingles of a text as sorted 40-bit numbers; a shorter text is one shingle, one without words has none."""
    seq = common.words(text)
    if not seq:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, seq), np.uint64, len(seq))
    width = min(size, len(seq))
    rolled = np.zeros(len(seq) - width + 1, np.uint64)
    for k in range(width):
        rolled = _mix(rolled * _A + codes[k : len(seq) - width + 1 + k])
    return np.unique(rolled >> np.uint64(64 - 8 * TOKEN_BYTES))


def pack(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES].tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // TOKEN_BYTES, 8), np.uint8)
    out[:, :TOKEN_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, TOKEN_BYTES)
    return out.view("<u8").ravel()


def print_of(tokens: np.ndarray) -> int | None:
    """64-bit number of a whole set; null for the empty set."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - 2**63 if len(tokens) else None


def meeting(similarity: float, levels: int) -> float:
    """Least probability that two sets of this similarity share a path in one run."""
    p = 1.0
    for _ in range(levels):
        p = 1 - math.exp(-p)  # the smaller set may lie wholly in the other: similarity / similarity tokens in common
    return p


def n_runs(similarity: float = SIMILARITY, recall: float = RECALL, levels: int = LEVELS) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - meeting(similarity, levels)))


def paths(sets: list[np.ndarray], runs: int, similarity: float) -> tuple[np.ndarray, ...]:
    """Chosen paths of each set: place of the set, path number of level 1, and numbers of levels 2 and 3 (0: none chosen)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32))
    flat, first = np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes)[:-1]))
    bound = np.minimum(2.0**64 / (similarity * np.maximum(sizes, 1)), 2.0**64 - 4096).astype(np.uint64)
    wide = flat * _A
    found = []
    owner, limit = np.repeat(np.arange(len(sets)), sizes), np.repeat(bound, sizes)
    for run in range(runs):
        seed = _mix(np.array([run + 1], np.uint64) * _A)[0]
        at = np.flatnonzero((wide ^ seed) * (seed | np.uint64(1)) <= limit)
        level = (owner[at], _mix(flat[at] + seed))
        where = np.arange(len(at))
        deeper = []
        for _ in range(LEVELS - 1):
            own, path = level
            counts = sizes[own]
            spread = np.repeat(np.arange(len(own)), counts)
            tokens = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[own], counts)
            key = path[spread]
            hit = np.flatnonzero((wide[tokens] ^ key) * (key | np.uint64(1)) <= bound[own[spread]])
            level = (own[spread[hit]], _mix(flat[tokens[hit]] + key[hit] * _A))
            deeper.append((spread[hit], level[1]))
        found.append(_leaves(owner[at], _mix(flat[at] + seed), where, deeper))
    return tuple(np.concatenate(x) for x in zip(*found))


def _leaves(own, one, where, deeper):
    """One row for each deepest path; a part without further choice gives a row with zeros."""
    up2, two = deeper[0]
    up3, three = deeper[1]
    short = lambda x: ((x >> np.uint64(33)).astype(np.int64) + 1).astype(np.int32)  # noqa: E731  never 0
    # Pairs of levels 2 and 3, then of 1 and 2: left joins by place.
    none3 = np.setdiff1d(np.arange(len(two)), up3)
    i2, c3 = np.concatenate([up3, none3]), np.concatenate([short(three), np.zeros(len(none3), np.int32)])
    none2 = np.setdiff1d(where, up2)
    i1 = np.concatenate([up2[i2], none2])
    c2 = np.concatenate([short(two)[i2], np.zeros(len(none2), np.int32)])
    c3 = np.concatenate([c3, np.zeros(len(none2), np.int32)])
    return own[i1], one[i1].view(np.int64), c2, c3


def in_parts(texts: list[str | None], tokens: int = 50_000) -> Iterator[list[np.ndarray]]:
    """Sets of the texts, in lists that hold about so many tokens."""
    part, held = [], 0
    for text in texts:
        part.append(shingles(text))
        held += len(part[-1])
        if held >= tokens:
            yield part
            part, held = [], 0
    if part:
        yield part


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of a sorted partition by their first columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:n_keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    if rows:
        yield key, rows


def candidates(rows: list[tuple], part: int, crossed: tuple[int, int], similarity: float) -> Iterator[tuple[int, list[int]]]:
    """For a part: each member and its partners there, every pair in the part with the smallest shared number only."""
    rows = sorted((n, fp, block, frozenset(parts)) for fp, n, block, parts in rows)
    for k, (n, fp, block, parts) in enumerate(rows):
        out = []
        for m, other, other_block, other_parts in rows[k + 1 :]:
            if n < similarity * m - 1e-9:
                break
            if (min(block, other_block), max(block, other_block)) == crossed and min(parts & other_parts) == part:
                out.append(other)
        if out:
            yield fp, out


def compare(rows: list[tuple], similarity: float) -> Iterator[tuple[int, int, int]]:
    """Members with links: number of linked documents of other sets, and a root within the part."""
    place = {fp: k for k, (fp, _, _, _) in enumerate(rows)}
    tokens = [unpack(data) for _, _, _, data in rows]
    _, dense = np.unique(np.concatenate(tokens), return_inverse=True)
    dense = np.split(dense, np.cumsum([len(t) for t in tokens])[:-1])
    mark = np.zeros(1 + max(d.max() for d in dense), bool)
    links, root = [0] * len(rows), list(range(len(rows)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    sizes = np.array([len(d) for d in dense])
    flat, first = np.concatenate(dense), np.cumsum(sizes) - sizes
    for k, (_, count, partners, _) in enumerate(rows):
        if not partners:
            continue
        mark[dense[k]] = True
        others = np.array([place[other] for other in partners])
        if 4 * len(others) >= len(rows):
            shared = np.add.reduceat(mark[flat], first, dtype=np.int64)[others]  # no set that was sent is empty
        else:
            shared = np.array([np.count_nonzero(mark[dense[j]]) for j in others])
        for j in others[shared >= similarity * (sizes[k] + sizes[others] - shared) - 1e-9].tolist():
            links[k] += rows[j][1]
            links[j] += count
            root[top(j)] = top(k)
        mark[dense[k]] = False
    for k, (fp, _, _, _) in enumerate(rows):
        if links[k]:
            yield fp, links[k], rows[top(k)][0]


def join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL, small: int = SMALL) -> DataFrame:
    """One row for each row of ``docs``: ``id``, ``body_hash``, ``fp``, ``root``, ``class_id``, ``n_links``.

    ``class_id`` is the smallest id of the documents joined by links, directly or
    through others; ``n_links`` counts the other rows whose similarity is at least
    ``similarity``.  ``fp`` is a number of the shingle set, ``root`` the one that names
    the class and ``body_hash`` a hash of the text.  Texts that are null or have no
    words are in a class of their own, without links and with a null ``fp`` and
    ``root``.  Repeated rows are copies and link to each other.  Null ids count as
    copies, but never name a class that has an id.
    """
    runs = n_runs(similarity, recall)
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("body_hash"), F.col(text).cast("string").alias("body"))
    id_type = source.schema["id"].dataType

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in in_parts(batch.column(2).to_pylist()):
                own, one, two, three = paths(sets, runs, similarity)
                order = np.argsort(own, kind="stable")
                offsets = pa.array(np.searchsorted(own[order], np.arange(len(sets) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(sets)),
                        batch.column(1).slice(at, len(sets)),
                        pa.array([print_of(s) for s in sets], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.ListArray.from_arrays(offsets, pa.array(one[order], pa.int64())),
                        pa.ListArray.from_arrays(offsets, pa.array(two[order], pa.int32())),
                        pa.ListArray.from_arrays(offsets, pa.array(three[order], pa.int32())),
                    ],
                    names=["id", "body_hash", "fp", "n", "one", "two", "three"],
                )
                at += len(sets)

    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType().add("id", id_type).add("body_hash", "long").add("fp", "long").add("n", "integer").add("one", T.ArrayType(T.LongType())).add("two", ints).add("three", ints)
    signed = materialize(common.map_batches(source, signatures, schema), "signatures")
    sets = materialize(
        signed.where("fp is not null").groupBy("fp").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("one", "two", "three")]),
        "sets",
    )
    parts = materialize(_parts(sets, small), "parts")
    shared = parts.groupBy("fp").agg(F.collect_list("part").alias("parts"))
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    members = (
        parts.join(sizes, "part")
        .join(shared, "fp")
        .withColumn("blocks", F.ceil(F.col("size") / (BLOCK_OF_SMALL * small)).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("fp", "part"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("part", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "fp", "n", "block", "parts")
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, lo, hi), rows in _runs(batches, 3):
            found = dict(candidates(rows, part, (lo, hi), similarity))
            wanted = sorted({x for fp, others in found.items() for x in (fp, *others)})
            if wanted:
                k = len(wanted)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * k, pa.int64()), pa.array([lo] * k, pa.int32()), pa.array([hi] * k, pa.int32()), pa.array(wanted, pa.int64()), pa.array([found.get(x, []) for x in wanted], pa.list_(pa.int64()))],
                    names=["part", "lo", "hi", "fp", "partners"],
                )

    keys = ["part", "lo", "hi"]
    needed = materialize(
        common.map_batches(members.repartition(*keys).sortWithinPartitions(*keys), meet, "part bigint, lo int, hi int, fp bigint, partners array<bigint>"),
        "needed",
    )

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in in_parts(batch.column(0).to_pylist()):
                found = [s for s in found if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([print_of(s) for s in found], pa.int64()), pa.array([pack(s) for s in found], pa.binary())], names=["fp", "tokens"])

    wanted = needed.select("fp").distinct()
    tokens = common.map_batches(source.select("body"), bodies, "fp bigint, tokens binary").join(wanted, "fp", "left_semi").dropDuplicates(["fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches, 3):
            found = list(compare(rows, similarity))
            if found:
                fp, links, root = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), pa.array(links, pa.int64()), pa.array(root, pa.int64())], names=["fp", "links", "root"])

    sent = needed.join(tokens, "fp").join(sets.select("fp", "copies"), "fp").select(*keys, "fp", "copies", "partners", "tokens")
    linked = materialize(
        common.map_batches(sent.repartition(*keys).sortWithinPartitions(*keys), verify, "fp bigint, links bigint, root bigint"), "linked"
    )
    roots = components(linked.where("fp <> root"), "fp", "root").withColumnRenamed("node", "fp")
    links = linked.groupBy("fp").agg(F.sum("links").alias("links"))
    told = sets.select("fp", "copies", "id").join(links, "fp", "left").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    told = materialize(told, "told")
    named = told.groupBy("root").agg(F.min("id").alias("class_id"))
    facts = told.join(named, "root").select("fp", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = ["id", "body_hash", "fp", "root", "class_id", "n_links"]
    with_words = signed.where("fp is not null").select("id", "body_hash", "fp").join(facts, "fp").select(*out)
    nothing = F.lit(None).cast("long")
    without = signed.where("fp is null").select("id", "body_hash", "fp", nothing.alias("root"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return with_words.unionByName(without)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest id (then hash of the text; null ids last).

    Rows whose text is null or has no words all stay.  Of repeated rows one stays.
    """
    columns = [f"c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*columns)
    id_at, text_at = (columns[docs.columns.index(c)] for c in (id_col, text))
    wordless = ~F.coalesce(F.col(text_at), F.lit("")).rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")
    found = join(inner, id_at, text_at, **options).where("fp is not null")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "body_hash")).alias("first"))
    first = materialize(first.select(F.col("first.id").alias("first_id"), F.col("first.body_hash").alias("first_hash")), "first")
    rows = inner.where(~wordless).withColumn("body_hash", F.xxhash64(text_at))
    kept = rows.join(first, F.col(id_at).eqNullSafe(F.col("first_id")) & (F.col("body_hash") == F.col("first_hash")))
    kept = kept.dropDuplicates([id_at, "body_hash"]).select(*columns)
    return kept.unionByName(inner.where(wordless)).toDF(*docs.columns)


def _parts(sets: DataFrame, small: int) -> DataFrame:
    """``fp``, ``n`` and the number of every part of two or more sets: the first level at which it is small, or else the last."""
    leaves = sets.select("fp", "n", F.explode(F.arrays_zip("one", "two", "three")).alias("p")).select("fp", "n", F.col("p.one").alias("part"), "p.two", "p.three")
    shared = sets.select("fp", F.explode(F.array_distinct("one")).alias("part"))
    out = None
    for level in range(LEVELS):
        sizes = shared.groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("part", "size")
        met = leaves.join(sizes, "part")
        last = level == LEVELS - 1
        here = (met if last else met.where(F.col("size") <= small)).select("fp", "n", "part").distinct()
        out = here if out is None else out.unionByName(here)
        if not last:
            deeper = "two" if level == 0 else "three"
            leaves = materialize(met.where((F.col("size") > small) & (F.col(deeper) != 0)).withColumn("part", F.xxhash64("part", deeper)).drop("size"), "leaves")
            shared = leaves.select("fp", "part").distinct()
    return out.distinct()
