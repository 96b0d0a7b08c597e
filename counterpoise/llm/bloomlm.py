"""Language-model scores from a log-frequency Bloom filter.

Single words and pairs of all training texts are counted exactly.  A count ``c`` is
stored as the level ``1 + floor(log_b c)``: the n-gram is put into one Bloom filter
with each number from 1 to its level, and is read back by probing 1, 2, ... until a
probe fails.  The filter never says less than was stored.  Probabilities of a word
after its predecessor are smoothed towards the word's own probability by a Dirichlet
prior, so that they need nothing but counts read from the filter.

* Each task counts what it reads, cuts the sorted keys into segments and sends them
  as binary blocks; a segment is merged by one task.  The number of segments follows
  the length of the corpus, so a segment stays small.
* The filter has a slice for each segment and a fixed greatest size
  (``filter_bytes``), which is what may be handed to every worker.  The smallest cut-off
  of counts is taken for which everything that it leaves fits with ``BITS`` bits each; it
  follows from the exact distribution of counts.
* What the cut-off leaves out stays in the table of counts.  The pairs of texts that read
  0 from such a filter are sent there as binary blocks by segment, and what they add
  comes back as sums by text, so scores do not depend on the size of the filter (but for
  its false hits).  Where everything fits nothing is sent.
* Exact counts of the commonest words (at most ``head_words``) are handed out as
  well; rarer words are looked up in the table in the same way, so the base score is
  exact for every word whatever the vocabulary.

Words are known by 64-bit hashes, pairs by 48-bit hashes within their segment.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.llm import common
from counterpoise.workspace import materialize

BASE = 1.5
BITS = 10
PROBES = 5
FILTER_BYTES = 32 * 1024 * 1024
HEAD_WORDS = 1 << 20
SEGMENT_CHARS = 1 << 22  # a segment is brought together in one task, as rows of some megabytes
LEAST_SEGMENTS = 32
STRENGTH = 50.0
ADDED = 0.1
HELD_TOKENS = 2_000_000
SCORED_TOKENS = 100_000  # scoring keeps some thirty arrays of this length beside the model
ASKED_TOKENS = 500_000  # so many tokens of a scan task are looked up together, in one block for each segment
PAIR_BYTES = 6

# A blank is in no word, so these stand for no word.
END = xxhash.xxh3_64_intdigest(b" end")
START = xxhash.xxh3_64_intdigest(b" start")

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def token_hashes(text: str | None) -> list[int]:
    """Hashes of the words of a text (A-Z lower-cased, split at white space) and of its end."""
    seq = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    return [*map(xxhash.xxh3_64_intdigest, seq), END]


def batches_of_tokens(texts: list[str | None], held: int = HELD_TOKENS // 4) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Token hashes of whole texts one after the other, with the length of each text."""
    flat: list[int] = []
    sizes: list[int] = []
    for text in texts:
        found = token_hashes(text)
        flat += found
        sizes.append(len(found))
        if len(flat) >= held:
            yield np.array(flat, np.uint64), np.array(sizes)
            flat, sizes = [], []
    if sizes:
        yield np.array(flat, np.uint64), np.array(sizes)


def predecessors(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = START
    return before


def pair_keys(tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
    return _mix(before * _A + tokens)


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (keys >> np.uint64(48)) % np.uint64(segments)


def levels(counts: np.ndarray, base: float = BASE) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(base) + 1e-9).astype(np.int64)


def middle(level: np.ndarray, base: float = BASE) -> np.ndarray:
    """The count that a level stands for: the mean of the whole numbers that have it."""
    low = np.ceil(base ** (level - 1.0) - 1e-9)
    high = np.ceil(base**level - 1e-9) - 1
    return np.where(level > 0, (low + np.maximum(high, low)) / 2, 0.0)


def _steps(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    h = _mix((keys & np.uint64(2**48 - 1)) * _A + np.uint64(level))
    return h, (h >> np.uint64(32)) | np.uint64(1)


def _place(h: np.ndarray, step: np.ndarray, probe: int, slice_bits: int) -> np.ndarray:
    """Bit of a key within its slice for one probe."""
    return (h + np.uint64(probe) * step) % np.uint64(slice_bits)


def fill(slice_bits: int, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    bits = np.zeros(slice_bits, bool)
    level = levels(counts) if len(counts) else np.zeros(0, np.int64)
    for j in range(1, int(level.max(initial=0)) + 1):
        keys, level = keys[level >= j], level[level >= j]
        h, step = _steps(keys, j)
        for probe in range(PROBES):
            bits[_place(h, step, probe, slice_bits)] = True
    return np.packbits(bits, bitorder="little")


@dataclass(frozen=True)
class BloomModel:
    """The filter (slices one after the other), exact counts of common words, and totals of the training text."""

    bits: np.ndarray
    slice_bits: int
    segments: int
    cutoff: int
    head_keys: np.ndarray
    head_counts: np.ndarray
    train_tokens: int
    distinct: int
    texts: int
    top_level: int = 64
    strength: float = STRENGTH

    def stored(self, keys: np.ndarray) -> np.ndarray:
        """Counts read from the filter; 0 where nothing is stored."""
        level = np.zeros(len(keys), np.int64)
        if not self.slice_bits:
            return middle(level)
        start = segment_of(keys, self.segments) * np.uint64(self.slice_bits)
        alive = np.arange(len(keys))
        for j in range(1, self.top_level + 1):
            h, step = _steps(keys[alive], j)
            for probe in range(PROBES):
                at = _place(h, step, probe, self.slice_bits) + start[alive]
                hit = (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
                alive, h, step = alive[hit], h[hit], step[hit]
            if not len(alive):
                break
            level[alive] = j
        return middle(level)

    def common(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact counts of common words, and where there is none."""
        if not len(self.head_keys):
            return np.zeros(len(tokens)), np.ones(len(tokens), bool)
        at = np.minimum(np.searchsorted(self.head_keys, tokens), len(self.head_keys) - 1)
        hit = self.head_keys[at] == tokens
        return np.where(hit, self.head_counts[at], 0), ~hit

    def base_log(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ADDED) / (self.train_tokens + ADDED * (self.distinct + 1)))

    @property
    def head_is_all(self) -> bool:
        return len(self.head_keys) == self.distinct

    def read(self, tokens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: exact count or 0, whether it is rare, and the counts read for it, its predecessor and their pair."""
        exact, rare = self.common(tokens)
        single = exact.astype(np.float64)
        single[rare] = self.stored(_mix(tokens[rare]))
        context = np.empty(len(tokens))
        context[1:] = single[:-1]
        context[before == START] = self.texts
        return exact, rare, single, context, self.stored(pair_keys(tokens, before))

    def log(self, single: np.ndarray, context: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """log10 of the probability of tokens after their predecessors, from counts."""
        alone = (single + ADDED) / (self.train_tokens + ADDED * (self.distinct + 1))
        pairs = np.minimum(np.minimum(pairs, context), np.maximum(single, 1))
        return np.log10((pairs + self.strength * alone) / (context + self.strength))

    def most(self, single: np.ndarray, context: np.ndarray) -> np.ndarray:
        """The most that a pair left out of the filter can count for."""
        top = middle(levels(np.array([max(self.cutoff - 1, 1)])))[0]
        return np.minimum(np.minimum(context, np.maximum(single, 1)), top)

    def gain(self, single: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """What a pair adds to the ``log`` of its token with a pair of 0."""
        alone = (single + ADDED) / (self.train_tokens + ADDED * (self.distinct + 1))
        return np.log10(1 + pairs / (self.strength * alone))


def _sorted_counts(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _pack(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :PAIR_BYTES].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // PAIR_BYTES, 8), np.uint8)
    out[:, :PAIR_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, PAIR_BYTES)
    return out.view("<u8").ravel().astype(np.uint64)


_BLOCKS = "segment int, words binary, word_counts binary, pairs binary, pair_counts binary"
_NAMES = ["segment", "words", "word_counts", "pairs", "pair_counts"]


def _blocks(words: np.ndarray, pairs: np.ndarray, segments: int) -> Iterator[pa.RecordBatch]:
    """Counted words and pairs by segment, one row at a time.  Pairs keep 48 bits; with the segment these tell them apart."""
    word_keys, word_counts = _sorted_counts(words)
    pair_keys_, pair_counts = _sorted_counts(pairs)
    word_segment, pair_segment = segment_of(_mix(word_keys), segments), segment_of(pair_keys_, segments)
    word_order, pair_order = np.argsort(word_segment, kind="stable"), np.argsort(pair_segment, kind="stable")
    edges = np.arange(segments + 1)
    word_at, pair_at = np.searchsorted(word_segment[word_order], edges), np.searchsorted(pair_segment[pair_order], edges)
    for s in range(segments):
        w, p = word_order[word_at[s] : word_at[s + 1]], pair_order[pair_at[s] : pair_at[s + 1]]
        yield _block(s, word_keys[w], word_counts[w], _pack(pair_keys_[p]), pair_counts[p])


def _block(segment: int, words: np.ndarray, word_counts: np.ndarray, pairs: bytes, pair_counts: np.ndarray) -> pa.RecordBatch:
    whole = (words.tobytes(), common.pack_whole(word_counts), pairs, common.pack_whole(pair_counts))
    return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), *(pa.array([x], pa.binary()) for x in whole)], names=_NAMES)


def _unblocked(words: bytes, word_counts: bytes, pairs: bytes, pair_counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    keys, pair_keys_ = np.frombuffer(words, np.uint64), _unpack(pairs)
    return keys, common.unpack_whole(word_counts, len(keys)), pair_keys_, common.unpack_whole(pair_counts, len(pair_keys_))


def count(docs: DataFrame, text: str, segments: int) -> DataFrame:
    """Exact counts of all words and pairs of ``docs`` by segment, as binary blocks; written."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, held = [], [], 0
        for batch in batches:
            for tokens, sizes in batches_of_tokens(batch.column(0).to_pylist()):
                words.append(tokens)
                pairs.append(pair_keys(tokens, predecessors(tokens, sizes)))
                held += len(tokens)
                if held >= HELD_TOKENS:
                    yield from _blocks(np.concatenate(words), np.concatenate(pairs), segments)
                    words, pairs, held = [], [], 0
        if held:
            yield from _blocks(np.concatenate(words), np.concatenate(pairs), segments)

    def merge(part: pa.Table) -> pa.Table:
        words, word_counts, pairs, pair_counts = (np.concatenate(x) for x in zip(*(_unblocked(*row) for row in zip(*(part.column(c).to_pylist() for c in _NAMES[1:])))))
        words, word_counts = _sorted_counts(words, word_counts)
        pairs, pair_counts = _sorted_counts(pairs, pair_counts)
        return pa.Table.from_batches([_block(part.column("segment")[0].as_py(), words, word_counts, _pack(pairs), np.minimum(pair_counts, 2**32 - 1))])

    tallied = common.map_batches(docs.select(F.col(text).cast("string").alias("body")), tally, _BLOCKS)
    return materialize(tallied.groupBy("segment").applyInArrow(merge, _BLOCKS), "counts")


def _distribution(counted: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """How many words, and how many pairs, have each count."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                _, word_counts, _, pair_counts = _unblocked(*row)
                for order, found in enumerate((word_counts, pair_counts)):
                    c, n = np.unique(found, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([order] * len(c), pa.int32()), pa.array(c.astype(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "c", "n"])

    rows = common.map_batches(counted.select(*_NAMES[1:]), values, "kind int, c bigint, n bigint").groupBy("kind", "c").agg(F.sum("n").alias("n")).collect()
    return tuple({r["c"]: r["n"] for r in rows if r["kind"] == kind} for kind in (0, 1))


def fit(docs: DataFrame, text: str = "text", filter_bytes: int = FILTER_BYTES, head_words: int = HEAD_WORDS, segments: int | None = None) -> tuple[BloomModel, DataFrame]:
    """The model of the texts of ``docs`` and the table of all counts, in which ``score`` looks up what the model leaves out."""
    if segments is None:
        chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
        segments = max(LEAST_SEGMENTS, math.ceil(chars / SEGMENT_CHARS))
    counted = count(docs, text, segments)
    word_sizes, pair_sizes = _distribution(counted)
    head_from, taken = 1 + max(word_sizes, default=0), 0
    for c in sorted(word_sizes, reverse=True):
        if taken + word_sizes[c] > head_words:
            break
        head_from, taken = c, taken + word_sizes[c]
    room = filter_bytes * 8 // BITS
    cutoff, entries = 1 + max([*word_sizes, *pair_sizes], default=0), 0
    for c in sorted({*word_sizes, *pair_sizes}, reverse=True):
        more = int(levels(np.array([c]))[0]) * ((word_sizes.get(c, 0) if c < head_from else 0) + pair_sizes.get(c, 0))
        if entries + more > room:
            break
        cutoff, entries = c, entries + more
    slice_bits = 8 * math.ceil(entries * BITS / segments * 1.05 / 8) if entries else 0

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, *row in zip(*(c.to_pylist() for c in batch.columns)):
                words, counts, pair, n = _unblocked(*row)
                keys = _mix(words)
                rare = (counts < head_from) & (counts >= cutoff)
                often = n >= cutoff
                bits = fill(slice_bits, np.concatenate([keys[rare], pair[often]]), np.concatenate([counts[rare], n[often]]))
                common_ = counts >= head_from
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (bits, words[common_], counts[common_]))], names=["segment", "bits", "head", "head_counts"])

    bits = np.zeros(slice_bits // 8 * segments, np.uint8)
    head, head_counts = [], []
    for row in common.map_batches(counted, slices, "segment int, bits binary, head binary, head_counts binary").toLocalIterator():
        at = row["segment"] * (slice_bits // 8)
        bits[at : at + slice_bits // 8] = np.frombuffer(row["bits"], np.uint8)
        head.append(np.frombuffer(row["head"], np.uint64))
        head_counts.append(np.frombuffer(row["head_counts"], np.int64))
    keys = np.concatenate([np.empty(0, np.uint64), *head])
    counts = np.concatenate([np.empty(0, np.int64), *head_counts])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]

    texts = docs.count()
    model = BloomModel(
        bits,
        slice_bits,
        segments,
        cutoff,
        keys,
        counts,
        sum(c * n for c, n in word_sizes.items()),
        sum(word_sizes.values()),
        texts,
        int(levels(np.array([max([c for c in word_sizes if c < head_from] + [*pair_sizes], default=1)]))[0]),
    )
    return model, counted


# Tokens whose own word (``own``) or predecessor (``ahead``) read 0 from the filter and may have been left out: places among the
# asked words, -1 where the count is known.
_RARE = np.dtype([("owner", "<u4"), ("word", "<u4")])
_UNSURE = np.dtype([("owner", "<u4"), ("own", "<i4"), ("ahead", "<i4"), ("single", "<f8"), ("context", "<f8"), ("pair", "<f8"), ("key", "<u8")])
_ASKED = ["segment", "owners", "keys", "singles", "most", "words", "rare", "unsure"]
_SUMS = ["owners", "known", "base", "gain"]
_SUMMED = "part bigint, owners binary, known binary, base binary, gain binary"


def _batch(columns: dict[str, list], **kinds: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kinds.get(name, pa.binary())) for name, x in columns.items()], names=[*columns])


def _pair_blocks(model: BloomModel, owner: np.ndarray, keys: np.ndarray, single: np.ndarray, context: np.ndarray) -> Iterator[dict]:
    """Pairs to look up, a block for each segment. Counts are multiples of one half."""
    segment = segment_of(keys, model.segments).astype(np.int32)
    order = np.argsort(segment, kind="stable")
    most = model.most(single, context)
    edges = np.searchsorted(segment[order], np.arange(model.segments + 1))
    for s in np.flatnonzero(np.diff(edges)):
        at = order[edges[s] : edges[s + 1]]
        whole = (common.pack_whole(x) for x in (owner[at], 2 * single[at], 2 * most[at]))
        yield dict(zip(("segment", "keys", "owners", "singles", "most"), (int(s), _pack(keys[at]), *whole)))


def _sums_of(owner: np.ndarray, known: np.ndarray, base: np.ndarray, gain: np.ndarray) -> dict:
    """Sums by text, for the texts that have any."""
    owners, at = np.unique(owner, return_inverse=True)
    sums = [np.bincount(at, x, len(owners)).astype(kind) for x, kind in ((known, "<i8"), (base, "<f8"), (gain, "<f8"))]
    return dict(zip(_SUMS, (owners.astype("<u4").tobytes(), *(x.tobytes() for x in sums))))


def _found(table: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Counts of keys in a sorted table; 0 where there is none."""
    if not len(table):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, counts[at], 0)


def _value(counts: np.ndarray) -> np.ndarray:
    """The value that the level of a count stands for, as those read from the filter; 0 for 0."""
    return np.where(counts > 0, middle(levels(np.maximum(counts, 1))), 0.0)


class _Asked:
    """What the texts of a part have to look up: rare words, unsure tokens, pairs. A part is what one scan task holds at once."""

    def __init__(self, model: BloomModel):
        self.model, self.texts, self.held = model, 0, 0
        self.words: list[np.ndarray] = []
        self.rare: list[np.ndarray] = []
        self.unsure: list[np.ndarray] = []
        self.pairs: list[tuple[np.ndarray, ...]] = []

    def add(self, tokens: np.ndarray, before: np.ndarray, sizes: np.ndarray, rare: np.ndarray, single: np.ndarray, context: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Enters tokens; returns which of them get their whole score later."""
        m, owner = self.model, self.texts + np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
        own = np.full(len(tokens), -1)
        if not m.head_is_all:
            spots = np.flatnonzero(rare)
            own[spots] = sum(map(len, self.words)) + np.arange(len(spots))
            self.words.append(tokens[spots])
            self.rare.append(owner[spots])
        unsure = (own >= 0) & (single == 0) & (m.cutoff > 1)
        ahead = np.concatenate([[-1], np.where(unsure, own, -1)[:-1]])
        ahead[before == START] = -1
        later = unsure | (ahead >= 0)
        spots = np.flatnonzero(later)
        entries = np.zeros(len(spots), _UNSURE)
        keys = pair_keys(tokens, before)
        for name, x in (("owner", owner), ("own", np.where(unsure, own, -1)), ("ahead", ahead), ("single", single), ("context", context), ("pair", pairs), ("key", keys)):
            entries[name] = x[spots]
        self.unsure.append(entries)
        if m.cutoff > 1:
            spots = np.flatnonzero((pairs == 0) & ~later)
            self.pairs.append((owner[spots], keys[spots], single[spots], context[spots]))
            self.held += len(spots)
        self.held += len(entries) + (len(self.words[-1]) if self.words else 0)
        self.texts += len(sizes)
        return later

    def rows(self) -> list[dict]:
        out = list(_pair_blocks(self.model, *map(np.concatenate, zip(*self.pairs)))) if self.pairs else []
        words = np.concatenate(self.words) if self.words else np.empty(0, np.uint64)
        if len(words):
            asked, at = np.unique(words, return_inverse=True)
            segment = segment_of(_mix(asked), self.model.segments).astype(np.int32)
            order = np.argsort(segment, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            edges = np.searchsorted(segment[order], np.arange(self.model.segments + 1))
            out += [{"segment": int(s), "words": asked[order[edges[s] : edges[s + 1]]].tobytes()} for s in np.flatnonzero(np.diff(edges))]
            rare = np.zeros(len(words), _RARE)
            rare["owner"], rare["word"] = np.concatenate(self.rare), place[at]
            unsure = np.concatenate(self.unsure)
            for role in ("own", "ahead"):
                unsure[role] = np.where(unsure[role] >= 0, rare["word"][unsure[role]], -1)
            out.append({"rare": rare.tobytes(), "unsure": unsure.tobytes()})
        return out


def _words_resolved(asked: DataFrame, counted: DataFrame, model: BloomModel) -> DataFrame:
    """Sums by text of what rare words add (without a segment), and blocks of the pairs that are then left to look up; written."""
    small = replace(model, bits=model.bits[:0], head_keys=model.head_keys[:0], head_counts=model.head_counts[:0])

    def answer(part: pa.Table, table: pa.Table) -> pa.Table:
        words = np.frombuffer(b"".join(table.column("words").to_pylist()), np.uint64)
        counts = common.unpack_whole(b"".join(table.column("word_counts").to_pylist()), len(words))
        got = [_found(words, counts, np.frombuffer(data, np.uint64)).astype("<i8").tobytes() for data in part.column("words").to_pylist()]
        return pa.table({"part": part.column("part"), "segment": part.column("segment"), "counts": pa.array(got, pa.binary())})

    def resolve(state: pa.Table, answers: pa.Table) -> pa.Table:
        columns = {c: [] for c in ("part", "segment", *_SUMS, "keys", "singles", "most")}
        by_segment = sorted(zip(answers.column("segment").to_pylist(), answers.column("counts").to_pylist()))
        counts = np.frombuffer(b"".join(data for _, data in by_segment), np.int64)
        for part, rare, unsure in zip(*(state.column(c).to_pylist() for c in ("part", "rare", "unsure"))):
            rare, unsure = np.frombuffer(rare, _RARE), np.frombuffer(unsure, _UNSURE)
            single, context = (np.where(unsure[role] >= 0, _value(counts[unsure[role]]), unsure[now]) for role, now in (("own", "single"), ("ahead", "context")))
            own = counts[rare["word"]]
            none = np.zeros(len(unsure))
            rows = [_sums_of(*map(np.concatenate, ((rare["owner"], unsure["owner"]), (own > 0, none), (small.base_log(own), none), (np.zeros(len(rare)), small.log(single, context, unsure["pair"])))))]
            left = unsure["pair"] == 0
            rows += _pair_blocks(small, unsure["owner"][left], unsure["key"][left], single[left], context[left])
            for row in rows:
                for c in columns:
                    columns[c].append(part if c == "part" else row.get(c))
        return pa.Table.from_batches([_batch(columns, part=pa.int64(), segment=pa.int32())])

    words = asked.where(F.col("words").isNotNull()).select("part", "segment", "words")
    answers = words.groupBy("segment").cogroup(counted.select("segment", "words", "word_counts").groupBy("segment")).applyInArrow(answer, "part bigint, segment int, counts binary")
    states = asked.where(F.col("rare").isNotNull()).select("part", "rare", "unsure")
    schema = "part bigint, segment int, " + ", ".join(f"{c} binary" for c in (*_SUMS, "keys", "singles", "most"))
    return materialize(states.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(resolve, schema), "resolved")


def _pairs_looked_up(blocks: DataFrame, counted: DataFrame, model: BloomModel) -> DataFrame:
    """Sums by text of what pairs add that the filter leaves out."""
    small = replace(model, bits=model.bits[:0], head_keys=model.head_keys[:0], head_counts=model.head_counts[:0])

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, pairs, counts in zip(*(c.to_pylist() for c in batch.columns)):
                keys = _unpack(pairs)
                n = common.unpack_whole(counts, len(keys))
                left = n < small.cutoff
                yield _batch({"segment": [segment], "pairs": [_pack(keys[left])], "pair_counts": [common.pack_whole(n[left])]}, segment=pa.int32())

    def look_up(asked: pa.Table, table: pa.Table) -> pa.Table:
        columns = {c: [] for c in ("part", *_SUMS)}
        pairs = _unpack(b"".join(table.column("pairs").to_pylist()))
        value = _value(common.unpack_whole(b"".join(table.column("pair_counts").to_pylist()), len(pairs)))
        for part, keys, *others in zip(*(asked.column(c).to_pylist() for c in ("part", "keys", "owners", "singles", "most"))):
            keys = _unpack(keys)
            owner, single, most = (common.unpack_whole(x, len(keys)) for x in others)
            got = np.minimum(_found(pairs, value, keys), most / 2)
            hit = np.flatnonzero(got)
            if len(hit):
                none = np.zeros(len(hit))
                row = {"part": part} | _sums_of(owner[hit], none, none, small.gain(single[hit] / 2, got[hit]))
                for c in columns:
                    columns[c].append(row[c])
        return pa.Table.from_batches([_batch(columns, part=pa.int64())])

    table = common.map_batches(counted.select("segment", "pairs", "pair_counts"), left_out, "segment int, pairs binary, pair_counts binary")
    return blocks.groupBy("segment").cogroup(table.groupBy("segment")).applyInArrow(look_up, _SUMMED)


def _by_text(sums: DataFrame) -> DataFrame:
    """One row for each text that anything was looked up for: part, owner, more, rest, gain."""

    def total(part: pa.Table) -> pa.Table:
        joined = lambda c, kind: np.frombuffer(b"".join(part.column(c).to_pylist()), kind)
        owners, at = np.unique(joined("owners", "<u4"), return_inverse=True)
        known, base, gain = (np.bincount(at, joined(c, kind), len(owners)) for c, kind in (("known", "<i8"), ("base", "<f8"), ("gain", "<f8")))
        name = pa.array(np.full(len(owners), part.column("part")[0].as_py(), np.int64))
        return pa.table({"part": name, "owner": pa.array(owners.astype(np.int32)), "more": pa.array(known.astype(np.int64)), "rest": pa.array(base), "gain": pa.array(gain)})

    return sums.groupBy("part").applyInArrow(total, "part bigint, owner int, more bigint, rest double, gain double")


def score(docs: DataFrame, model: BloomModel, counted: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Null texts count as empty: they have one token, their end.  Repeated rows are
    scored each.  The new columns get a number behind their name where ``docs`` has
    that name.  Without training text every count is 0.
    """
    kept = [c for c in docs.columns if c != text]
    names = common.fresh(docs.select(*kept), "n_tokens", "n_known", "train_tokens", "base_score", "score")
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)], F.col(text).cast("string").alias("body"))
    spot = len(kept)
    handed = docs.sparkSession.sparkContext.broadcast(model)
    facts = {"n_tokens": pa.int64(), "known": pa.int64(), "base": pa.float64(), "score": pa.float64(), "part": pa.int64(), "owner": pa.int32()}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, and rows without an owner for what is to be looked up."""
        m = handed.value
        part, asked, fields = TaskContext.get().partitionId() << 32, _Asked(m), []
        for batch in batches:
            fields, at = [*batch.schema][:spot], 0
            for tokens, sizes in batches_of_tokens(batch.column(spot).to_pylist(), SCORED_TOKENS):
                first = np.cumsum(sizes) - sizes
                before = predecessors(tokens, sizes)
                exact, rare, single, context, pairs = m.read(tokens, before)
                owners = asked.texts + np.arange(len(sizes), dtype=np.int32)
                later = asked.add(tokens, before, sizes, rare, single, context, pairs)
                logs = np.where(later, 0.0, m.log(single, context, pairs))
                known = np.add.reduceat((~rare).astype(np.int64), first)
                base = np.add.reduceat(np.where(rare & (not m.head_is_all), 0.0, m.base_log(exact)), first)
                columns = [pa.array(x, kind) for x, kind in zip((sizes, known, base, np.add.reduceat(logs, first), np.full(len(sizes), part), owners), facts.values())]
                nothing = [pa.nulls(len(sizes), pa.int32() if c == "segment" else pa.binary()) for c in _ASKED]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(sizes)) for c in batch.columns[:spot]), *columns, *nothing], names=[*(f.name for f in fields), *facts, *_ASKED])
                at += len(sizes)
                if asked.held >= ASKED_TOKENS:
                    yield from told(asked, part, fields)
                    part, asked = part + 1, _Asked(m)
        yield from told(asked, part, fields)

    def told(asked: _Asked, part: int, fields: list[pa.Field]) -> Iterator[pa.RecordBatch]:
        for row in asked.rows():
            lone = [pa.array([part if c == "part" else None], kind) for c, kind in facts.items()]
            own = [pa.array([row.get(c)], pa.int32() if c == "segment" else pa.binary()) for c in _ASKED]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in fields), *lone, *own], names=[*(f.name for f in fields), *facts, *_ASKED])

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in inner.schema.fields[:spot]])
    for name, kind in [*zip(facts, ("long", "long", "double", "double", "long", "integer")), *((c, "integer" if c == "segment" else "binary") for c in _ASKED)]:
        schema = schema.add(name, kind)
    measured = materialize(common.map_batches(inner, measure, schema), "measured")
    out, asked = measured.where(F.col("owner").isNotNull()).drop(*_ASKED), measured.where(F.col("owner").isNull())
    pairs, sums = ["part", "segment", "owners", "keys", "singles", "most"], []
    blocks = [asked.where(F.col("keys").isNotNull()).select(*pairs)]
    if not model.head_is_all:
        resolved = _words_resolved(asked, counted, model)
        sums.append(resolved.where(F.col("segment").isNull()).select("part", *_SUMS))
        blocks.append(resolved.where(F.col("segment").isNotNull()).select(*pairs))
    if model.cutoff > 1:
        sums.append(_pairs_looked_up(functools.reduce(DataFrame.unionByName, blocks), counted, model))
    more = {"more": F.lit(0).cast("long"), "rest": F.lit(0.0), "gain": F.lit(0.0)}
    if sums:
        out = out.join(_by_text(functools.reduce(DataFrame.unionByName, sums)), ["part", "owner"], "left")
        more = {c: F.coalesce(c, nothing) for c, nothing in more.items()}
    return out.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)],
        F.col("n_tokens").alias(names[0]),
        (F.col("known") + more["more"]).alias(names[1]),
        F.lit(model.train_tokens).cast("long").alias(names[2]),
        (F.col("base") + more["rest"]).alias(names[3]),
        (F.col("score") + more["gain"]).alias(names[4]),
    )
