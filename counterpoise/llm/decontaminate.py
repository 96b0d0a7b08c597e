"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items form one automaton whose states stand for
the item passages.  Document words are streamed through it; at each word the
length of the longest passage of any item that ends there is known, so every
shared passage of at least ``window`` words is found, wherever it begins.  A
word that no item has sets the length to zero; stretches between such words that
are shorter than the shortest thing to find are passed over.

Items are dealt to automata of at most about ``SHARD_WORDS`` words, which bounds
what a worker holds.  Each automaton is handed to the workers and the documents
are streamed once for each; findings of a document are brought together in the
end.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.llm import common
from counterpoise.workspace import materialize

WINDOW = 10
SHARD_WORDS = 100_000


class Automaton:
    """Suffix automaton of several word sequences; no state runs across two of them."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.items_at: dict[int, list[str]] = {}
        self.short_at: dict[int, list[tuple[int, str]]] = {}
        items = sorted((str(name), seq) for name, seq in items if seq)
        for _, seq in items:
            last = 0
            for word in seq:
                last = self._extend(last, word)
        for name, seq in items:
            size = min(window, len(seq))
            state = matched = 0
            for word in seq:
                state, matched = self.step(state, matched, word)
                if matched >= size:
                    state, matched = self._shortened(state, size), size
                    if size < window:
                        self.short_at.setdefault(state, []).append((size, name))
                    elif name not in (known := self.items_at.setdefault(state, [])):
                        known.append(name)
        self.vocabulary = frozenset(w for _, seq in items for w in seq)
        self.shortest = min((min(window, len(seq)) for _, seq in items), default=window)

    def _extend(self, last: int, word: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            q = nxt[last][word]
            return q if length[q] == length[last] + 1 else self._copy(last, word, q)
        new = self._state({}, 0, length[last] + 1)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._copy(p, word, q)
        return new

    def _state(self, edges: dict, link: int, length: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _copy(self, p: int, word: bytes, q: int) -> int:
        twin = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = twin
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = twin
            p = self.link[p]
        return twin

    def _shortened(self, state: int, size: int) -> int:
        """The state of the last ``size`` words of a match."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def step(self, state: int, matched: int, word: bytes) -> tuple[int, int]:
        """Follow one word; gives the new state and the length of the longest match that ends with it."""
        to = self.next[state].get(word)
        while to is None:
            state = self.link[state]
            if state < 0:
                return 0, 0
            matched = self.length[state]
            to = self.next[state].get(word)
        return to, matched + 1

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit stretches ``[start, end)`` of the words, merged and in order, and the items found."""
        stretches: list[list[int]] = []
        found: set[str] = set()
        known, reach, n = self.vocabulary, self.shortest, len(words)
        seen: set[int] = set()
        at = 0
        while at + reach <= n:
            back = at + reach - 1
            while back >= at and words[back] in known:
                back -= 1
            if back >= at:
                at = back + 1
                continue
            state = matched = 0
            while at < n and words[at] in known:
                state, matched = self.step(state, matched, words[at])
                at += 1
                if matched >= self.window:
                    start = at - matched
                    if (full := self._shortened(state, self.window)) not in seen:
                        seen.add(full)
                        found.update(self.items_at[full])
                else:
                    start = at
                if self.short_at and matched:
                    start = min(start, at - self._short(state, matched, found))
                if start < at:
                    while stretches and stretches[-1][1] >= start:
                        start = min(start, stretches.pop()[0])
                    stretches.append([start, at])
        return [(a, b) for a, b in stretches], found

    def _short(self, state: int, matched: int, found: set[str]) -> int:
        """Length of the longest whole short item that ends a match; adds all that do to ``found``."""
        longest = 0
        while state > 0:
            for size, name in self.short_at.get(state, ()):
                if size <= matched:
                    found.add(name)
                    longest = max(longest, size)
            state = self.link[state]
        return longest


def automata(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> Iterator[Automaton]:
    """Automata of bounded size for all items; null texts and texts without words have none."""
    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).where("item is not null and text is not null")
    total = rows.agg(F.sum(F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    shards = math.ceil(total / shard_words)
    for shard in range(shards):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == shard)
        yield Automaton([(r["item"], common.words(r["text"])) for r in part.toLocalIterator()], window)


FINDINGS = "n_words bigint, stretches array<struct<a:int,b:int>>, items array<string>"


def find(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, **names: str) -> DataFrame:
    """Rows of ``docs`` with ``n_words``, ``stretches`` (word positions [a, b)) and ``items`` found.

    Null and empty texts have no words and no finding; an empty item table finds
    nothing.  The three columns must not be in ``docs`` already.  With more than
    one automaton equal rows come out once each, as they went in.
    """
    spot = docs.columns.index(text)
    spark = docs.sparkSession
    columns = docs.columns
    schema = spark.createDataFrame([], FINDINGS).schema

    def scan(handed):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = handed.value if handed else None
            for batch in batches:
                rows = []
                for body in batch.column(spot).to_pylist():
                    seq = common.words(body)
                    stretches, found = automaton.find(seq) if automaton else ([], ())
                    rows.append((len(seq), [{"a": a, "b": b} for a, b in stretches], sorted(found)))
                n, stretches, found = zip(*rows) if rows else ((), (), ())
                kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(n, pa.int64()), pa.array(stretches, kind), pa.array(found, pa.list_(pa.string()))],
                    names=[*batch.schema.names, *schema.names],
                )

        return run

    built = [spark.sparkContext.broadcast(a) for a in automata(items, window=window, shard_words=shard_words, **names)]
    whole = T.StructType([*docs.schema.fields, *schema.fields])
    if len(built) <= 1:
        return common.map_batches(docs, scan(built[0] if built else None), whole)
    # One row number tells equal rows apart; it is stored, so that a lost task can't change it.
    row = common.fresh(docs, "row")[0]
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    part = T.StructType([*whole.fields, T.StructField(row, T.LongType())])
    parts = [common.map_batches(numbered.select(*columns, row), scan_with(scan(b), len(columns)), part).drop(*columns) for b in built]
    merged = parts[0]
    for other in parts[1:]:
        merged = merged.unionByName(other)
    merged = merged.groupBy(row).agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("stretches"))).alias("stretches"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    joined = F.aggregate(
        "stretches",
        F.expr("cast(array() as array<struct<a:int,b:int>>)"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["b"] >= s["a"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["a"].alias("a"), F.greatest(F.element_at(done, -1)["b"], s["b"]).alias("b"))),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    return numbered.join(merged.withColumn("stretches", joined), row).select(*columns, *schema.names)


def scan_with(run, n_columns: int):
    """``run`` on the first columns; the last one, a row number, is carried behind the findings."""

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in run(iter([batch.select(list(range(n_columns)))])):
                yield pa.RecordBatch.from_arrays([*out.columns, batch.column(n_columns)], names=[*out.schema.names, batch.schema.names[n_columns]])

    return carried


_RUN = re.compile(rb"[0-9a-z\x80-\xff]+")


def without(text: str, stretches: list[tuple[int, int]]) -> str:
    """The text without the given stretches of words; what stands between the words of a stretch goes with them."""
    data = text.encode("utf-8", "surrogatepass")
    marks = [m.span() for m in _RUN.finditer(data.lower())]
    out, at = [], 0
    for a, b in stretches:
        out.append(data[at : marks[a][0]])
        at = marks[b - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def remove(docs: DataFrame, items: DataFrame, text: str = "text", min_words: int = WINDOW, max_coverage: float = 0.5, **options) -> DataFrame:
    """``docs`` with shared spans cut from ``text``; the other columns stay as they are.

    Spans of at least ``min_words`` words go, and so do spans of any length that are
    a whole shorter item.  Documents of which more than ``max_coverage`` of the
    words are shared go as a whole.  Texts without findings are untouched.
    """
    columns = docs.columns
    spot = columns.index(text)
    extra = common.fresh(docs, "n_words", "stretches", "items")
    if extra != ["n_words", "stretches", "items"]:
        renamed = [f"c{i}" for i in range(len(docs.columns))]
        cut = remove(docs.toDF(*renamed), items, renamed[spot], min_words, max_coverage, **options)
        return cut.toDF(*docs.columns)
    found = find(docs, items, text, window=min_words, **options)
    hit = F.aggregate("stretches", F.lit(0), lambda n, s: n + s["b"] - s["a"])
    found = found.where(hit <= max_coverage * F.col("n_words"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [
                without(body, [(s["a"], s["b"]) for s in stretches]) if stretches else body
                for body, stretches in zip(batch.column(spot).to_pylist(), batch.column("stretches").to_pylist())
            ]
            arrays = list(batch.columns)
            arrays[spot] = pa.array(bodies, batch.schema.field(spot).type)
            yield pa.RecordBatch.from_arrays(arrays[: len(columns)], names=columns)

    return common.map_batches(found, cut_out, docs.schema)
