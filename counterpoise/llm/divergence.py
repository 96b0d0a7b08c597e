"""Source divergence audit: how far each source's term distribution lies from the others and from its lang.

Duplicate-text collapse comes first: identical texts of a lang are grouped with
the number of rows each source holds (partial aggregation folds a group of
thousands of copies inside each scan task), each distinct text is tokenized
once, and its terms are added with those multiplicities as weighted document
frequencies and counts. Only texts whose hash repeats within the lang are
grouped by their text; one whose hash is alone has no copy and stays in its scan
task. Pairs of sources are then evaluated sparsely: only
terms that one of the two sources holds are visited, values are taken once for
all terms with equal counts, and the kept terms that neither source holds all
have the same smoothed value in each, so their share is one product.

Rules (fixed by the contract): null text, lang and source read as ``''``;
terms are matches of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z
lower-cased; a lang keeps its ``V`` terms that occur in at least ``MIN_DOCS``
of its documents (rows). For a group (a lang, or a lang and source) with
``count`` occurrences of a kept term and ``N`` occurrences of all kept terms:
``p = 1 + floor(1e9 * (count + 1) / (N + V))``. ``f = floor((p - q)^2 / q)``.

* part ``pair``: for each other source of the lang (item), ``value`` is f
  summed over all kept terms with ``q`` that source's p (0 when ``V = 0``);
  every rank is returned;
* part ``term``: for each kept term the group holds (item) with ``p > q``,
  ``q`` the lang's p, ``value = f``; ranks up to ``TOP_TERMS``.

Ranks start at 1 per (lang, source, part), by value descending and item
ascending (UTF-8 bytes). All arithmetic is exact (decimal products, integral
division). Every occurring (lang, source) group is reported, even one without
kept terms. Repeated rows count as separate documents; an empty table gives no
rows; other input columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from counterpoise.llm import common
from counterpoise.workspace import materialize, salted_join

MIN_DOCS = 3
TOP_TERMS = 200
UNIT = 1_000_000_000
# Below it a count times UNIT fits 64 bits; decimals are taken from there on.
SAFE_COUNT = 9_000_000_000
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
# Terms are the maximal runs of letters a-z and bytes beyond ASCII after A-Z are lower-cased; all else separates.
_FOLD = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in bytes(range(256)).lower())
HELD_TOKENS = 2_000_000
HELD_TEXTS = 100_000
PAIRS_AT_ONCE = 2_000_000
ROWS_OUT = 100_000
# Sums of values up to 1e18 are taken exactly as two sums of 64-bit halves (no decimal per row).
HALF = 1 << 31
# Groups (lang, source) are counted before they are broadcast; beyond this they are joined by a shuffle.
BROADCAST_GROUPS = 200_000
# Hashes of texts that may have copies are counted before they are broadcast, too.
BROADCAST_HASHES = 2_000_000

_EXACT = "DECIMAL(38,0)"


def _smoothed(count: str, total: str, kept: str) -> F.Column:
    """``1 + floor(UNIT * (count + 1) / (total + kept))``, exact; null in a lang without kept terms."""
    return F.expr(
        f"CASE WHEN {total} + {kept} <= 0 THEN NULL WHEN {count} < {SAFE_COUNT} THEN 1 + (CAST({UNIT} AS BIGINT) * ({count} + 1)) div ({total} + {kept})"
        f" ELSE 1 + (CAST({UNIT} AS {_EXACT}) * CAST({count} + 1 AS {_EXACT})) div CAST({total} + {kept} AS {_EXACT}) END"
    )


def _gap_sql(p: str, q: str) -> str:
    """``floor((p - q)^2 / q)``; p and q are at most UNIT + 1, so the square fits 64 bits."""
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def _gap(p: str, q: str) -> F.Column:
    return F.expr(_gap_sql(p, q))


def _exact_sum(value: str, name: str) -> list[F.Column]:
    """Two long sums whose combination (``_combined``) is the exact sum of non-negative values (SQL) below 2**62, each for ``terms`` terms."""
    return [F.sum(F.expr(f"(({value}) div {HALF}) * terms")).alias(f"{name}_hi"), F.sum(F.expr(f"(({value}) % {HALF}) * terms")).alias(f"{name}_lo")]


def _combined(name: str) -> F.Column:
    exact = _EXACT.lower()
    return F.coalesce(F.col(f"{name}_hi").cast(exact) * F.lit(HALF).cast(exact) + F.col(f"{name}_lo").cast(exact), F.lit(0).cast(exact))


def collapse(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Distinct texts of each lang: lang, text, sources (array of (source, m) with m rows each)."""
    rows = docs.select(
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
    ).withColumn("hash", F.xxhash64("lang", "text"))
    repeated = materialize(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("hash"), "divergence-copies")
    few = repeated.count() <= BROADCAST_HASHES
    of_copies = lambda how: rows.join(F.broadcast(repeated), "hash", how) if few else salted_join(rows, repeated, "hash", how)
    alone = of_copies("left_anti").select("lang", "text", F.array(F.struct("source", F.lit(1).cast("long").alias("m"))).alias("sources"))
    per_source = of_copies("left_semi").groupBy("lang", "text", "source").agg(F.count(F.lit(1)).alias("m"))
    copies = per_source.groupBy("lang", "text").agg(F.collect_list(F.struct("source", "m")).alias("sources"))
    return alone.unionByName(copies)


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of distinct texts (lang, text, sources), summed for some texts at a time: lang, term, df, sources, counts."""

    def told() -> Iterator[pa.RecordBatch]:
        text_of = np.repeat(np.arange(len(sizes)), sizes)
        seen, times = np.unique(text_of << 32 | np.array(flat, np.int64), return_counts=True)
        # Each (text, term) once for every source of the text, with the rows that the source holds.
        held = np.array(n_sources)
        first = np.cumsum(held) - held
        own = seen >> 32
        spread = np.repeat(np.arange(len(seen)), held[own])
        begin = np.cumsum(held[own]) - held[own]
        entry = first[own][spread] + np.arange(len(spread)) - begin[spread]
        group, m = np.array(groups)[entry], np.array(rows)[entry]
        key = (np.array(lang_of)[own[spread]] * len(terms) + (seen[spread] & 0xFFFFFFFF)) * len(names) + group
        order = np.argsort(key, kind="stable")
        key, m, times = key[order], m[order], (times[spread] * m)[order]
        at = _starts(key)
        if not len(at):
            return
        counts, df = np.add.reduceat(times, at), np.add.reduceat(m, at)
        both, group = key[at] // len(names), key[at] % len(names)
        ends = _starts(both)
        offsets = pa.array(np.append(ends, len(both)).astype(np.int32))
        both = both[ends]
        whole = pa.RecordBatch.from_arrays(
            [
                pa.array(list(langs)).take(pa.array(both // len(terms))),
                pa.array(list(terms), pa.binary()).take(pa.array(both % len(terms))),
                pa.array(np.add.reduceat(df, ends)),
                pa.ListArray.from_arrays(offsets, pa.array(list(names)).take(pa.array(group))),
                pa.ListArray.from_arrays(offsets, pa.array(counts)),
            ],
            names=["lang", "term", "df", "sources", "counts"],
        )
        yield from (whole.slice(x, ROWS_OUT) for x in range(0, whole.num_rows, ROWS_OUT))

    def empty():
        return [defaultdict(count().__next__) for _ in range(3)] + [[] for _ in range(6)]

    terms, langs, names, flat, sizes, lang_of, n_sources, groups, rows = empty()
    for batch in batches:
        for lang, text, sources in zip(*(c.to_pylist() for c in batch.columns)):
            found = text.translate(_FOLD).split()
            if not found:
                continue
            flat.extend(map(terms.__getitem__, found))
            sizes.append(len(found))
            lang_of.append(langs[lang])
            n_sources.append(len(sources))
            groups.extend(names[x["source"]] for x in sources)
            rows.extend(x["m"] for x in sources)
            if len(flat) >= HELD_TOKENS or len(rows) >= HELD_TEXTS:
                yield from told()
                terms, langs, names, flat, sizes, lang_of, n_sources, groups, rows = empty()
    if flat:
        yield from told()


def term_tables(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept terms with the sources that hold them, how many terms have which count, and every group with its totals.

    Terms: lang, term, total (occurrences in the lang), held (array of (source, count), count > 0).
    Counts: lang, source, count, terms. Groups: lang, source, n (occurrences of kept terms), v (kept terms of the lang).
    """
    texts = collapse(docs, text, lang, source).select("lang", F.col("text").cast("binary").alias("text"), "sources")
    tallied = common.map_batches(texts, _tally, "lang string, term binary, df bigint, sources array<string>, counts array<bigint>")
    # One exchange, by lang and term: the task that reads a term has its document frequency and all its sources.
    dealt = tallied.repartition("lang", "term").withColumn("df", F.sum("df").over(Window.partitionBy("lang", "term")))
    each = dealt.where(F.col("df") >= MIN_DOCS).select("lang", "term", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("count"))))
    summed = each.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"))
    nested = summed.groupBy("lang", "term").agg(F.sum("count").alias("total"), F.collect_list(F.struct("source", "count")).alias("held"))
    held = materialize(nested.withColumn("term", F.col("term").cast("string")), "divergence-terms")
    counts = held.select("lang", F.inline("held")).groupBy("lang", "source", "count").agg(F.count(F.lit(1)).alias("terms"))
    counts = materialize(counts, "divergence-counts")
    sizes = held.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    occurring = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"))]).distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum(F.col("count") * F.col("terms")).alias("n"))
    groups = (
        occurring.join(totals, ["lang", "source"], "left")
        .join(sizes, "lang", "left")
        .select("lang", "source", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("v", F.lit(0)).cast("long").alias("v"))
    )
    return held, counts, materialize(groups, "divergence-groups")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of terms (lang, held): every two sources that hold a term, once, with their counts and the number of such terms."""

    def told() -> Iterator[pa.RecordBatch]:
        kinds = list(codes)
        code, size = np.array(flat, np.int64), np.array(sizes)
        ahead = np.repeat(np.cumsum(size), size) - np.arange(len(code)) - 1  # holders of the same term further on
        edges, done = np.cumsum(ahead), 0
        while done < len(code):
            until = max(done + 1, int(np.searchsorted(edges, (edges[done - 1] if done else 0) + PAIRS_AT_ONCE, "right")))
            times = ahead[done:until]
            left = np.repeat(np.arange(done, until), times)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
            key, n = np.unique(code[left] * len(kinds) + code[right], return_counts=True)
            one, two = (pa.array(x) for x in (key // len(kinds), key % len(kinds)))
            lang, source, held = (pa.array([k[i] for k in kinds]) for i in range(3))
            whole = pa.RecordBatch.from_arrays([lang.take(one), source.take(one), source.take(two), held.take(one), held.take(two), pa.array(n)], names=["lang", "source", "other", "count_s", "count_t", "terms"])
            yield from (whole.slice(x, ROWS_OUT) for x in range(0, whole.num_rows, ROWS_OUT))
            done = until

    codes, flat, sizes, pairs = defaultdict(count().__next__), [], [], 0
    for batch in batches:
        for lang, sources, counts in zip(*(c.to_pylist() for c in batch.columns)):
            flat.extend(codes[lang, source, n] for source, n in zip(sources, counts))
            sizes.append(len(sources))
            pairs += len(sources) * len(sources) // 2
        if pairs >= PAIRS_AT_ONCE:
            yield from told()
            codes, flat, sizes, pairs = defaultdict(count().__next__), [], [], 0
    if flat:
        yield from told()


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value (long), rank (int)."""
    held, counts, groups = term_tables(docs, text, lang, source)
    small = groups.count() <= BROADCAST_GROUPS
    side = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    g = groups.select("lang", "source", "n", "v", _smoothed("0", "n", "v").alias("p0"))
    p = counts.join(side(g), ["lang", "source"]).select("lang", "source", "terms", _smoothed("count", "n", "v").alias("p"))

    langs = groups.groupBy("lang").agg(F.sum("n").alias("n"), F.max("v").alias("v"))
    q = held.join(side(langs), "lang").select("lang", "term", _smoothed("total", "n", "v").alias("q"), F.inline("held"))
    terms = (
        q.join(side(g), ["lang", "source"])
        .select("lang", "source", "term", "q", _smoothed("count", "n", "v").alias("p"))
        .where(F.col("p") > F.col("q"))
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap("p", "q").alias("value"))
    )
    by_value = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top_terms)

    # value(s, t) = X1 + X2 + I + (V - |supp s| - |supp t| + |both|) f(p0_s, p0_t), where X1 sums f(p_s, p0_t) over
    # the terms s holds, X2 sums f(p0_s, p_t) over those t holds, and I corrects the terms both hold. f follows from
    # the counts alone, so a value is taken once for all terms with these counts.
    exact = _EXACT.lower()
    pairs_of = side(g.select("lang", F.col("source").alias("other"), F.col("p0").alias("p0_t")))
    x1 = (
        p.join(pairs_of, "lang")
        .where(F.col("other") != F.col("source"))
        .groupBy("lang", "source", "other")
        .agg(*_exact_sum(_gap_sql("p", "p0_t"), "x1"), F.sum("terms").alias("held_s"))
    )
    x2 = (
        p.withColumnRenamed("source", "other")
        .join(side(g.select("lang", "source", F.col("p0").alias("p0_s"))), "lang")
        .where(F.col("other") != F.col("source"))
        .groupBy("lang", "source", "other")
        .agg(*_exact_sum(_gap_sql("p0_s", "p"), "x2"), F.sum("terms").alias("held_t"))
    )
    met = common.map_batches(
        held.where(F.size("held") > 1).select("lang", "held.source", "held.count"),
        _meetings,
        "lang string, source string, other string, count_s bigint, count_t bigint, terms bigint",
    )
    there = side(g.select("lang", F.col("source").alias("other"), F.col("n").alias("n_t"), F.col("p0").alias("p0_t")))
    valued = (
        met.join(side(g.withColumnRenamed("p0", "p0_s")), ["lang", "source"])
        .join(there, ["lang", "other"])
        .withColumn("p_s", _smoothed("count_s", "n", "v"))
        .withColumn("p_t", _smoothed("count_t", "n_t", "v"))
    )
    gaps = lambda s, t: [*_exact_sum(_gap_sql(f"p_{s}", f"p_{t}"), "inner"), *_exact_sum(_gap_sql(f"p_{s}", f"p0_{t}"), "minus_s"), *_exact_sum(_gap_sql(f"p0_{s}", f"p_{t}"), "minus_t")]
    # Both directions of a pair are summed from its one row.
    ahead, back = ([c.alias(f"{way}{i}") for i, c in enumerate(gaps(*ends))] for way, ends in (("ahead", "st"), ("back", "ts")))
    summed = valued.groupBy("lang", "source", "other").agg(*ahead, *back, F.sum("terms").alias("n_both"))
    names = ["inner_hi", "inner_lo", "minus_s_hi", "minus_s_lo", "minus_t_hi", "minus_t_lo"]
    way = lambda s, t, kind: F.struct(F.col(s).alias("source"), F.col(t).alias("other"), *[F.col(f"{kind}{i}").alias(n) for i, n in enumerate(names)], "n_both")
    both = summed.select("lang", F.inline(F.array(way("source", "other", "ahead"), way("other", "source", "back"))))
    both = both.groupBy("lang", "source", "other").agg(*[F.sum(n).alias(n) for n in (*names, "n_both")])
    zero = F.lit(0).cast(exact)
    rest = F.col("v") - F.coalesce("held_s", F.lit(0)) - F.coalesce("held_t", F.lit(0)) + F.coalesce("n_both", F.lit(0))
    pairs = (
        g.join(pairs_of, "lang")
        .where(F.col("other") != F.col("source"))
        .join(x1, ["lang", "source", "other"], "left")
        .join(x2, ["lang", "source", "other"], "left")
        .join(both, ["lang", "source", "other"], "left")
        .select(
            "lang",
            "source",
            F.lit("pair").alias("part"),
            F.col("other").alias("item"),
            (
                _combined("x1")
                + _combined("x2")
                + _combined("inner")
                - _combined("minus_s")
                - _combined("minus_t")
                + F.coalesce(rest.cast(exact) * _gap("p0", "p0_t").cast(exact), zero)
            ).cast("long").alias("value"),
        )
    )
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(terms.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")).select(
        "lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")
    )
