"""Language identification by compression.

For every language a raw-content dictionary of zstandard is made from a sample
of labelled text.  A text is encoded with each dictionary and the language of
the smallest encoding wins: the dictionary that shares most of the text's letter
sequences saves most bytes.  Long texts are encoded in pieces, so that the
dictionary is of use from the first to the last piece and the work stays in
proportion to the length.  A very short text alone is stored as it is by the
encoder, so it is encoded behind a few passages of the dictionary and the bytes
that it adds are counted.

The sample is bounded by ``dictionary_bytes`` for each language (the only bound;
every text is classified whole).  Pieces of the sample are those with the
smallest hashes over *all* labelled texts, found with a partial selection in
each task, so the choice does not depend on partitions or on lost executors.

A quarter of the labelled texts, dealt by a hash of the text, is kept out of the
dictionaries and encoded with all of them.  It tells for each language and class of
length how many bytes a byte of text takes, and by which part of it the second
language takes more.  The same texts without the dictionary of their own language
tell what these two figures are for texts of no learned language.  A text is
rejected when its margin is too narrow or its encoding too long; both limits lie
halfway between the outermost labelled texts and the median of the left-out ones.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.llm import common
from counterpoise.workspace import materialize

UNDETERMINED = "und"
DICTIONARY_BYTES = 96 * 1024
PIECE = 512
SHORT = 256
N_HOSTS, HOST = 4, 300
ASIDE = 4  # one labelled text in so many measures and does not teach
TAIL = 0.002  # this part of the labelled texts of a language and length may lie outside a limit
ENOUGH = 20  # labelled texts that a limit needs
MIN_MARGIN = 0.02  # where there are fewer
LONGEST_CLASS = 6
MAX_DICTIONARIES_BYTES = 256 * 1024 * 1024


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(text: str, size: int = PIECE) -> list[bytes]:
    """The whole normalised text in pieces of about ``size`` bytes, cut at spaces where there are any."""
    data = normal(text).encode("utf-8", "surrogatepass")
    out, at = [], 0
    while len(data) - at > size + size // 2:
        end = data.rfind(b" ", at, at + size) + 1
        end = end if end > at else at + size
        out.append(data[at:end])
        at = end
    return [*out, data[at:]]


def length_class(size: int) -> int:
    """0 below 4 bytes, 1 below 16, 2 below 64 and so on; 6 from 4096 on, where means of pieces hardly vary."""
    return min(LONGEST_CLASS, max(0, size.bit_length() - 1) // 2)


def figures(sizes: list[float], n_bytes: int) -> tuple[float, float]:
    """Margin of the smallest size before the second, as a part of the smallest; smallest size for a byte of text.

    A single size has no second; its margin is infinite.
    """
    least, *more = sorted(sizes)[:2]
    return (more[0] - least) / max(least, 1.0) if more else float("inf"), least / max(n_bytes, 1)


class Encoder:
    """Encoded sizes with the dictionary of one language."""

    def __init__(self, content: bytes, level: int):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        self.zstd = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        step = len(content) // N_HOSTS
        hosts = [content[i * step : i * step + HOST] for i in range(N_HOSTS)]
        self.hosts = [(h + b" ", self.plain([h])) for h in hosts]

    def plain(self, parts: list[bytes]) -> float:
        return float(sum(len(self.zstd.compress(p)) for p in parts))

    def size(self, parts: list[bytes]) -> float:
        if len(parts) > 1 or len(parts[0]) >= SHORT:
            return self.plain(parts)
        return sum(self.plain([host + parts[0]]) - alone for host, alone in self.hosts) / N_HOSTS


@dataclass(frozen=True)
class LanguageModel:
    """Raw-content dictionaries by language; ``level`` is the compression level.

    ``limits`` has the least margin and the greatest size for a byte of text by
    language and class of length, where enough labelled texts were measured.
    """

    dictionaries: dict[str, bytes]
    level: int = 6
    piece: int = PIECE
    limits: dict[tuple[str, int], tuple[float, float]] = field(default_factory=dict)

    def limit(self, lang: str, length: int, min_margin: float) -> tuple[float, float]:
        """Limits of a class of length, else those of the next shorter class, which are wider."""
        known = (self.limits[lang, c] for c in range(length, -1, -1) if (lang, c) in self.limits)
        return next(known, (min_margin, float("inf")))

    def encoders(self) -> list[tuple[str, Encoder]]:
        return [(lang, Encoder(content, self.level)) for lang, content in sorted(self.dictionaries.items())]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", dictionary_bytes: int = DICTIONARY_BYTES, piece: int = PIECE) -> LanguageModel:
    """Dictionaries from the labelled rows of ``docs``.

    Rows whose language or text is null, or whose text has no letter, teach
    nothing.  Equal pieces count once.  A language all of whose texts would be kept
    out is learned from them and has no limits.  An empty table gives a model without
    languages, which answers ``und``.
    """
    keep = max(1, dictionary_bytes // piece)

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[str, bool], dict[int, bytes]] = {}
        for batch in batches:
            for body, *label in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found = best.setdefault(tuple(label), {})
                for part in pieces(body, piece):
                    found[xxhash.xxh3_64_intdigest(part) >> 1] = part
                if len(found) > 4 * keep:
                    best[tuple(label)] = {h: found[h] for h in heapq.nsmallest(keep, found)}
        for (label, aside), found in best.items():
            chosen = heapq.nsmallest(keep, found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([label] * len(chosen), pa.string()),
                    pa.array([aside] * len(chosen), pa.bool_()),
                    pa.array(chosen, pa.int64()),
                    pa.array([found[h] for h in chosen], pa.binary()),
                ],
                names=["lang", "aside", "hash", "piece"],
            )

    labelled = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    labelled = labelled.withColumn("aside", F.pmod(F.xxhash64("text"), F.lit(ASIDE)) == 0)
    found = common.map_batches(labelled, smallest, "lang string, aside boolean, hash bigint, piece binary").dropDuplicates(["lang", "aside", "hash"])
    order = Window.partitionBy("lang").orderBy("aside", "hash")
    placed = found.withColumn("place", F.row_number().over(order)).withColumn("only_aside", F.min("aside").over(Window.partitionBy("lang")))
    chosen = materialize(placed.where((F.col("place") <= keep) & (F.col("aside") == F.col("only_aside"))), "pieces")
    n_languages = chosen.select("lang").distinct().count()
    if n_languages * dictionary_bytes > MAX_DICTIONARIES_BYTES:
        raise ValueError(f"{n_languages} dictionaries of {dictionary_bytes} bytes are too many to hand to every worker")
    parts: dict[str, list[bytes]] = {}
    measurable = set()
    for row in chosen.orderBy("lang", F.desc("hash")).toLocalIterator():
        parts.setdefault(row["lang"], []).append(bytes(row["piece"]))
        if not row["aside"]:
            measurable.add(row["lang"])
    model = LanguageModel({lang: b" ".join(p) for lang, p in parts.items()}, piece=piece)
    return replace(model, limits=measure(labelled.where("aside").select("text", "lang"), model, measurable))


def measure(labelled: DataFrame, model: LanguageModel, languages: set[str]) -> dict[tuple[str, int], tuple[float, float]]:
    """Limits of ``languages`` by class of length, from all labelled texts that taught nothing.

    Texts whose smallest encoding is that of their label stand for the language.
    Figures are rounded to thousandths, so that exact percentiles need few counts.
    """
    if not languages:
        return {}
    handed = labelled.sparkSession.sparkContext.broadcast(model)

    def figures_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = handed.value.encoders()
        names = [lang for lang, _ in encoders]
        for batch in batches:
            rows: list[tuple[str | None, int, float | None, float]] = []
            for body, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if label not in languages:
                    continue
                parts = pieces(body, handed.value.piece)
                sizes = [encoder.size(parts) for _, encoder in encoders]
                n_bytes = sum(map(len, parts))
                others = [s for lang, s in zip(names, sizes) if lang != label]
                kinds = [(label, sizes)] if names[sizes.index(min(sizes))] == label else []
                for kind, seen in [*kinds, *([(None, others)] if others else [])]:
                    margin, fit_ = figures(seen, n_bytes)
                    rows.append((kind, length_class(n_bytes), round(margin, 3) if len(seen) > 1 else None, round(fit_, 3)))
            columns = list(zip(*rows)) or [()] * 4
            types = [pa.string(), pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["lang", "length", "margin", "fit"])

    seen = common.map_batches(labelled, figures_of, "lang string, length int, margin double, fit double")
    at = [TAIL, 0.5, 1 - TAIL]
    rows = seen.groupBy("lang", "length").agg(F.count(F.lit(1)).alias("n"), F.percentile("margin", at).alias("margin"), F.percentile("fit", at).alias("fit")).where(F.col("n") >= ENOUGH).collect()
    left_out = {r["length"]: r for r in rows if r["lang"] is None}
    limits = {}
    for r in rows:
        if r["lang"] is None:
            continue
        foreign = left_out.get(r["length"])
        narrow, wide = float("-inf"), r["fit"][2] + (r["fit"][2] - r["fit"][1])
        if r["margin"]:
            other = foreign["margin"][1] if foreign and foreign["margin"] else 0.0
            narrow = min(r["margin"][0], (r["margin"][0] + other) / 2)
        if foreign:
            wide = max(r["fit"][2], (r["fit"][2] + foreign["fit"][1]) / 2)
        limits[r["lang"], r["length"]] = (narrow, wide)
    return limits


def classify(docs: DataFrame, model: LanguageModel, text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` with ``lang_pred`` string, ``score`` double, ``rejected`` boolean.

    ``score`` is ``1 / sum over languages of 2 ** (smallest size - size)``: 1 for
    a clear case, at most one half where two languages tie.  A text is rejected
    when the second encoding is longer by no more than the least margin of its
    language and length, set against the smallest encoding, or when a byte of it
    takes more than texts of that language take.  ``min_margin`` holds where too few
    labelled texts gave limits.  Null, empty or letterless texts
    are ``und`` with score 0 and rejected; ties go to the first language by name.
    A column of ``docs`` that has one of the three names keeps it, and the new
    one gets a number behind its name (``score_1``).
    """
    names = common.fresh(docs, "lang_pred", "score", "rejected")
    spot = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])
    handed = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = handed.value.encoders()
        size = handed.value.piece
        for batch in batches:
            langs, scores, rejected = [], [], []
            for body in batch.column(spot).to_pylist():
                if not encoders or not body or not any(map(str.isalpha, body)):
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                parts = pieces(body, size)
                sizes = [encoder.size(parts) for _, encoder in encoders]
                least = min(sizes)
                langs.append(encoders[sizes.index(least)][0])
                scores.append(1.0 / sum(2.0 ** max(least - s, -1000) for s in sizes))
                n_bytes = sum(map(len, parts))
                margin, fit_ = figures(sizes, n_bytes)
                narrow, wide = handed.value.limit(langs[-1], length_class(n_bytes), min_margin)
                rejected.append(not margin > narrow or fit_ > wide)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*batch.schema.names, *names],
            )

    return common.map_batches(docs, predict, schema)
