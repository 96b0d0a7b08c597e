"""Personal data by bootstrapped extraction from contexts.

Identifiers of a fixed form (mail and IP addresses, payment cards, phone numbers) are
seeds.  The words around a seed are lexical patterns; other tokens with digits or an
at sign are candidates and have patterns too.  Patterns and instances form a graph,
written as a table of edges, which Spark scores in a few rounds:

* a pattern is as reliable for a kind as the share of its instances that are known to
  be of this kind, and only if enough different seeds support it;
* an instance is of a kind with the probability that not all of its reliable patterns
  are wrong; seeds stay certain.

Candidates whose score is high in the end are identifiers of a form that the seeds do
not have.  Instances and patterns are 64-bit hashes, so that a round moves numbers only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.llm import common
from counterpoise.workspace import materialize

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
MIN_SUPPORT = 5
MIN_RELIABILITY = 0.8
MIN_SCORE = 0.9
MIN_LENGTH = 5
CONTEXT = 80

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_CLUE = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_EDGE = ".,;:!?\"'()[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The leftmost matches of local part, at sign and domain, found from the at signs in linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def _digits(text: str, span: tuple[int, int]) -> str:
    return _NOT_DIGIT.sub("", text[span[0] : span[1]])


def seeds(text: str) -> list[tuple[str, int, int]]:
    """Base identifiers (kind, start, end) by kind, then start; ends are exclusive, in code points."""
    ips = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    cards = [s for s in (m.span() for m in _CARD.finditer(text)) if 13 <= len(d := _digits(text, s)) <= 19 and luhn(d)]
    phones = [s for s in (m.span() for m in _PHONE.finditer(text)) if 9 <= len(_digits(text, s)) <= 15]
    return [(kind, a, b) for kind, spans in zip(KINDS, (emails(text), ips, cards, phones)) for a, b in spans]


def candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs without white space that hold a digit or an at sign, are long enough and meet no taken span."""
    out, at = [], 0
    taken = sorted(taken)
    k = 0
    while clue := _CLUE.search(text, at):
        start, end = clue.start(), clue.end()
        while start > at and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        at = end
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if end - start >= MIN_LENGTH and not (k < len(taken) and taken[k][0] < end):
            out.append((start, end))
    return out


def _hash(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass")) - 2**63


def patterns(text: str, start: int, end: int) -> list[int]:
    """Contexts of a span: two words before, one before and one after, two after; digits are alike."""
    before = [re.sub(r"[0-9]", "0", w) for w in text[max(0, start - CONTEXT) : start].lower().split()[-2:]]
    after = [re.sub(r"[0-9]", "0", w) for w in text[end : end + CONTEXT].lower().split()[:2]]
    found = []
    if len(before) == 2:
        found.append(_hash(f"{before[0]} {before[1]} _"))
    if before and after:
        found.append(_hash(f"{before[-1]} _ {after[0]}"))
    if len(after) == 2:
        found.append(_hash(f"_ {after[0]} {after[1]}"))
    return found


_MENTION = "a int, b int, kind int, instance bigint, patterns array<bigint>"


def mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with a stored ``row`` number and ``mentions``: seeds (kind 0-3) and candidates (kind -1)."""
    kept = [c for c in docs.columns if c != text]
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)], F.col(text).cast("string").alias("body"))
    spot = len(kept)
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("kind", pa.int32()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))]))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body in batch.column(spot).to_pylist():
                body = body or ""
                base = seeds(body)
                spans = [(KINDS.index(k), a, b) for k, a, b in base]
                spans += [(-1, a, b) for a, b in candidates(body, [(a, b) for _, a, b in base])]
                rows.append([{"a": a, "b": b, "kind": k, "instance": _hash(body[a:b].lower()), "patterns": patterns(body, a, b)} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns[:spot], pa.array(rows, kind)], names=[*batch.schema.names[:spot], "mentions"])

    schema = T.StructType([*inner.schema.fields[:spot], T.StructField("mentions", T.ArrayType(docs.sparkSession.createDataFrame([], _MENTION).schema))])
    return materialize(common.map_batches(inner, extract, schema).withColumn("row", F.monotonically_increasing_id()), "mentions")


def discover(found: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, min_reliability: float = MIN_RELIABILITY, min_score: float = MIN_SCORE) -> DataFrame:
    """``instance``, ``kind``, ``score`` of the candidates that are taken for identifiers."""
    mention = found.select(F.explode("mentions").alias("m")).select("m.*")
    edges = materialize(mention.select("instance", F.explode("patterns").alias("pattern")).distinct(), "edges")
    known = mention.groupBy("instance").agg(*[F.max((F.col("kind") == k).cast("double")).alias(f"s{k}") for k in range(len(KINDS))])
    scores = materialize(known.withColumn("seed", F.greatest(*[F.col(f"s{k}") for k in range(len(KINDS))]) > 0), "scores")
    first = scores
    for _ in range(rounds):
        sums = [F.sum(f"s{k}").alias(f"s{k}") for k in range(len(KINDS))]
        support = [F.sum(F.when(F.col("seed"), F.col(f"s{k}")).otherwise(0)).alias(f"n{k}") for k in range(len(KINDS))]
        judged = edges.join(scores, "instance").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *sums, *support)
        # One instance more than there are: a pattern with few instances is less reliable.
        reliable = judged.select("pattern", *[F.when(F.col(f"n{k}") >= min_support, F.col(f"s{k}") / (F.col("n") + 1)).otherwise(0.0).alias(f"r{k}") for k in range(len(KINDS))])
        reliable = reliable.where(F.greatest(*[F.col(f"r{k}") for k in range(len(KINDS))]) >= min_reliability)
        wrong = [F.sum(F.when(F.col(f"r{k}") >= min_reliability, F.log1p(-F.col(f"r{k}"))).otherwise(0.0)).alias(f"w{k}") for k in range(len(KINDS))]
        carried = edges.join(reliable, "pattern").groupBy("instance").agg(*wrong)
        scores = first.join(carried, "instance", "left").select(
            "instance",
            *[F.when(F.col("seed"), F.col(f"s{k}")).otherwise(1 - F.exp(F.coalesce(f"w{k}", F.lit(0.0)))).alias(f"s{k}") for k in range(len(KINDS))],
            "seed",
        )
        scores = materialize(scores, "scores")
    best = F.greatest(*[F.col(f"s{k}") for k in range(len(KINDS))])
    kind = F.lit(None).cast("int")
    for k in reversed(range(len(KINDS))):
        kind = F.when(F.col(f"s{k}") == best, k).otherwise(kind)
    return scores.where(~F.col("seed") & (best >= min_score)).select("instance", kind.alias("kind"), best.alias("score"))


def find(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without its text, with ``base`` and ``added``: arrays of (kind number, a, b), by kind, then start.

    Null texts count as empty and have no spans.  Repeated rows are searched each;
    an instance counts once in the graph however often it occurs.  The two columns
    get a number behind their name where ``docs`` has that name.
    """
    kept = [c for c in docs.columns if c != text]
    names = common.fresh(docs.select(*kept), "base", "added")
    found = mentions(docs, text)
    new = discover(found, **options).withColumnRenamed("kind", "found_kind")
    open_ = found.select("row", F.explode("mentions").alias("m")).where("m.kind < 0").select("row", "m.a", "m.b", "m.instance")
    added = open_.join(new, "instance").groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("found_kind").alias("kind"), "a", "b"))).alias("added"))
    base = F.transform(F.filter("mentions", lambda m: m["kind"] >= 0), lambda m: F.struct(m["kind"].alias("kind"), m["a"].alias("a"), m["b"].alias("b")))
    nothing = F.expr("cast(array() as array<struct<kind:int,a:int,b:int>>)")
    return found.join(added, "row", "left").select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.array_sort(base).alias(names[0]), F.coalesce("added", nothing).alias(names[1])
    )


def written(spans: str | F.Column) -> F.Column:
    """Spans as ``kind:start:end``, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["a"].cast("string"), s["b"].cast("string"))), ",")
