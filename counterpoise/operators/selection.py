"""Exact selection and exact ranking without a global sort or a hot task.

``exact_cuts`` finds the n-th smallest row of a group by repeatedly counting
rows in slices of the interval that still holds it; only bounded histograms and
one row per cut reach the driver. The selection itself is then a plain row-wise
filter with constants: no shuffle, no window over a class.

``dense_index`` numbers rows 0..n-1 in draw order: rows are ranked inside small
uniform buckets of the draw and shifted by a running total over the buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterpoise.functions.draws import DRAW_BITS, draw, with_draw
from counterpoise.task import RID
from counterpoise.workspace import materialize

SLICES = 1024
MAX_GROUPS = 100
RANKABLE_ROWS = 50_000
DRAW_BOUNDS = (0, 2**DRAW_BITS - 1)


@dataclass(frozen=True)
class Cut:
    """Rows up to (and with) this position in the order belong to the selection."""

    group: Any
    n: int
    position: tuple | None
    everything: bool = False


@dataclass
class _Region:
    group: Any
    fixed: tuple = ()
    low: Any = None
    high: Any = None
    rows: int = 0
    wanted: dict = field(default_factory=dict)  # rank inside the region -> n

    @property
    def level(self) -> int:
        return len(self.fixed)


def _key(i: int) -> str:
    return f"_k{i}"


def _with_keys(df: DataFrame, group: str, order: Sequence[Column], tie: str) -> DataFrame:
    fields = [F.col(group).alias("_g"), *[c.alias(_key(i)) for i, c in enumerate(order)], F.col(tie).alias("_tie")]
    # A generator, for the same reason as in ``with_draw``.
    return df.select(F.inline(F.array(F.struct(*fields))))


def _inside(region: _Region, levels: int) -> Column:
    same = F.col("_g") == F.lit(region.group)
    for i, value in enumerate(region.fixed):
        same = same & (F.col(_key(i)) == F.lit(value))
    if region.level < levels and region.low is not None:
        key = F.col(_key(region.level))
        same = same & (key >= F.lit(region.low)) & (key <= F.lit(region.high))
    return same


def exact_cuts(
    df: DataFrame,
    group: str,
    order: Sequence[Column],
    wanted: Callable[[dict], dict[Any, Sequence[int]]],
    tie: str = RID,
    bounds: tuple | None = None,
    groups: Sequence[Any] | None = None,
) -> tuple[dict, dict]:
    """Positions of the n-th smallest rows by ``order`` then ``tie`` in each group.

    ``wanted`` receives the row count per group and returns the n values per
    group. ``bounds`` are known limits of the first order key (draws); without
    them they are measured. Returns ``(counts, {(group, n): Cut})``.
    """
    keyed = _with_keys(df, group, order, tie)
    levels = len(order)
    spans = [F.min(_key(i)).alias(f"low{i}") for i in range(levels)] + [
        F.max(_key(i)).alias(f"high{i}") for i in range(levels)
    ]

    if bounds is None:
        top = keyed.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), *spans).collect()
        counts = {r["_g"]: r["n"] for r in top}
        regions = [_Region(r["_g"], (), r["low0"], r["high0"], r["n"]) for r in top]
        first_histogram = None
    else:
        low, high = bounds
        sliced = keyed.withColumn("_slice", _slice_of(F.col(_key(0)), F.lit(low), F.lit(high)))
        slices = sliced.groupBy("_g", "_slice").agg(F.count(F.lit(1)).alias("n"), *spans)
        first_histogram = slices.limit(MAX_GROUPS * SLICES + 1).collect()
        if len(first_histogram) > MAX_GROUPS * SLICES:
            raise ValueError(f"more than {MAX_GROUPS} groups; is {group} really a class label?")
        counts = {}
        for r in first_histogram:
            counts[r["_g"]] = counts.get(r["_g"], 0) + r["n"]
        regions = [_Region(g, (), low, high, n) for g, n in counts.items()]

    cuts: dict = {}
    asked = wanted(counts)
    for region in regions:
        for n in asked.get(region.group, ()):
            if n <= 0:
                cuts[(region.group, n)] = Cut(region.group, n, None)
            elif n >= region.rows:
                cuts[(region.group, n)] = Cut(region.group, n, None, everything=True)
            else:
                region.wanted[n] = n
    active = [r for r in regions if r.wanted]

    final: list[_Region] = []
    while active:
        open_regions = []
        for region in active:
            if (region.rows <= RANKABLE_ROWS and first_histogram is None) or region.level >= levels:
                final.append(region)
            else:
                open_regions.append(region)
        if not open_regions:
            break
        if first_histogram is not None:
            numbered = {r.group: i for i, r in enumerate(open_regions)}
            histogram = [(numbered[r["_g"]], r["_slice"], r) for r in first_histogram if r["_g"] in numbered]
            first_histogram = None
        else:
            histogram = _histogram(keyed, open_regions, levels, spans)
        active = []
        for i, region in enumerate(open_regions):
            parts = sorted((h for h in histogram if h[0] == i), key=lambda h: h[1])
            active.extend(_narrow(region, [p[2] for p in parts], levels))

    if final:
        cuts.update(_rank_in_regions(keyed, final, levels))
    return counts, cuts


def _slice_of(key: Column, low: Column, high: Column) -> Column:
    share = (key.cast("double") - low.cast("double")) / (high.cast("double") - low.cast("double"))
    return F.least(F.floor(share * SLICES), F.lit(SLICES - 1)).cast("int")


def _histogram(keyed: DataFrame, regions: list[_Region], levels: int, spans: list[Column]):
    region_id = F.lit(None).cast("int")
    slice_id = F.lit(None).cast("int")
    for i, region in enumerate(regions):
        inside = _inside(region, levels)
        region_id = F.when(inside, F.lit(i)).otherwise(region_id)
        key = F.col(_key(region.level))
        cut = F.lit(0) if region.low == region.high else _slice_of(key, F.lit(region.low), F.lit(region.high))
        slice_id = F.when(inside, cut).otherwise(slice_id)
    rows = (
        keyed.withColumn("_region", region_id)
        .withColumn("_slice", slice_id)
        .where(F.col("_region").isNotNull())
        .groupBy("_region", "_slice")
        .agg(F.count(F.lit(1)).alias("n"), *spans)
        .collect()
    )
    return [(r["_region"], r["_slice"], r) for r in rows]


def _narrow(region: _Region, slices: list, levels: int) -> list[_Region]:
    """The slices of a region that hold its wanted ranks, as new regions."""
    found: dict[int, _Region] = {}
    for rank, n in region.wanted.items():
        before = 0
        for i, part in enumerate(slices):
            if rank <= before + part["n"]:
                if i not in found:
                    low, high = part[f"low{region.level}"], part[f"high{region.level}"]
                    fixed = region.fixed
                    if low == high:
                        fixed = fixed + (low,)
                        deeper = len(fixed)
                        low = part[f"low{deeper}"] if deeper < levels else None
                        high = part[f"high{deeper}"] if deeper < levels else None
                    found[i] = _Region(region.group, fixed, low, high, part["n"])
                found[i].wanted[rank - before] = n
                break
            before += part["n"]
    return list(found.values())


def _rank_in_regions(keyed: DataFrame, regions: list[_Region], levels: int) -> dict:
    region_id = F.lit(None).cast("int")
    hit = F.lit(False)
    for i, region in enumerate(regions):
        region_id = F.when(_inside(region, levels), F.lit(i)).otherwise(region_id)
        hit = hit | ((F.col("_region") == i) & F.col("_rank").isin(sorted(region.wanted)))
    names = [_key(i) for i in range(levels)]
    window = Window.partitionBy("_region").orderBy(*names, "_tie")
    rows = (
        keyed.withColumn("_region", region_id)
        .where(F.col("_region").isNotNull())
        .withColumn("_rank", F.row_number().over(window))
        .where(hit)
        .collect()
    )
    cuts = {}
    for r in rows:
        region = regions[r["_region"]]
        n = region.wanted[r["_rank"]]
        cuts[(region.group, n)] = Cut(region.group, n, tuple(r[k] for k in names) + (r["_tie"],))
    return cuts


def up_to(cut: Cut, order: Sequence[Column], tie: str = RID) -> Column:
    """Row-wise test: is this row (of the cut's group) selected?"""
    if cut.everything:
        return F.lit(True)
    if cut.position is None:
        return F.lit(False)
    *limits, last = cut.position
    test = F.col(tie) <= F.lit(last)
    for value, limit in reversed(list(zip(order, limits))):
        test = (value <= F.lit(limit)) & ((value < F.lit(limit)) | test)
    return test


def dense_index(
    df: DataFrame,
    order: Column,
    by: Sequence[str] = (),
    tie: str = RID,
    out: str = "idx",
    bucket_bits: int = 12,
) -> DataFrame:
    """Number rows 0..n-1 by ``order`` (a draw) then ``tie``, inside each ``by`` group.

    Draws are uniform, so buckets are even whatever the data looks like. The rows
    are written with their numbers inside the buckets, so that they are read and
    drawn once; the sizes of the buckets are counted there. The offsets table has at
    most ``2**bucket_bits`` rows per group and is broadcast.
    """
    by = list(by)
    bucketed = df.withColumn("_draw", order).withColumn("_bucket", F.shiftright("_draw", DRAW_BITS - bucket_bits))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_draw", tie)
    ranked = materialize(bucketed.withColumn("_in", F.row_number().over(inside) - 1).drop("_draw"), "numbered")
    counts = ranked.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*by if by else [F.lit(0)]).orderBy("_bucket")
    before = F.coalesce(F.sum("_n").over(running.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*by, "_bucket", before.alias("_before"))
    return (
        ranked.join(F.broadcast(offsets), [*by, "_bucket"])
        .withColumn(out, F.col("_before") + F.col("_in"))
        .drop("_bucket", "_in", "_before")
    )


def value_buckets(
    df: DataFrame, by: Sequence[str], value: str, cuts: int = 128, salts: int = 32, out: str = "_bucket"
) -> DataFrame:
    """Add an ordered bucket number per group, cut at the group's own percentiles.

    Made for frames of distinct values: whatever their distribution, a bucket
    holds about 1/``cuts`` of its group, so running totals can be taken inside
    buckets and then over the few bucket totals. One group may hold most rows,
    therefore the join with the cuts is salted.
    """
    by = list(by)
    shares = [i / cuts for i in range(1, cuts)]
    limits = df.groupBy(*by).agg(F.percentile_approx(value, shares, 2000).alias("_cuts"))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(salts)).cast("int"))
    copied = limits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        salted.join(copied, [*by, "_salt"])
        .withColumn(out, F.size(F.filter("_cuts", lambda c: c < F.col(value))))
        .drop("_cuts", "_salt")
    )


def sample_rows(df: DataFrame, n: int | None, seed: int) -> DataFrame:
    """Exactly ``n`` rows (or all) with the smallest draws."""
    if n is None:
        return df
    order = draw(seed, "sample", F.col(RID))
    whole = df.withColumn("_all", F.lit(0))
    _, cuts = exact_cuts(whole, "_all", [order], lambda counts: {0: [n]}, bounds=DRAW_BOUNDS)
    cut = cuts.get((0, n), Cut(0, n, None))
    return with_draw(df, "_h", order).where(up_to(cut, [F.col("_h")])).drop("_h")
