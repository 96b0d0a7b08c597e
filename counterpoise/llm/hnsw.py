"""Approximate nearest neighbours by hierarchical navigable small-world graphs.

Vectors are dealt to shards by a hash of their content.  Each shard builds its own
graph and stores it as flat arrays: the vectors, their neighbours on the ground
level in rows of ``2 * m`` numbers, those of the upper levels behind each other, and
the level of each node.  Queries are dealt to blocks by a hash; every block is grouped
with every shard, so that one graph and one block are held at a time and nothing is
broadcast.  The best of each shard are merged by a ranking that keeps only as many
rows in each task as are asked for.  Scores are recomputed in double precision from
the vectors as given.

Equal vectors are one node that carries its smallest ids (one more than are asked
for, as the query itself may be among them); more of them can't be in a result, so
nothing is lost and a hot vector makes one node.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from counterpoise.workspace import materialize, ship_package

SHARD_ROWS = 4096
QUERY_ROWS = 8192
MEETING_TASKS = 4096
M = 16
BREADTH_BUILD = 80
BREADTH_SEARCH = 120


class Graph:
    """Graph over unit vectors; nearness is the inner product."""

    def __init__(self, units: np.ndarray, level: np.ndarray, ground: np.ndarray, upper: np.ndarray, entry: int, m: int):
        self.units, self.level, self.ground, self.upper, self.entry, self.m = units, level, ground, upper, entry, m
        self.offset = np.concatenate(([0], np.cumsum(level)))[:-1]

    @classmethod
    def build(cls, units: np.ndarray, m: int = M, breadth: int = BREADTH_BUILD, seed: int = 7) -> Graph:
        n = len(units)
        draw = np.random.default_rng(seed).random(n)
        level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / math.log(m)).astype(np.int32), 8)
        graph = cls(units, level, np.full((n, 2 * m), -1, np.int32), np.full((int(level.sum()), m), -1, np.int32), 0, m)
        for node in range(1, n):
            graph._insert(node, breadth)
        return graph

    def neighbours(self, node: int, height: int) -> np.ndarray:
        row = self.ground[node] if height == 0 else self.upper[self.offset[node] + height - 1]
        return row

    def _insert(self, node: int, breadth: int) -> None:
        query, top = self.units[node], int(self.level[self.entry])
        at = self.entry
        for height in range(top, int(self.level[node]), -1):
            at = self._descend(query, at, height)
        starts = [at]
        for height in range(min(top, int(self.level[node])), -1, -1):
            found = self.search_level(query, starts, breadth, height)
            chosen = self._choose(found, self.m)
            self.neighbours(node, height)[: len(chosen)] = chosen
            for other in chosen:
                self._connect(other, node, height)
            starts = [k for _, k in found]
        if self.level[node] > top:
            self.entry = node

    def _connect(self, node: int, new: int, height: int) -> None:
        row = self.neighbours(node, height)
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = new
            return
        around = np.append(row, new)
        near = self.units[around] @ self.units[node]
        order = np.argsort(-near, kind="stable")
        chosen = self._choose([(float(near[k]), int(around[k])) for k in order], len(row))
        row[:] = -1
        row[: len(chosen)] = chosen

    def _choose(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours that are nearer to the node than to one another, nearest first; filled up with the rest."""
        ids = np.array([k for _, k in found], np.int64)
        among = self.units[ids] @ self.units[ids].T
        taken: list[int] = []
        rest: list[int] = []
        for k, (near, _) in enumerate(found):
            if len(taken) == most:
                break
            (taken if not taken or among[k, taken].max() <= near else rest).append(k)
        taken += rest[: most - len(taken)]
        return [int(ids[k]) for k in taken]

    def _descend(self, query: np.ndarray, at: int, height: int) -> int:
        best = float(self.units[at] @ query)
        while True:
            row = self.neighbours(at, height)
            row = row[row >= 0]
            if not len(row):
                return at
            near = self.units[row] @ query
            k = int(near.argmax())
            if near[k] <= best:
                return at
            best, at = float(near[k]), int(row[k])

    def search_level(self, query: np.ndarray, starts: list[int], breadth: int, height: int) -> list[tuple[float, int]]:
        """About the ``breadth`` nearest nodes of a level, nearest first."""
        seen = np.zeros(len(self.units), bool)
        seen[starts] = True
        near = self.units[starts] @ query
        best = [(float(x), int(k)) for x, k in zip(near, starts)]
        heapq.heapify(best)
        while len(best) > breadth:
            heapq.heappop(best)
        open_ = [(-x, k) for x, k in best]
        heapq.heapify(open_)
        while open_:
            x, node = heapq.heappop(open_)
            if len(best) == breadth and -x < best[0][0]:
                break
            row = self.neighbours(node, height)
            row = row[row >= 0]
            row = row[~seen[row]]
            if not len(row):
                continue
            seen[row] = True
            near = self.units[row] @ query
            if len(best) == breadth:
                keep = near > best[0][0]
                row, near = row[keep], near[keep]
            for x, k in zip(near.tolist(), row.tolist()):
                if len(best) < breadth:
                    heapq.heappush(best, (x, k))
                elif x > best[0][0]:
                    heapq.heapreplace(best, (x, k))
                else:
                    continue
                heapq.heappush(open_, (-x, k))
        return sorted(best, reverse=True)

    def search(self, query: np.ndarray, breadth: int) -> list[int]:
        at = self.entry
        for height in range(int(self.level[self.entry]), 0, -1):
            at = self._descend(query, at, height)
        return [k for _, k in self.search_level(query, [at], breadth, 0)]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Single-precision directions; lengths are taken in double precision after scaling, so that none overflows."""
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return (wide / np.sqrt((wide**2).sum(axis=1, keepdims=True))).astype(np.float32)


def cosine(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    q, v = query.astype(np.float64), vectors.astype(np.float64)
    q, v = q / np.abs(q).max(), v / np.abs(v).max(axis=1, keepdims=True)
    return (v * q).sum(axis=1) / (np.sqrt((v**2).sum(axis=1)) * np.sqrt((q**2).sum()))


def usable(vector: str) -> F.Column:
    """True for vectors that are not null, hold finite numbers only and are not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _per_width(vectors: DataFrame, most: int) -> dict[int, int]:
    """Parts of at most about ``most`` rows each, for every length of vectors."""
    return {r["width"]: math.ceil(r["n"] / most) for r in vectors.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}


def _of_width(parts: dict[int, int]) -> F.Column:
    """The number of parts for a row's length of vectors."""
    column = F.lit(1)
    for width, n in parts.items():
        column = F.when(F.col("width") == width, n).otherwise(column)
    return column


def neighbours(
    rows: DataFrame,
    queries: F.Column,
    id_col: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    m: int = M,
    breadth: int = BREADTH_SEARCH,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest other rows of each row for which ``queries`` holds.

    Nearest first, ties by the smaller id; all others where there are fewer than
    ``k``.  Vectors that are null or zero or hold null or non-finite numbers take
    part neither as queries nor as candidates, nor do rows without an id.  Vectors of
    different length never meet.  Rows that repeat an id count once for each vector.
    """
    source = rows.withColumn("_q", F.coalesce(queries, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), "_q"
    )
    source = source.where(F.col("id").isNotNull() & usable("v"))
    content = F.xxhash64("v")
    few = Window.partitionBy("hash", "v").orderBy("id")
    one_each = (
        source.select("id", "v", content.alias("hash")).distinct().withColumn("place", F.row_number().over(few)).where(F.col("place") <= k + 1)
        .groupBy("hash", "v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    )
    ship_package(rows.sparkSession)
    nodes = materialize(one_each.select("hash", "v", F.size("v").alias("width"), "ids"), "nodes")
    n_shards = _per_width(nodes, shard_rows)
    shards = _of_width(n_shards)
    nodes = nodes.withColumn("shard", F.pmod(F.shiftright("hash", 7), shards).cast("int"))

    def build(part: pa.Table) -> pa.Table:
        part = part.sort_by("hash")
        width = part.column("width")[0].as_py()
        vectors = np.array(part.column("v").combine_chunks().flatten()).reshape(-1, width)
        graph = Graph.build(unit(vectors), m)
        ids = part.column("ids").to_pylist()
        flat = np.array([x for own in ids for x in own], np.int64)
        sizes = np.array([len(own) for own in ids], np.int32)
        cells = {
            "vectors": vectors.astype(np.float64), "level": graph.level, "ground": graph.ground, "upper": graph.upper,
            "entry": np.array([graph.entry], np.int32), "ids": flat, "sizes": sizes,
        }
        return pa.table({"width": pa.array([width], pa.int32()), "shard": pa.array(part.column("shard").to_pylist()[:1], pa.int32()), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in cells.items()}})

    binaries = ", ".join(f"{c} binary" for c in ("vectors", "level", "ground", "upper", "entry", "ids", "sizes"))
    # A task for each shard: building takes seconds, so small shards are not to be put together.
    spread = nodes.repartition(max(1, sum(n_shards.values())), "width", "shard")
    index = materialize(spread.groupBy("width", "shard").applyInArrow(build, f"width int, shard int, {binaries}"), "hnsw")

    asked = materialize(source.where("_q").select("id", "v", F.size("v").alias("width")).distinct(), "queries")
    n_blocks = _per_width(asked, QUERY_ROWS)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", "v"), _of_width(n_blocks)).cast("int"))

    def pack(part: pa.Table) -> pa.Table:
        cells = {"query_ids": part.column("id"), "query_vectors": part.column("v").combine_chunks().flatten()}
        return pa.table({**{c: part.column(c)[:1] for c in ("width", "block")}, **{c: pa.array([np.array(x).tobytes()], pa.binary()) for c, x in cells.items()}})

    def find(block: pa.Table, shard: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if len(block) and len(shard):
            width = block.column("width")[0].as_py()
            read = lambda part, c, kind=np.int32: np.frombuffer(part.column(c)[0].as_buffer(), kind)
            vectors = read(shard, "vectors", np.float64).reshape(-1, width)
            graph = Graph(unit(vectors), read(shard, "level"), read(shard, "ground").reshape(-1, 2 * m), read(shard, "upper").reshape(-1, m), int(read(shard, "entry")[0]), m)
            ends = np.cumsum(read(shard, "sizes"))
            ids = np.split(read(shard, "ids", np.int64), ends[:-1])
            queries_ = read(block, "query_vectors", np.float64).reshape(-1, width)
            for query_id, query, direction in zip(read(block, "query_ids", np.int64).tolist(), queries_, unit(queries_)):
                near = graph.search(direction, max(breadth, k + 1))
                scores = cosine(query, vectors[near])
                own = [(-s, i) for s, node in zip(scores.tolist(), near) for i in ids[node].tolist() if i != query_id]
                out += [(query_id, i, -s) for s, i in heapq.nsmallest(k, own)]
        q, i, s = zip(*out) if out else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})

    # Grouped, not joined: a join may broadcast the blocks, and that with their copies for all shards.
    meeting = ["width", "shard", "block"]
    n_meetings = sum(n * n_shards[width] for width, n in n_blocks.items())
    dealt = lambda df: df.repartition(max(1, min(n_meetings, MEETING_TASKS)), *meeting).groupBy(*meeting)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    packed = asked.groupBy("width", "block").applyInArrow(pack, "width int, block int, query_ids binary, query_vectors binary")
    index = index.where(F.col("width").isin(list(n_blocks))).withColumn("block", every(_of_width(n_blocks)))
    found = dealt(packed.withColumn("shard", every(shards))).cogroup(dealt(index)).applyInArrow(find, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
