"""Exact k-nearest-neighbour join.

Reference rows with equal vectors are collapsed to one point that keeps its
``k+1`` smallest row ids, so hot groups of copies cost one distance. Points are
laid out in blocks of bounded size along a k-d partition. Each query first
visits its home block, which bounds its k-th distance; it is then sent only to
blocks whose bounding box is closer than that bound. Where boxes prune little
(many dimensions), neighbouring blocks are joined to slabs and queries to longer
chunks, so that neither side is sent once for every pair of blocks. Distances
inside one (block or slab, query chunk) cell are numpy work on a matrix of
bounded size, and only candidates within the bound leave the cell. From
``PRODUCT_DIMS`` dimensions on, a matrix product in single precision with a
bound on its error leaves out far pairs, and the others are computed as before.
Results are exact and ties are broken by row id.

Two metrics share the code: Euclidean on ``vec``, and Euclidean plus
``penalty`` per differing entry of ``cats`` (squared units). Without a penalty
``cats`` are only carried along. Callers that need the neighbour's vector or
categories get them from the task that compared it (``carry=True``): a join on
the neighbour id would be skewed, since copies share their neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.workspace import materialize, ship_package, small_table, spread

BLOCK_POINTS = 4096
NARROW_POINTS = 1024  # of a block in fewer than PRODUCT_DIMS dimensions, where boxes prune well and every pair of a cell is compared
CHUNK_ROWS = 4096
SAMPLE_POINTS = 100_000
MATRIX_CELLS = 2_000_000
SLAB_BLOCKS = 16
SLAB_NUMBERS = 4_000_000
SLAB_CHUNK_ROWS = 32_768
EVERYWHERE = -1
PRODUCT_DIMS = 8
EXACT_PAIRS = 250_000


def vector_of(df: DataFrame, names) -> Column:
    """The named features as one array<double>; array features pass through."""
    names = list(names)
    if len(names) == 1 and isinstance(df.schema[names[0]].dataType, T.ArrayType):
        return F.col(names[0]).cast("array<double>")
    return F.array(*[F.col(c).cast("double") for c in names])


def nearest(
    queries: DataFrame,
    refs: DataFrame,
    k: int,
    exclude_self: bool = True,
    penalty: float = 0.0,
    digits: int | None = None,
    carry: bool | Sequence[str] = False,
    n_queries: int | None = None,
) -> DataFrame:
    """The ``k`` nearest reference rows of every query row.

    Both frames have ``rid`` and ``vec`` (array<double>), and ``cats``
    (array<string>) when ``penalty`` is used. Returns
    ``(rid, neighbour, dist, rank)`` with rank 1..k by (dist, neighbour). With
    ``digits`` distances are rounded first, so equal gaps tie exactly. With
    ``carry`` the neighbour's ``other_vec`` (and ``other_cats``) are added, or
    only those named.
    ``n_queries``, if known, saves counting them before a short query side is
    spread over all cores.
    """
    ship_package(queries.sparkSession)
    has_cats = "cats" in refs.columns
    keep = k + 1 if exclude_self else k
    coordinates = ["vec", "cats"] if has_cats else ["vec"]
    points = materialize(_points(refs, coordinates, keep), "points")
    n_points = points.count()
    asked = coordinates if penalty else ["vec"]
    queries = queries.select("rid", *asked)
    rid_type = queries.schema["rid"].dataType.simpleString()
    ref_type = refs.schema["rid"].dataType.simpleString()
    flat = f"rid {rid_type}, neighbour {ref_type}, dist double"
    carried = coordinates if carry is True else [c for c in coordinates if carry and c in carry]
    added = [f"other_{c}" for c in carried]
    for c in added:
        flat += f", {c} {refs.schema[c[len('other_'):]].dataType.simpleString()}"
    cell = _Cell(k, keep, exclude_self, penalty, has_cats, digits, added)

    if n_points <= BLOCK_POINTS:
        queries = spread(queries, queries.count() if n_queries is None else n_queries)
        pairs = _against_one_block(queries, points, cell, flat)
        return pairs.select("rid", "neighbour", "dist", "rank", *added)
    pairs = _against_blocks(queries, points, n_points, cell, flat)
    order = Window.partitionBy("rid").orderBy("dist", "neighbour")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("rid", "neighbour", "dist", "rank", *added)


def _points(refs: DataFrame, coordinates: list[str], keep: int) -> DataFrame:
    """One row per distinct vector with its smallest row ids.

    The rank filter is pushed below the shuffle, so a vector shared by many
    rows sends at most ``keep`` of them per input partition.
    """
    order = Window.partitionBy(*coordinates).orderBy("rid")
    return (
        refs.select("rid", *coordinates)
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= keep)
        .groupBy(*coordinates)
        .agg(F.array_sort(F.collect_list("rid")).alias("rids"))
    )


class _Product:
    """Squared distances of queries and points by a matrix product, and how far they may be off.

    Both sides are moved to the middle of the points and scaled to at most 1, so
    single precision neither overflows nor loses more than ``error`` says.
    """

    def __init__(self, vec: np.ndarray, points: np.ndarray, middle: np.ndarray, scale: float):
        self.scale = scale
        queries, points = (vec - middle) / scale, (points - middle) / scale
        own, others = (queries * queries).sum(axis=1), (points * points).sum(axis=1)
        self.queries, self.turned = queries.astype(np.float32), (-2.0 * points.T).astype(np.float32)
        self.own, self.others = own.astype(np.float32), others.astype(np.float32)
        self.error = float(np.finfo(np.float32).eps) * (vec.shape[1] + 16) * (own + others.max()) + 1e-36

    @staticmethod
    def of(vec: np.ndarray, points: np.ndarray) -> _Product | None:
        if not len(vec) or not len(points) or points.shape[1] < PRODUCT_DIMS:
            return None
        middle = points.mean(axis=0)
        scale = max(np.abs(vec - middle).max(), np.abs(points - middle).max())
        return _Product(vec, points, middle, scale) if 1e-100 < scale < 1e100 else None

    def squares(self, part: slice) -> tuple[np.ndarray, np.ndarray]:
        out = self.queries[part] @ self.turned
        out += self.others
        out += self.own[part, None]
        return out, self.error[part]

    def length(self, squares: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(squares, 0.0)) * self.scale

    def limit(self, length: np.ndarray, error: np.ndarray) -> np.ndarray:
        """What the square of a pair within ``length`` cannot exceed."""
        return ((length / self.scale) ** 2 * (1 + 1e-6) + error).astype(np.float32)


class _Cell:
    """Distances of one chunk of queries to one block of points."""

    def __init__(self, k: int, keep: int, exclude_self: bool, penalty: float, has_cats: bool, digits: int | None, added: list):
        self.k, self.keep, self.exclude_self = k, keep, exclude_self
        self.penalty, self.has_cats, self.digits, self.added = penalty, has_cats, digits, added
        self.compares_cats = has_cats and penalty > 0
        self.slack = 0.0 if digits is None else 10.0**-digits

    def prepare(self, points: pd.DataFrame) -> dict:
        lists = points["rids"].tolist()
        first = pd.Series([r[0] for r in lists])
        order = first.argsort(kind="stable").to_numpy()
        lists = [lists[i] for i in order]
        lengths = np.array([len(r) for r in lists], dtype=np.int64)
        rids = np.concatenate([np.asarray(r, dtype=object) for r in lists])
        block = {
            "vec": _matrix(points["vec"])[order],
            "rids": rids,
            "rank": pd.Series(rids).rank(method="dense").to_numpy() if lengths.max() > 1 else None,
            "start": np.concatenate([[0], np.cumsum(lengths)[:-1]]),
            "length": lengths,
        }
        if self.has_cats:
            block["cats"] = [points["cats"].iloc[i] for i in order]
        return block

    def distances(self, vec: np.ndarray, cats, block: dict) -> np.ndarray:
        total = np.zeros((len(vec), len(block["vec"])))
        for j in range(vec.shape[1]):
            gap = vec[:, j, None] - block["vec"][None, :, j]
            total += gap * gap
        if self.compares_cats:
            for j in range(len(block["cats"][0])):
                codes, _ = pd.factorize(
                    pd.Series([c[j] for c in cats] + [c[j] for c in block["cats"]]), use_na_sentinel=False
                )
                differ = codes[: len(cats), None] != codes[None, len(cats) :]
                total += self.penalty * differ
        return np.sqrt(total) if self.digits is None else np.round(np.sqrt(total), self.digits)

    def run(self, queries: pd.DataFrame, block: dict, bound: np.ndarray | None) -> pd.DataFrame:
        """Flat (rid, neighbour, dist, rank): the local top list of every query."""
        pieces = []
        vec = _matrix(queries["vec"])
        qid = queries["rid"].to_numpy()
        cats = queries["cats"].tolist() if self.compares_cats else None
        product = None if self.compares_cats else _Product.of(vec, block["vec"])
        step = max(1, MATRIX_CELLS // max(1, len(block["vec"])))
        wide = step if product is None else 4 * step
        for at in range(0, len(queries), wide):
            part = slice(at, at + wide)
            near = None if product is None else self._near(product, vec, block, bound, part)
            if near is not None:
                pieces.append(self._top(qid[part], *near, block))
                continue
            for start in range(at, min(at + wide, len(queries)), step):
                part = slice(start, min(start + step, at + wide))
                dist = self.distances(vec[part], cats[part] if cats else None, block)
                near = self._within(dist, None if bound is None else bound[part])
                pieces.append(self._top(qid[part], *near, block))
        return pd.concat(pieces, ignore_index=True)

    def _within(self, dist: np.ndarray, bound) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (row, col, dist) that may be among the first of their row, from all distances."""
        keep = min(self.keep, dist.shape[1])
        threshold = np.partition(dist, keep - 1, axis=1)[:, keep - 1]
        if bound is not None:
            threshold = np.minimum(threshold, bound)
        row, col = np.nonzero(dist <= threshold[:, None])
        return row, col, dist[row, col]

    def _near(self, product: _Product, vec: np.ndarray, block: dict, bound, part: slice):
        """The same pairs, with distances only of those that the product cannot exclude; None if these are many."""
        vec, bound = vec[part], None if bound is None else bound[part]
        squares, error = product.squares(part)
        limit = None
        if bound is not None and np.isfinite(bound).all():
            limit = product.limit(bound + self.slack, error)
            if np.count_nonzero(squares <= limit[:, None]) > 0.02 * squares.size:
                limit = None
        if limit is None:
            keep = min(self.keep, squares.shape[1])
            least = np.partition(squares, keep - 1, axis=1)[:, keep - 1].astype(np.float64)
            limit = product.limit(product.length(least + error) + self.slack, error)
        row, col = np.nonzero(squares <= limit[:, None])
        if len(row) > 0.25 * squares.size:
            return None
        d = np.empty(len(row))
        for at in range(0, len(row), EXACT_PAIRS):
            some = slice(at, at + EXACT_PAIRS)
            total = np.zeros(len(row[some]))
            for j in range(vec.shape[1]):
                gap = vec[row[some], j] - block["vec"][col[some], j]
                total += gap * gap
            d[some] = np.sqrt(total)
        if self.digits is not None:
            d = np.round(d, self.digits)
        if bound is not None:
            inside = d <= bound[row]
            row, col, d = row[inside], col[inside], d[inside]
        return row, col, d

    def _top(self, qid: np.ndarray, row: np.ndarray, col: np.ndarray, d: np.ndarray, block: dict) -> pd.DataFrame:
        row, col, d = _first_per_row(row, col, d, col, self.keep)
        if block["rank"] is not None:
            times = block["length"][col]
            offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            at = np.repeat(block["start"][col], times) + offset
            row, d = np.repeat(row, times), np.repeat(d, times)
            tie = block["rank"][at]
        else:
            at, tie = col, col
        if self.exclude_self:
            other = block["rids"][at] != qid[row]
            row, at, d, tie = row[other], at[other], d[other], tie[other]
        row, at, d, rank = _first_per_row(row, at, d, tie, self.k, ranks=True)
        found = {"rid": qid[row], "neighbour": block["rids"][at], "dist": d, "rank": rank}
        if self.added:
            point = np.searchsorted(block["start"], at, side="right") - 1
            if "other_vec" in self.added:
                found["other_vec"] = pd.Series(list(block["vec"][point]), dtype=object)
            if "other_cats" in self.added:
                found["other_cats"] = pd.Series([block["cats"][i] for i in point], dtype=object)
        return pd.DataFrame(found)


def _first_per_row(row, value, d, tie, n, ranks=False):
    """First ``n`` entries of each row by (distance, tie)."""
    order = np.lexsort((tie, d, row))
    row, value, d = row[order], value[order], d[order]
    begins = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, dtype=bool)
    starts = np.maximum.accumulate(np.where(begins, np.arange(len(row)), 0)) if len(row) else np.zeros(0, dtype=int)
    rank = np.arange(len(row)) - starts + 1
    first = rank <= n
    if ranks:
        return row[first], value[first], d[first], rank[first]
    return row[first], value[first], d[first]


def _matrix(column: pd.Series) -> np.ndarray:
    if len(column) == 0:
        return np.zeros((0, 0))
    return np.ascontiguousarray(np.stack([np.asarray(v, dtype=np.float64) for v in column]))


def _against_one_block(queries: DataFrame, points: DataFrame, cell: _Cell, flat: str) -> DataFrame:
    """All points fit one block: ship that bounded block, shuffle nothing."""
    columns = ["vec", "rids"] + (["cats"] if cell.has_cats else [])
    local = points.select(*columns).limit(BLOCK_POINTS).toPandas()
    schema = flat.replace("dist double", "dist double, rank int")
    if local.empty:
        return queries.sparkSession.createDataFrame([], schema)
    block = queries.sparkSession.sparkContext.broadcast(cell.prepare(local))

    def run(batches):
        for batch in batches:
            if len(batch):
                yield cell.run(batch, block.value, None)

    return queries.mapInPandas(run, schema)


def _against_blocks(queries: DataFrame, points: DataFrame, n_points: int, cell: _Cell, flat: str) -> DataFrame:
    spark = queries.sparkSession
    dims = points.select(F.size("vec")).first()[0]
    block_points = min(BLOCK_POINTS, NARROW_POINTS) if dims < PRODUCT_DIMS else BLOCK_POINTS
    tree = _kd_tree(points, n_points, block_points)

    @F.pandas_udf("int")
    def route(vec: pd.Series) -> pd.Series:
        return pd.Series(tree.leaf_of(_matrix(vec)))

    # Overfull cells are cut into several blocks, so every block stays small.
    celled = points.withColumn("cell", route("vec"))
    per_cell = {r["cell"]: r["count"] for r in celled.groupBy("cell").count().collect()}
    first_block, n_blocks, blocks_in = {}, 0, {}
    for c in range(tree.leaves):
        blocks_in[c] = max(1, math.ceil(per_cell.get(c, 0) / block_points))
        first_block[c] = n_blocks
        n_blocks += blocks_in[c]
    cells = range(tree.leaves)
    layout = small_table(spark, {"cell": cells, "first": [first_block[c] for c in cells], "parts": [blocks_in[c] for c in cells]})
    blocked = materialize(
        celled.join(F.broadcast(layout), "cell")
        .withColumn("block", (F.col("first") + F.pmod(F.xxhash64("vec"), F.col("parts"))).cast("int"))
        .drop("first", "parts"),
        "blocks",
    )
    search = spark.sparkContext.broadcast(_Search(tree, first_block, blocks_in, *_boxes(blocked, n_blocks)))

    # First visit: the home block bounds the k-th distance of each query.
    slots = spark.sparkContext.defaultParallelism
    home = queries.withColumn("cell", route("vec")).join(F.broadcast(layout), "cell").drop("cell", "parts")
    home_counts = {r["first"]: r["count"] for r in home.groupBy("first").count().collect()}
    chunk = max(256, min(CHUNK_ROWS, sum(home_counts.values()) // (4 * slots) + 1))
    visit_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields)
    visit_schema += ", bound double, targets array<int>"

    def bound_queries(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        q = q.drop(columns=["block", "chunk"])
        limit = np.full(len(q), np.inf)
        if len(q) and len(p):
            q = q.reset_index(drop=True)
            found = cell.run(q, cell.prepare(p), None)
            last = found[found["rank"] == cell.k]
            position = pd.Series(np.arange(len(q)), index=q["rid"].to_numpy())
            limit[position[last["rid"].to_numpy()].to_numpy()] = last["dist"].to_numpy()
        return q.assign(bound=limit, targets=search.value.within(_matrix(q["vec"]), limit + cell.slack))

    visited = materialize(
        _cells(home.withColumnRenamed("first", "block"), blocked, home_counts, chunk, spark)(
            bound_queries, visit_schema
        ),
        "bounded-queries",
    )

    # Second visit: every block whose box is within the bound, or every slab where these are many.
    sent = visited.where(~_everywhere()).withColumn("block", F.explode("targets")).drop("targets")
    sent_counts = {r["block"]: r["count"] for r in sent.groupBy("block").count().collect()}

    def compare(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({c: [] for c in ["rid", "neighbour", "dist", *cell.added]}, dtype=object)
        return cell.run(q, cell.prepare(p), q["bound"].to_numpy()).drop(columns="rank")

    wide = visited.where(_everywhere()).drop("targets")
    n_wide = wide.count()
    if not n_wide:
        return _cells(sent, blocked, sent_counts, chunk, spark)(compare, flat)
    per_slab = max(1, min(SLAB_BLOCKS, SLAB_NUMBERS // (block_points * max(1, search.value.low.shape[1]))))
    n_slabs = math.ceil(n_blocks / per_slab)
    slabs = blocked.withColumn("block", F.floor(F.col("block") / per_slab).cast("int"))
    wide = wide.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_slabs - 1))))
    long_chunk = max(CHUNK_ROWS, min(SLAB_CHUNK_ROWS, n_wide // slots + 1))
    found = _cells(wide, slabs, {i: n_wide for i in range(n_slabs)}, long_chunk, spark)(compare, flat)
    return found.unionByName(_cells(sent, blocked, sent_counts, chunk, spark)(compare, flat)) if sent_counts else found


def _everywhere() -> Column:
    return F.coalesce(F.get("targets", F.lit(0)) == EVERYWHERE, F.lit(False))


def _cells(queries: DataFrame, blocked: DataFrame, counts: dict, chunk: int, spark):
    """Co-group query chunks with their block; a busy block is copied to several chunks."""
    chunks = small_table(spark, {"block": list(counts), "chunks": [max(1, math.ceil(n / chunk)) for n in counts.values()]})
    left = (
        queries.join(F.broadcast(chunks), "block")
        .withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int"))
        .drop("chunks")
    )
    right = (
        blocked.join(F.broadcast(chunks), "block")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .drop("chunks", "cell")
    )
    grouped = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk"))
    return grouped.applyInPandas


def _boxes(blocked: DataFrame, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounding box per block, as (blocks x dims) arrays; empty blocks are infinitely far."""
    sides = (
        blocked.select("block", F.posexplode("vec").alias("dim", "value"))
        .groupBy("block", "dim")
        .agg(F.min("value").alias("low"), F.max("value").alias("high"))
        .toPandas()
    )
    dims = int(sides["dim"].max()) + 1 if len(sides) else 0
    low, high = np.full((n_blocks, dims), np.inf), np.full((n_blocks, dims), -np.inf)
    low[sides["block"], sides["dim"]] = sides["low"]
    high[sides["block"], sides["dim"]] = sides["high"]
    return low, high


class _Tree:
    """A k-d partition: splits are (dimension, threshold, left, right); leaves are numbers."""

    def __init__(self, splits: list, leaves: int):
        self.splits, self.leaves = splits, leaves

    def leaf_of(self, vec: np.ndarray) -> np.ndarray:
        leaf = np.zeros(len(vec), dtype=np.int32)
        if not self.splits or not len(vec):
            return leaf
        todo = [(0, np.arange(len(vec)))]
        while todo:
            node, rows = todo.pop()
            dim, threshold, left, right = self.splits[node]
            below = vec[rows, dim] <= threshold
            for child, part in ((left, rows[below]), (right, rows[~below])):
                if child < 0:
                    leaf[part] = -child - 1
                elif len(part):
                    todo.append((child, part))
        return leaf


class _Search:
    """Blocks within a distance of each query: the tree is descended only where boxes are near."""

    def __init__(self, tree: _Tree, first_block: dict, blocks_in: dict, low: np.ndarray, high: np.ndarray):
        self.splits = tree.splits
        self.leaf_blocks = [list(range(first_block[c], first_block[c] + blocks_in[c])) for c in range(tree.leaves)]
        self.low, self.high = low, high
        self.node_boxes = [None] * len(tree.splits)
        for node in reversed(range(len(tree.splits))):
            sides = [self._child_box(child) for child in tree.splits[node][2:]]
            self.node_boxes[node] = (
                np.minimum(sides[0][0], sides[1][0]),
                np.maximum(sides[0][1], sides[1][1]),
            )

    def _child_box(self, child: int):
        if child >= 0:
            return self.node_boxes[child]
        blocks = self.leaf_blocks[-child - 1]
        return self.low[blocks].min(axis=0), self.high[blocks].max(axis=0)

    @staticmethod
    def _near(vec: np.ndarray, bound: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if not np.isfinite(low[0]):
            return np.zeros(len(vec), dtype=bool)
        gap = np.maximum(np.maximum(low - vec, vec - high), 0.0)
        # A hair of slack keeps rounding from excluding an exact tie.
        return np.sqrt((gap * gap).sum(axis=1)) <= bound * (1 + 1e-9) + 1e-300

    def within(self, vec: np.ndarray, bound: np.ndarray) -> list:
        found: list[list[int]] = [[] for _ in range(len(vec))]
        most = max(4, len(self.low) // (4 if vec.shape[1] < PRODUCT_DIMS else 32))
        todo = [(0 if self.splits else -1, np.arange(len(vec)))] if len(vec) else []
        while todo:
            node, rows = todo.pop()
            if node >= 0:
                rows = rows[self._near(vec[rows], bound[rows], *self.node_boxes[node])]
                if len(rows):
                    todo.extend((child, rows) for child in self.splits[node][2:])
                continue
            for block in self.leaf_blocks[-node - 1]:
                for r in rows[self._near(vec[rows], bound[rows], self.low[block], self.high[block])]:
                    found[r].append(block)
        return [f if len(f) <= most else [EVERYWHERE] for f in found]


def _kd_tree(points: DataFrame, n_points: int, block_points: int) -> _Tree:
    """Split a bounded sample at medians of the widest dimension.

    The sample only steers the layout; results do not depend on it.
    """
    share = min(1.0, SAMPLE_POINTS / n_points)
    rows = points.select("vec").sample(share, seed=7).limit(2 * SAMPLE_POINTS).toPandas()
    values = _matrix(rows["vec"])
    target = max(16, int(block_points * 0.75 * len(values) / n_points))
    splits: list = []
    leaves = 0

    def grow(members: np.ndarray) -> int:
        nonlocal leaves
        part = values[members]
        spread = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(1)
        if len(members) <= target or spread.max() == 0:
            leaves += 1
            return -leaves
        dim = int(np.argmax(part.std(axis=0)))
        threshold = float(np.median(part[:, dim]))
        if threshold == part[:, dim].max():
            threshold = float(part[part[:, dim] < threshold, dim].max())
        below = part[:, dim] <= threshold
        at = len(splits)
        splits.append(None)
        left, right = grow(members[below]), grow(members[~below])
        splits[at] = (dim, threshold, left, right)
        return at

    if len(values):
        grow(np.arange(len(values)))
    else:
        leaves = 1
    return _Tree(splits, leaves)


def tomek_links(rows: DataFrame, label: str) -> DataFrame:
    """Pairs of opposite classes that are each other's nearest neighbour: (rid, neighbour)."""
    marked = rows.select("rid", "vec", F.array(F.col(label).cast("string")).alias("cats"), F.col(label).alias("_own"))
    first = nearest(marked, marked, 1, carry=["cats"]).select("rid", "neighbour", F.col("other_cats")[0].alias("_other"))
    opposite = first.join(marked.select("rid", F.col("_own").cast("string").alias("_own")), "rid").where(
        F.col("_own") != F.col("_other")
    )
    opposite = materialize(opposite.select("rid", "neighbour"), "opposite-neighbours")
    back = opposite.select(F.col("neighbour").alias("rid"), F.col("rid").alias("neighbour"))
    return opposite.join(back, ["rid", "neighbour"], "left_semi")
