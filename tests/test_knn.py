import math
import random

import pytest

from counterpoise.operators import knn


def brute(queries, refs, k, exclude=True, penalty=0.0):
    out = {}
    for q in queries:
        found = []
        for r in refs:
            if exclude and r[0] == q[0]:
                continue
            total = sum((a - b) ** 2 for a, b in zip(q[1], r[1]))
            if len(q) > 2:
                total += penalty * sum(a != b for a, b in zip(q[2], r[2]))
            found.append((round(math.sqrt(total), 9), r[0]))
        out[q[0]] = sorted(found)[:k]
    return out


def result(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["rid"], []).append((r["rank"], round(r["dist"], 9), r["neighbour"]))
    return {q: [(d, n) for _, d, n in sorted(v)] for q, v in out.items()}


def points(n, seed, dims=2, hot=True):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        if hot and i % 3 == 0:
            rows.append((i, [1.0] * dims))  # a third of all rows are copies
        else:
            rows.append((i, [float(pick.randint(0, 12)) for _ in range(dims)]))
    return rows


@pytest.mark.parametrize("block", [4096, 40])
@pytest.mark.parametrize("exclude", [True, False])
def test_exact_with_copies_and_ties(spark, monkeypatch, block, exclude):
    monkeypatch.setattr(knn, "BLOCK_POINTS", block)
    rows = points(400, 3)
    df = spark.createDataFrame(rows, "rid bigint, vec array<double>").repartition(5)
    got = result(knn.nearest(df, df, 4, exclude_self=exclude))
    assert got == brute(rows, rows, 4, exclude)


def test_exact_in_many_blocks_with_string_ids(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_POINTS", 32)
    pick = random.Random(8)
    rows = [(f"r{i:04d}", [pick.gauss(0, 1) for _ in range(5)]) for i in range(500)]
    queries = [(f"q{i}", [pick.gauss(0, 2) for _ in range(5)]) for i in range(60)]
    refs = spark.createDataFrame(rows, "rid string, vec array<double>")
    asked = spark.createDataFrame(queries, "rid string, vec array<double>")
    assert result(knn.nearest(asked, refs, 3, exclude_self=False)) == brute(queries, rows, 3, False)


@pytest.mark.parametrize("block", [4096, 25])
def test_mixed_metric(spark, monkeypatch, block):
    monkeypatch.setattr(knn, "BLOCK_POINTS", block)
    pick = random.Random(4)
    rows = [(i, [float(pick.randint(0, 30))], [pick.choice("abc"), pick.choice("xy")]) for i in range(200)]
    df = spark.createDataFrame(rows, "rid bigint, vec array<double>, cats array<string>")
    got = result(knn.nearest(df, df, 5, penalty=12.5, digits=9))
    assert got == brute(rows, rows, 5, True, 12.5)


def test_fewer_points_than_neighbours(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "rid bigint, vec array<double>")
    assert result(knn.nearest(df, df, 5)) == {1: [(1.0, 2)], 2: [(1.0, 1)]}


def test_tomek_links(spark):
    rows = [(1, [0.0], 0), (2, [1.0], 1), (3, [10.0], 0), (4, [10.5], 0), (5, [3.0], 1)]
    df = spark.createDataFrame(rows, "rid bigint, vec array<double>, y int")
    assert {(r["rid"], r["neighbour"]) for r in knn.tomek_links(df, "y").collect()} == {(1, 2), (2, 1)}


@pytest.mark.parametrize("carry", [False, True])
def test_far_blocks_are_met_as_slabs(spark, monkeypatch, carry):
    """In many dimensions every block is near; queries go to slabs, and the product leaves no neighbour out."""
    monkeypatch.setattr(knn, "BLOCK_POINTS", 32)
    monkeypatch.setattr(knn, "MATRIX_CELLS", 2000)
    seen = []
    whole = knn._cells
    monkeypatch.setattr(knn, "_cells", lambda queries, blocked, counts, *rest: (seen.append(len(counts)), whole(queries, blocked, counts, *rest))[1])
    pick = random.Random(4)
    rows = [(i, [1000.0 + pick.gauss(0, 1) for _ in range(12)]) for i in range(700)]
    rows += [(700 + i, list(rows[i % 5][1])) for i in range(40)] + [(800, [1e4] * 12)]
    df = spark.createDataFrame(rows, "rid bigint, vec array<double>").repartition(5)
    found = knn.nearest(df, df, 3, carry=carry)
    assert result(found) == brute(rows, rows, 3)
    assert max(seen[1:]) < seen[0] / 4  # slabs, not blocks
    if carry:
        own = {r: v for r, v in rows}
        assert all(list(r["other_vec"]) == own[r["neighbour"]] for r in found.collect())


def test_product_never_excludes_a_neighbour():
    """Vectors far from their middle, and one outlier that sets the scale."""
    import numpy as np

    pick = np.random.default_rng(2)
    for vec in (1e6 + pick.normal(size=(300, 16)), np.vstack([pick.normal(size=(299, 16)), np.full((1, 16), 1e12)]), np.ones((50, 16)), pick.normal(size=(300, 16)) * 1e-40):
        product = knn._Product.of(vec, vec)
        if product is None:
            continue
        squares, error = product.squares(slice(0, len(vec)))
        gap = vec[:, None] - vec[None]
        exact = np.sqrt((gap * gap).sum(axis=2))
        assert all((squares[i] <= product.limit(exact[i], np.full(len(vec), error[i]))).all() for i in range(len(vec)))
