import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpoise.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, queries, k):
    """Exact answer in double precision from the usable rows."""
    usable = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = set()
    for q, v in usable:
        if q in queries:
            near = sorted((-round(float(v @ w / math.sqrt(v @ v) / math.sqrt(w @ w)), 12), i) for i, w in usable if i != q and len(w) == len(v))
            out |= {(q, r + 1, i) for r, (_, i) in enumerate(near[:k])}
    return out


def test_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 24))
    vectors = (centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 24)) * 0.6).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = hnsw.neighbours(docs, F.col("vec_id") % 50 == 0, shard_rows=700).collect()
    want = brute(rows, set(range(0, 3000, 50)), 5)
    assert len(got) == len(want) == 300
    found = {(r["query_id"], r["vec_id"]) for r in got}
    assert len(found & {(q, i) for q, _, i in want}) / 300 >= 0.9
    for r in got:
        a, b = (vectors[r[c]].astype(np.float64) for c in ("query_id", "vec_id"))
        assert r["score"] == pytest.approx(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), abs=1e-12)


def test_copies_ties_and_odd_vectors(spark):
    hot = [1.0, 0.0]
    rows = [(i, hot) for i in range(0, 40)] + [
        (100, [0.0, 1.0]), (101, [0.6, 0.8]), (102, None), (103, [0.0, 0.0]), (104, [1.0, None]), (105, [float("nan"), 1.0]), (106, [float("inf"), 1.0]),
        (107, []), (None, hot), (108, [1.0, 0.0, 0.0]), (109, [0.0, 2.0, 1.0]), (3, hot),
    ]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).withColumn("_q", F.lit(1))
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in hnsw.neighbours(docs, F.col("vec_id").isin(0, 39, 100, 102, 103, 108)).collect()}
    rows.remove((3, hot))
    assert got == brute(rows, {0, 39, 100, 102, 103, 108}, 5)
    assert {(r, i) for q, r, i in got if q == 0} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)}
    assert {i for q, _, i in got if q == 108} == {109}


def test_huge_and_tiny_numbers(spark):
    rows = [(0, [1e30, 1e30]), (1, [1e-30, 1e-30]), (2, [1.0, -1.0])]
    got = {(r["vec_id"], round(r["score"], 9)) for r in hnsw.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()}
    assert got == {(1, 1.0), (2, 0.0)}


def test_empty_and_single(spark):
    docs = spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)
    assert hnsw.neighbours(docs.limit(0), F.lit(True)).count() == 0
    assert hnsw.neighbours(docs, F.lit(True)).count() == 0


def test_graph_finds_every_node():
    units = hnsw.unit(np.random.default_rng(5).normal(size=(500, 16)))
    graph = hnsw.Graph.build(units)
    assert sum(graph.search(units[i], 20)[0] == i for i in range(500)) >= 495


def test_blocks_of_queries_are_not_broadcast(spark, monkeypatch):
    """Each block has a copy for every shard; together they outgrow a driver, however short the queries were before."""
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)).astype(np.float32))] + [(300, [1.0, 2.0]), (301, [2.0, 1.0]), (7, [1.0, 0.5])]
    asked = F.col("vec_id") % 3 == 0
    docs = spark.createDataFrame(rows, SCHEMA)
    whole = {tuple(r) for r in hnsw.neighbours(docs, asked, shard_rows=50).collect()}
    monkeypatch.setattr(hnsw, "QUERY_ROWS", 16, raising=False)
    monkeypatch.setattr(hnsw, "MEETING_TASKS", 3, raising=False)
    found = hnsw.neighbours(docs, asked, shard_rows=50)
    assert {tuple(r) for r in found.collect()} == whole and len({r[0] for r in whole}) == 101
    assert {(q, r, i) for q, r, i, _ in whole if q == 300} == {(300, 1, 7), (300, 2, 301)}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
