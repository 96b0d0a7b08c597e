import random

import numpy as np
import pytest

from counterpoise.llm import chosenpath
from counterpoise.llm.common import words
from counterpoise.llm.graph import components


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    n = len(rows)
    near = [[i != j and bool(sets[i]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 for j in range(n)] for i in range(n)]
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if near[i][j] and root[j] < root[i]:
                    root[i], changed = root[j], True
    groups = {}
    for i in range(n):
        groups.setdefault(root[i], []).append(rows[i][0])
    return sorted((rows[i][0], min(x for x in groups[root[i]]), sum(near[i])) for i in range(n))


def corpus(rng, groups=12, size=9):
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 8, 40, 120]))]
        for _ in range(rng.randrange(1, size)):
            text = list(base)
            for _ in range(rng.randrange(3)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("small", [256, 2])
def test_brute_force(spark, small):
    """With tiny parts, every level of paths and the search in blocks are used."""
    rows = corpus(random.Random(8), groups=12 if small > 2 else 5)
    rows += [(len(rows) + k, t) for k, t in enumerate(["", "?!", "one two", "One, two.", rows[0][1]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = chosenpath.join(docs, small=small, recall=0.9999).select("id", "class_id", "n_links")
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_recall_of_pairs_at_the_threshold():
    """Pairs whose similarity is just high enough meet in nearly all cases, on every level."""
    rng = np.random.default_rng(2)
    met = 0
    for _ in range(300):
        both = rng.integers(0, 2**40, 80, dtype=np.uint64)
        one, two = np.unique(both), np.unique(np.concatenate([both, rng.integers(0, 2**40, 20, dtype=np.uint64)]))
        own, p, q, r = chosenpath.paths([one, two], chosenpath.n_runs(), 0.8)
        ends = [set(zip(p[own == k], q[own == k], r[own == k])) for k in (0, 1)]
        met += bool({e for e in ends[0] & ends[1] if e[2]})
    assert met >= 296


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, long, 3), (4, long, 4), (4, long, 4), (None, long + " more", 5)], "doc_id int, text string, fp int")
    got = {(r["id"], r["n_links"], r["class_id"]) for r in chosenpath.join(docs).collect()}
    assert got == {(1, 0, 1), (2, 0, 2), (3, 3, 3), (4, 3, 3), (None, 3, 3)}
    kept = chosenpath.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.select("doc_id", "fp").collect()) == [(1, 1), (2, 2), (3, 3)]
    assert chosenpath.join(docs.limit(0)).count() == 0 and chosenpath.keep_one(docs.limit(0)).count() == 0


def test_repeated_rows_keep_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(None, "a b c d e f"), (None, "q r s t u v")], "doc_id int, text string")
    assert sorted(chosenpath.keep_one(docs).select("text").collect()) == [("a b c d e f",), ("q r s t u v",)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200 + k, 201 + k) for k in range(40)] + [(5, 5), (5, 5)]
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: v for k, v in root.items() if k != v}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_few_and_many_partners_are_compared_alike():
    import numpy as np

    rng = np.random.default_rng(4)
    base = np.arange(40, dtype=np.uint64) * np.uint64(1001)
    sets = [np.unique(np.concatenate([base[rng.random(40) < 0.93], rng.integers(0, 2**39, rng.integers(1, 6)).astype(np.uint64)])) for _ in range(24)]
    like = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9
    for reach in (2, 23):
        partners = [[j for j in range(k + 1, min(24, k + 1 + reach))] for k in range(24)]
        rows = [(k, k + 1, partners[k], chosenpath.pack(x)) for k, x in enumerate(sets)]
        wanted = dict.fromkeys(range(24), 0)
        for k in range(24):
            for j in partners[k]:
                if like(sets[k], sets[j]):
                    wanted[k] += j + 1
                    wanted[j] += k + 1
        assert {fp: links for fp, links, _ in chosenpath.compare(rows, 0.8)} == {k: n for k, n in wanted.items() if n}
        assert any(wanted.values())


def test_a_group_of_near_copies_is_sent_to_few_blocks(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join([*words, f"x{rng.random()}"]) for _ in range(64)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, write = {}, chosenpath.materialize

    def counted(df, name):
        out = write(df, name)
        rows[name] = out.groupBy("part").count().agg({"count": "max"}).first()[0] if name == "needed" else 0
        return out

    monkeypatch.setattr(chosenpath, "materialize", counted)
    got = chosenpath.join(docs, small=8, recall=0.9).select("class_id", "n_links").distinct().collect()
    assert [tuple(r) for r in got] == [(0, 63)]
    assert 64 <= rows["needed"] <= 64 * 4


def test_a_part_of_sets_holds_few_tokens():
    texts = [" ".join(f"w{i}x{j}" for j in range(1004)) for i in range(120)]
    sizes = [sum(map(len, part)) for part in chosenpath.in_parts(texts)]
    assert sum(sizes) == 120 * 1000 and max(sizes) < 52_000
