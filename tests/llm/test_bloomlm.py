import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from counterpoise.llm import bloomlm

SCHEMA = "doc_id long, text string"


def tokens(text):
    lower = (text or "").encode().lower().decode()
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def corpus(rng, n=120):
    pool = [f"w{k}" for k in range(60)]
    return [(i, " ".join(rng.choice(pool[: rng.randrange(2, 60)]) for _ in range(rng.randrange(1, 80)))) for i in range(n)]


@pytest.mark.parametrize("head", [1 << 20, 10, 0])
def test_base_is_exact(spark, head):
    rows = corpus(random.Random(1)) + [(900, None), (901, ""), (902, "ÄB äb\x0bX x\x1fx"), (902, "ÄB äb\x0bX x\x1fx"), (None, "w1 unseen")]
    train = [r for r in rows if r[0] is not None and r[0] % 3]
    docs = spark.createDataFrame(rows, SCHEMA)
    model, rare = bloomlm.fit(docs.where("doc_id % 3 <> 0"), head_words=head)
    counts = Counter(t for _, body in train for t in tokens(body))
    n, v = sum(counts.values()), len(counts)
    assert (model.train_tokens, model.distinct, len(model.head_keys) <= head) == (n, v, True)
    got = bloomlm.score(docs, model, rare).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"]): r for r in got}
    for i, body in rows:
        seq = tokens(body)
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in seq)
        assert (by[i]["n_tokens"], by[i]["n_known"], by[i]["train_tokens"]) == (len(seq), sum(t in counts for t in seq), n)
        assert by[i]["base_score"] == pytest.approx(base, abs=1e-9)
        assert by[i]["score"] <= 0


def test_filter_reads_back_levels():
    rng = np.random.default_rng(3)
    keys = bloomlm._mix(rng.integers(0, 2**63, 4000).astype(np.uint64))
    counts = np.ceil(rng.pareto(0.8, 4000) + 1).astype(np.int64)
    segments, slice_bits = 8, 8 * 4000
    bits = np.concatenate([bloomlm.fill(slice_bits, keys[p], counts[p]) for s in range(segments) for p in [bloomlm.segment_of(keys, segments) == s]])
    model = bloomlm.BloomModel(bits, slice_bits, segments, 1, np.empty(0, np.uint64), np.empty(0, np.int64), 1, 1, 1)
    exact = bloomlm.middle(bloomlm.levels(counts))
    read = model.stored(keys)
    assert (read >= exact).all() and (read == exact).mean() > 0.95
    unseen = bloomlm._mix(rng.integers(0, 2**63, 4000).astype(np.uint64))
    assert (model.stored(unseen) == 0).mean() > 0.95


def test_levels():
    counts = np.arange(1, 2000)
    level = bloomlm.levels(counts)
    assert (np.diff(level) >= 0).all() and level[0] == 1
    for j in range(1, level.max()):
        if (own := counts[level == j]).size:
            assert bloomlm.middle(np.array([j]))[0] == own.mean()


def test_bounded_filter_keeps_the_commonest(spark):
    docs = spark.createDataFrame(corpus(random.Random(5)), SCHEMA)
    whole, _ = bloomlm.fit(docs, head_words=5)
    small, rare = bloomlm.fit(docs, head_words=5, filter_bytes=200)
    assert whole.cutoff == 1 < small.cutoff
    assert len(small.bits) <= 200 * 1.05 + small.segments
    assert bloomlm.score(docs, small, rare).count() == 120


def test_predecessors_matter(spark):
    """'b' always follows 'a': the model must find a text in this order likelier than the turned one."""
    docs = spark.createDataFrame([(i, "a b " * 20) for i in range(50)] + [(99, "c a d b")], SCHEMA)
    model, rare = bloomlm.fit(docs)
    got = {r["doc_id"]: r for r in bloomlm.score(spark.createDataFrame([(1, "a b a b"), (2, "b b a a")], SCHEMA), model, rare).collect()}
    assert got[1]["score"] > got[2]["score"] + 2
    assert got[1]["base_score"] == pytest.approx(got[2]["base_score"])


def test_no_training_text_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "one two", "x"), (2, None, "y")], "doc_id long, text string, score string")
    model, rare = bloomlm.fit(docs.limit(0))
    got = bloomlm.score(docs, model, rare)
    assert got.columns == ["doc_id", "score", "n_tokens", "n_known", "train_tokens", "base_score", "score_1"]
    assert [(r["n_tokens"], r["n_known"], r["base_score"], r["score_1"]) for r in got.orderBy("doc_id").collect()] == [(3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)]
    assert bloomlm.score(docs.limit(0), model, rare).count() == 0


@pytest.mark.parametrize("filter_bytes", [0, 2000])
def test_what_the_filter_leaves_out_is_joined(spark, filter_bytes):
    """Scores do not depend on what fits the filter."""
    rows = corpus(random.Random(7)) + [(900, None), (901, "w1 unseen w2 w1"), (901, "w1 unseen w2 w1")]
    train = [body for i, body in rows if i % 3]
    docs = spark.createDataFrame(rows, SCHEMA)
    model, rare = bloomlm.fit(docs.where("doc_id % 3 <> 0"), head_words=5, filter_bytes=filter_bytes)
    assert model.cutoff > 1
    head = set(model.head_keys.tolist())
    one, two = Counter(t for body in train for t in tokens(body)), Counter()
    for body in train:
        seq = tokens(body)
        two.update(zip(["start", *seq], seq))
    n, v = sum(one.values()), len(one)

    def count(counter, key, exact=False):
        c = counter[key]
        return float(bloomlm.middle(bloomlm.levels(np.array([c])))[0]) if c and not exact else float(c)

    def single(t):
        h = bloomlm.END if t is None else bloomlm.token_hashes(t)[0]
        return count(one, t, h in head)

    off = []
    got = sorted((r["doc_id"], r["score"]) for r in bloomlm.score(docs, model, rare).collect())
    for (i, body), (j, score) in zip(sorted(rows, key=lambda r: r[0]), got):
        assert i == j
        total, last = 0.0, "start"
        for t in tokens(body):
            own, context = single(t), float(len(train)) if last == "start" else single(last)
            alone = (own + 0.1) / (n + 0.1 * (v + 1))
            pair = min(count(two, (last, t)), context, max(own, 1))
            total, last = total + math.log10((pair + 50 * alone) / (context + 50)), t
        off.append(abs(score - total))
    assert max(off) < (1e-9 if filter_bytes == 0 else 5) and sorted(off)[len(off) // 2] < 0.2


def test_scoring_holds_few_tokens_at_a_time():
    texts = ["a b c"] * 100_000
    held = [len(tokens) for tokens, _ in bloomlm.batches_of_tokens(texts, bloomlm.SCORED_TOKENS)]
    assert sum(held) == 400_000 and max(held) <= 100_003


def test_tokens_are_looked_up_in_blocks(spark):
    """What the filter and the head leave out is asked for by segment, not with a row for every token."""
    docs = spark.createDataFrame(corpus(random.Random(11)), SCHEMA)
    model, counted = bloomlm.fit(docs, head_words=5, filter_bytes=0)
    scored = bloomlm.score(docs, model, counted)
    assert "Generate" not in scored._jdf.queryExecution().toString()
    assert counted.count() == model.segments
    assert scored.count() == 120
