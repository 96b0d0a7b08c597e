import numpy as np
import pytest

from counterpoise.llm import quality

RNG = np.random.default_rng(4)


def good(rng):
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(rng.integers(20, 80))) + "."


def bad(rng):
    word = "".join(rng.choice(list("abcdefghij"), 5))
    return rng.choice([f"{word} " * 40, good(rng).upper() + "!!", good(rng).replace(" ", "### ")])


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(1)
    return [(good(rng), 1) if rng.random() < 0.7 else (bad(rng), 0) for _ in range(3000)]


def test_prior_and_held_out_accuracy(texts):
    x = np.array([quality.features(t) for t, _ in texts])
    y = np.array([label for _, label in texts])
    positives = x[:1500][y[:1500] == 1]
    model = quality.fit_sample(positives[:600], x[:1500])
    assert abs(model.prior - 0.7) < 0.15
    scores = model.score(x[1500:])
    assert ((scores >= 0.5) == y[1500:]).mean() > 0.9


def test_risk_does_not_fall_below_zero():
    """With far too high a prior the negative part is clipped and weights stay finite."""
    rng = np.random.default_rng(0)
    w = quality.fit_nnpu(rng.normal(1, 1, (100, 3)), rng.normal(0, 1, (200, 3)), prior=0.95)
    assert np.isfinite(w).all() and np.abs(w).max() < 50


def test_fit_and_score_in_spark(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(texts)], "doc_id long, text string, score string")
    positives = spark.createDataFrame([(i,) for i, (_, label) in enumerate(texts) if label == 1 and i < 1500] + [(None,)], "doc_id long")
    model = quality.fit(docs.where("doc_id < 1500"), positives, n_positive=500, n_unlabelled=1200)
    got = quality.score(docs, model)
    assert got.columns == ["doc_id", "text", "score", "score_1", "predicted"]
    rows = got.where("doc_id >= 1500").collect()
    assert np.mean([r["predicted"] == texts[r["doc_id"]][1] for r in rows]) > 0.88
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 300_000), (3, "word " * 300_000), (None, "a")], "doc_id int, text string")
    scores = [r["score"] for r in quality.score(odd, model).collect()]
    assert all(0 <= s <= 1 for s in scores) and scores[0] == scores[1] and scores[2] == scores[3]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    model = quality.fit(docs, none)
    row = quality.score(docs, model).first()
    assert (row["score"], row["predicted"]) == (0.5, 1)
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), none)).count() == 0
