"""Quality classifier learned from positives and unlabelled text.

Only trusted positives are labelled; the rest of the web is unlabelled and holds
good and bad text in unknown proportion.  The class prior is estimated first: a
plain classifier of positives against unlabelled text ranks held-back rows, and the
smallest quotient of the shares of unlabelled and of positive rows above a
threshold is the share of positives (with an allowance for few rows).  Then a
linear model minimises the non-negative unbiased risk

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))

with logistic loss.  When the second part of a batch falls below zero, the step is
taken against it, which keeps the model from fitting single unlabelled rows.

Fitting uses at most ``N_POSITIVE`` positives and ``N_UNLABELLED`` unlabelled rows,
those with the smallest hashes of their ids; this is the only bound.  Scoring reads
every whole text.  Features are counts of hashed byte pairs and triples of the whole
text and a few proportions; they need no vocabulary.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.llm import common

N_POSITIVE = 3000
N_UNLABELLED = 9000
BINS = 1024
SLICE = 1 << 20
EPOCHS = 30
BATCH = 256


def features(text: str | None) -> np.ndarray:
    """Fixed-length description of a whole text; an empty or null one has zeros only."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    pairs, triples, single = np.zeros(BINS), np.zeros(BINS), np.zeros(256)
    for at in range(0, len(data), SLICE):
        part = data[at : at + SLICE + 2].astype(np.uint32)
        single += np.bincount(part[:SLICE], minlength=256)
        code = part[:-1] * 256 + part[1:]
        pairs += np.bincount((code[:SLICE] * np.uint32(2654435761)) >> np.uint32(22), minlength=BINS)
        if len(part) > 2:
            code = (code[:-1] << np.uint32(8)) + part[2:]
            triples += np.bincount((code[:SLICE] * np.uint32(2246822519)) >> np.uint32(22), minlength=BINS)
    n = max(len(data), 1)
    seq, lines = (text or "").split(), (text or "").split("\n")
    again = sum(map(operator.eq, seq, seq[1:])) / max(len(seq) - 1, 1)
    shares = [
        again,
        len(set(zip(seq, seq[1:]))) / max(len(seq) - 1, 1),
        len(set(seq)) / max(len(seq), 1),
        len(set(lines)) / len(lines),
        single[65:91].sum() / n,
        single[48:58].sum() / n,
        (single[33:48].sum() + single[58:65].sum() + single[91:97].sum() + single[123:127].sum()) / n,
        single[:33].sum() / n,
    ]
    asks = [np.log1p(len(data)) / 10, len(data) / max(len(seq), 1) / 20, single[97:123].sum() / n, single[128:].sum() / n, *np.sqrt(shares)]
    steps = (np.array(shares)[:, None] > STEPS[None, :]).ravel()
    roots = [np.sqrt(x / max(x.sum(), 1)) for x in (pairs, triples)]
    return np.concatenate([*roots, asks, steps]).astype(np.float32) * bool(len(data))


STEPS = np.array([0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
N_FEATURES = 2 * BINS + 12 + 8 * len(STEPS)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Adam:
    def __init__(self, size: int, rate: float = 0.02):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, w: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad**2
        return w - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1), x.dtype)])


def fit_nnpu(p: np.ndarray, u: np.ndarray, prior: float, epochs: int = EPOCHS, decay: float = 1e-4, seed: int = 0) -> np.ndarray:
    """Weights (bias last) that minimise the non-negative risk."""
    p, u = _with_one(p), _with_one(u)
    rng, w = np.random.default_rng(seed), np.zeros(p.shape[1])
    adam = Adam(len(w))
    for _ in range(epochs):
        order = rng.permutation(len(u))
        for at in range(0, len(u), BATCH):
            xu, xp = u[order[at : at + BATCH]], p[rng.integers(0, len(p), min(BATCH, len(p)))]
            zp, zu = xp @ w, xu @ w
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            grad_negative = xu.T @ _sigmoid(zu) / len(xu) - prior * (xp.T @ _sigmoid(zp)) / len(xp)
            grad_positive = -prior * (xp.T @ _sigmoid(-zp)) / len(xp)
            grad = grad_positive + grad_negative if negative >= 0 else -grad_negative
            w = adam.step(w, grad + decay * w)
    return w


def _fit_plain(p: np.ndarray, u: np.ndarray, epochs: int = 10, seed: int = 0) -> np.ndarray:
    x = _with_one(np.vstack([p, u]))
    y = np.concatenate([np.ones(len(p)), np.zeros(len(u))])
    weight = np.where(y == 1, 0.5 / len(p), 0.5 / len(u)) * len(y)
    rng, w = np.random.default_rng(seed), np.zeros(x.shape[1])
    adam = Adam(len(w))
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            b = order[at : at + BATCH]
            w = adam.step(w, x[b].T @ (weight[b] * (_sigmoid(x[b] @ w) - y[b])) / len(b) + 1e-4 * w)
    return w


def estimate_prior(p: np.ndarray, u: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives in ``u``: the best-bin estimate on rows held back from a plain classifier."""
    cut_p, cut_u = (2 * len(p)) // 3, (2 * len(u)) // 3
    if min(cut_p, cut_u, len(p) - cut_p, len(u) - cut_u) < 1:
        return 0.5
    w = _fit_plain(p[:cut_p], u[:cut_u])
    zp, zu = np.sort(_with_one(p[cut_p:]) @ w), np.sort(_with_one(u[cut_u:]) @ w)
    above_p = 1 - np.arange(len(zp)) / len(zp)  # share of positives at or above each of their scores
    above_u = 1 - np.searchsorted(zu, zp, "left") / len(zu)
    slack = np.sqrt(np.log(4 / delta) / 2 / len(zp)) + np.sqrt(np.log(4 / delta) / 2 / len(zu))
    best = np.argmin((above_u + slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


@dataclass(frozen=True)
class QualityModel:
    """Standardised linear model; without positives or unlabelled rows all scores are one half."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_with_one((x - self.mean) / self.scale) @ self.weights)


def fit_sample(p: np.ndarray, u: np.ndarray) -> QualityModel:
    if not len(p) or not len(u):
        return QualityModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1), 0.5)
    mean = u.mean(axis=0)
    scale = np.sqrt(u.var(axis=0) + 1e-6) * 4
    p, u = (p - mean) / scale, (u - mean) / scale
    prior = estimate_prior(p, u)
    return QualityModel(mean, scale, fit_nnpu(p, u, prior), prior)


def _smallest(ids: DataFrame, n: int) -> DataFrame:
    return ids.where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(n)


def fit(docs: DataFrame, positives: DataFrame, id_col: str = "doc_id", text: str = "text", n_positive: int = N_POSITIVE, n_unlabelled: int = N_UNLABELLED) -> QualityModel:
    """Model from the texts of ``positives`` (ids) and the unlabelled rows of ``docs``.

    Null ids teach nothing.  The unlabelled sample is drawn from all ``docs``,
    labelled or not, as the prior is the share of positives among all.  Both id
    lists are bounded by the two parameters, so that they are broadcast; the sampled
    features are fitted in one task.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("body"))
    chosen_p = _smallest(positives.select(F.col(id_col).alias("id")), n_positive).withColumn("p", F.lit(True))
    chosen_u = _smallest(rows.select("id"), n_unlabelled).withColumn("u", F.lit(True))
    chosen = chosen_p.join(chosen_u, "id", "full")
    sample = rows.join(F.broadcast(chosen), "id")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t).astype(np.float16).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(found, pa.binary())], names=["id", "p", "u", "x"])

    schema = T.StructType([rows.schema["id"], T.StructField("p", T.BooleanType()), T.StructField("u", T.BooleanType()), T.StructField("x", T.BinaryType())])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))), key=lambda r: (str(r[0]), r[3]))
        table = np.array([np.frombuffer(r[3], np.float16) for r in found], np.float32).reshape(len(found), N_FEATURES)
        rng = np.random.default_rng(1)
        pick = lambda k: rng.permutation([i for i, r in enumerate(found) if r[k]]).astype(int)
        model = fit_sample(table[pick(1)], table[pick(2)])
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(x, np.float64).tobytes()], pa.binary()) for x in (model.mean, model.scale, model.weights, [model.prior])], names=["mean", "scale", "weights", "prior"])

    described = common.map_batches(sample.select("id", "body", "p", "u"), describe, schema)
    row = common.map_batches(described.repartition(1), train, "mean binary, scale binary, weights binary, prior binary").first()
    if row is None:
        return fit_sample(np.empty((0, N_FEATURES)), np.empty((0, N_FEATURES)))
    mean, scale, weights, prior = (np.frombuffer(x, np.float64) for x in row)
    return QualityModel(mean, scale, weights, float(prior[0]))


def score(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` double in [0, 1] and ``predicted`` int (1 from one half up); null texts count as empty.

    The two columns get a number behind their name where ``docs`` has that name.
    """
    spot = docs.columns.index(text)
    names = common.fresh(docs, "score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    handed = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for at in range(0, batch.num_rows, 512):
                part = batch.column(spot).slice(at, 512).to_pylist()
                scores[at : at + 512] = handed.value.score(np.array([features(t) for t in part]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[*batch.schema.names, *names])

    return common.map_batches(docs, run, schema)
