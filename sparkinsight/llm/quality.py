"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text train a small network that
minimises the non-negative unbiased risk: prior * R+(positives) + max(0, R-(unlabelled)
- prior * R-(positives)).  The class prior is estimated from the scores of a first
classifier: the least ratio, over score levels, of the share of unlabelled texts to the
share of held-back positives above the level.  Labels 0 are never used.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, fold

MARKS = b".,;:!?|%&$#*\"'()-_=<>/@"
N_FEATURES = 16 + len(MARKS)


def features(text: bytes) -> np.ndarray:
    """Shape of a whole text: character classes, word repetition, lines."""
    out = np.zeros(N_FEATURES, np.float64)
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = max(1, len(text))
    upper, lower, digit = c[65:91].sum(), c[97:123].sum(), c[48:58].sum()
    words = text.split()
    k = len(words)
    out[:6] = upper / n, lower / n, digit / n, c[128:].sum() / n, (c[32] + c[9]) / n, c[10] / n
    out[16:] = np.minimum(0.2, c[list(MARKS)] / n) * 5
    out[6] = np.log1p(k) / 10
    if k:
        seen = Counter(words)
        top = seen.most_common(1)[0][1]
        out[7] = len(seen) / k
        out[8] = top / k
        out[9] = sum(map(eq, words, words[1:])) / k
        lens = np.fromiter(map(len, words), np.float64, k)
        out[10:13] = lens.mean() / 20, min(2.0, lens.std() / 10), (lens <= 3).mean()
        lines = text.splitlines()
        out[13] = len(set(lines)) / max(1, len(lines))
        third = list(zip(words, words[1:], words[2:]))
        out[14] = len(set(third)) / len(third) if third else 1.0
        out[15] = min(2.0, np.log1p(k / max(1, len(lines))) / 3)
    return out


class Net:
    """One hidden layer, logit out; plain numpy with Adam."""

    def __init__(self, n: int, hidden: int, seed: int):
        g = np.random.default_rng(seed)
        self.p = [g.standard_normal((n, hidden)) / n ** 0.5, np.zeros(hidden), g.standard_normal(hidden) / hidden ** 0.5, np.zeros(1)]
        self.m = [(np.zeros_like(x), np.zeros_like(x)) for x in self.p]
        self.step = 0

    def logit(self, x):
        W, b, o, c = self.p
        return np.tanh(x @ W + b) @ o + c

    def update(self, x, dlogit, rate, decay=1e-4):
        W, b, o, c = self.p
        h = np.tanh(x @ W + b)
        dh = dlogit[:, None] * o * (1 - h * h)
        self.step += 1
        for p, (m, v), g in zip(self.p, self.m, (x.T @ dh, dh.sum(0), h.T @ dlogit, np.array([dlogit.sum()]))):
            g = g + decay * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9 ** self.step)) / (np.sqrt(v / (1 - 0.99 ** self.step)) + 1e-8)


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def train_nnpu(pos, unl, prior: float, hidden: int = 16, epochs: int = 40, batch: int = 256, rate: float = 5e-3,
               seed: int = 3) -> Net:
    """Minimise the non-negative risk with the logistic loss.

    When the estimate of the negative risk falls below zero, the step goes against it
    (the correction that keeps a flexible model from fitting the unlabelled texts).
    """
    net, rng = Net(pos.shape[1], hidden, seed), np.random.default_rng(seed)
    rounds = max(1, len(unl) // batch)
    for _ in range(epochs):
        pi, ui = rng.permutation(len(pos)), rng.permutation(len(unl))
        for p, u in zip(np.array_split(pi, rounds), np.array_split(ui, rounds)):
            if not len(p) or not len(u):
                continue
            xp, xu = pos[p], unl[u]
            sp, su = sigmoid(net.logit(xp)), sigmoid(net.logit(xu))
            softplus = lambda s: -np.log(np.maximum(1 - s, 1e-12))  # noqa: E731  loss of class 0
            negative = softplus(su).mean() - prior * softplus(sp).mean()
            x = np.concatenate([xp, xu])
            down = np.concatenate([-prior * sp / len(p), su / len(u)])  # gradient of the negative risk
            if negative < 0:
                net.update(x, -down, rate)
            else:
                up = np.concatenate([prior * (sp - 1) / len(p), np.zeros(len(u))])
                net.update(x, up + down, rate)
    return net


def estimate_prior(pos, unl, seed: int = 3) -> float:
    """Share of positives among unlabelled texts.

    Half of each side trains a positive-against-unlabelled classifier; on the other
    half, the least ratio (share of unlabelled above t) / (share of positives above t),
    with a margin for chance at small shares.
    """
    half = lambda a: (a[::2], a[1::2])
    (p1, p2), (u1, u2) = half(pos), half(unl)
    if not len(p2) or not len(u2):
        return 0.5
    net, rng = Net(pos.shape[1], 16, seed), np.random.default_rng(seed)
    x = np.concatenate([p1, u1])
    y = np.concatenate([np.ones(len(p1)), np.zeros(len(u1))])
    w = np.concatenate([np.full(len(p1), 0.5 / len(p1)), np.full(len(u1), 0.5 / len(u1))]) * len(x)
    for _ in range(20):
        for b in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            net.update(x[b], (sigmoid(net.logit(x[b])) - y[b]) * w[b] / len(b), 5e-3)
    sp, su = np.sort(net.logit(p2)), np.sort(net.logit(u2))
    t = np.unique(np.quantile(sp, np.linspace(0, 0.9, 91)))
    up = 1 - np.searchsorted(su, t) / len(su)
    pp = 1 - np.searchsorted(sp, t) / len(sp)
    margin = np.sqrt(np.log(200) / (2 * len(su))) + np.sqrt(np.log(200) / (2 * len(sp)))
    best = int(np.argmin((up + margin) / pp))
    return float(np.clip(up[best] / pp[best], 0.05, 0.98))


def fit(pos: np.ndarray, unl: np.ndarray) -> dict:
    both = np.concatenate([pos, unl]) if len(pos) + len(unl) else np.zeros((1, N_FEATURES))
    mean, scale = both.mean(0), both.std(0) + 1e-3
    scaled = lambda a: np.clip((a - mean) / scale, -6, 6)
    if not len(pos) or not len(unl):
        net = Net(N_FEATURES, 16, 3)
        net.p[2][:] = 0  # nothing to learn from: every score is one half
        return {"mean": mean, "scale": scale, "net": net.p, "prior": 0.5}
    prior = estimate_prior(scaled(pos), scaled(unl))
    return {"mean": mean, "scale": scale, "prior": prior, "net": train_nnpu(scaled(pos), scaled(unl), prior).p}


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    W, b, o, c = model["net"]
    x = np.clip((x - model["mean"]) / model["scale"], -6, 6)
    return sigmoid(np.tanh(x @ W + b) @ o + c)


def _matrix(texts: list) -> np.ndarray:
    return np.stack([features(t) for t in texts]) if texts else np.zeros((0, N_FEATURES))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", positives: int = 6000, unlabelled: int = 12000) -> dict:
    """Fit on at most ``positives`` trusted and ``unlabelled`` other texts (by id hash),
    all outside the held-out fold.  Only their feature rows reach the driver."""
    h = F.xxhash64("doc_id")
    lab = labels.where(F.col("doc_id").isNotNull()).select("doc_id", target)
    pos = lab.where((F.col(target) == 1) & (fold() != 0)).select("doc_id").distinct().orderBy(h).limit(positives)
    unl = (docs.where(F.col("doc_id").isNotNull() & (fold() != 0)).select("doc_id")
           .join(lab.select("doc_id"), "doc_id", "left_anti").distinct().orderBy(h).limit(unlabelled))
    pick = pos.withColumn("_kind", F.lit(1)).unionByName(unl.withColumn("_kind", F.lit(0)))
    rows = docs.join(F.broadcast(pick), "doc_id").select("doc_id", "_kind", bytes_of().alias("_b"))

    def run(batches):
        for b in batches:
            x = _matrix(b.column("_b").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "kind", "x"])

    got = sorted(rows.mapInArrow(run, "doc_id long, kind int, x array<double>").collect())
    side = lambda k: np.array([r["x"] for r in got if r["kind"] == k]).reshape(-1, N_FEATURES)
    return fit(side(1), side(0))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score for every row; null text counts as empty; nothing is shuffled."""
    def run(batches):
        for b in batches:
            s = scores(model, _matrix(b.column("_b").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], schema=pa.schema(
                [b.schema.field(0), pa.field("score", pa.float64())]))

    src = docs.select("doc_id", bytes_of().alias("_b"))
    return src.mapInArrow(run, T.StructType([src.schema.fields[0], T.StructField("score", T.DoubleType())]))


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **kw) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    s = score(docs, train(docs, labels, **kw))
    return s.select("doc_id", (fold() == 0).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted"))
