"""Toxicity: bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as evidence learnt from labelled texts: the log-odds of the word itself
(word input) and of its character 3- and 4-grams (character input: mean, largest,
smallest).  A window of words runs through a gated recurrent network in both
directions, attention pools the states, and a logit follows.  A document's score is
that of its highest window; windows overlap and cover the whole text.  The network is
trained on whole documents through their highest window.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stores, bytes_of, fold, other_columns_aside

STRIP = b".,;:!?\"'()[]*%&$#|"
WORD_BITS, GRAM_BITS = 20, 18
INPUTS = 6


# ---- word and character inputs -------------------------------------------------
def _clean(word: bytes) -> bytes:
    return (word.lower().strip(STRIP) or b"_").ljust(2, b"_")


def _grams(words: list[bytes], n: int):
    """Hashed n-grams of ^word$, and where each word's grams begin."""
    buf = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lens)
    code = np.zeros(len(buf) - n + 1, np.uint64)
    for k in range(n):
        code = code * np.uint64(257) + buf[k:len(buf) - n + 1 + k]
    code = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - GRAM_BITS)
    first = ends - lens
    valid = np.ones(len(buf), bool)
    for k in range(1, n):
        valid[ends - k] = False
    counts = lens - (n - 1)
    return code[valid[:len(code)]].astype(np.int64), np.cumsum(counts) - counts, counts, first


def word_inputs(words: list[bytes], ev: dict) -> np.ndarray:
    """INPUTS numbers per cleaned word."""
    out = np.zeros((len(words), INPUTS), np.float32)
    if not words:
        return out
    h = np.fromiter((zlib.crc32(w) & ((1 << WORD_BITS) - 1) for w in words), np.int64, len(words))
    out[:, 0] = ev["word"][h]
    for col, n in ((1, 3), (4, 4)):
        code, at, counts, _ = _grams(words, n)
        v = ev[f"g{n}"][code]
        out[:, col] = np.maximum.reduceat(v, at)
        out[:, col + 1] = np.add.reduceat(v, at) / counts
        if n == 3:
            out[:, 3] = np.minimum.reduceat(v, at)
    return out / np.float32(3)


def evidence(texts: list[bytes], labels: np.ndarray, prior: float = 0.5) -> dict:
    """Log-odds by document frequency of hashed words and character grams."""
    df = {k: np.zeros((2, 1 << b), np.float64) for k, b in (("word", WORD_BITS), ("g3", GRAM_BITS), ("g4", GRAM_BITS))}
    for t, y in zip(texts, labels):
        words = list({_clean(w) for w in t.split()})
        if not words:
            continue
        h = np.fromiter((zlib.crc32(w) & ((1 << WORD_BITS) - 1) for w in words), np.int64, len(words))
        df["word"][int(y)][np.unique(h)] += 1
        for n in (3, 4):
            df[f"g{n}"][int(y)][np.unique(_grams(words, n)[0])] += 1
    n = [max(1, int((labels == y).sum())) for y in (0, 1)]
    odds = lambda d: np.log((d[1] + prior) / (n[1] + 2 * prior)) - np.log((d[0] + prior) / (n[0] + 2 * prior))
    # what neither class has seen says nothing
    return {k: np.where(d.sum(0) > 0, odds(d), 0.0).astype(np.float32) for k, d in df.items()}


# ---- windows ---------------------------------------------------------------------
def windows(lens: np.ndarray, size: int, stride: int):
    """(document, first position, words) of the overlapping windows of each document."""
    n = np.maximum(1, -(-(lens - size) // stride) + 1)
    doc = np.repeat(np.arange(len(lens)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = k * stride
    return doc, start, np.clip(lens[doc] - start, 0, size)


# ---- network -----------------------------------------------------------------------
def init_net(hidden: int = 8, attend: int = 8, seed: int = 7) -> dict:
    g = np.random.default_rng(seed)
    r = lambda *s, sc: (g.standard_normal(s) * sc).astype(np.float32)
    return {"W": r(2, INPUTS, 3 * hidden, sc=INPUTS ** -0.5), "b": np.zeros((2, 1, 3 * hidden), np.float32),
            "U": r(2, hidden, 3 * hidden, sc=hidden ** -0.5), "A": r(2 * hidden, attend, sc=0.3),
            "v": r(attend, sc=0.3), "o": r(2 * hidden, sc=0.3), "c": np.zeros(1, np.float32)}


def _sig(x):
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def forward(net: dict, proj: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows.  proj: (2, L, B, 3H) projected inputs in reading order of each
    direction; mask: (2, L, B, 1) which steps hold a word."""
    _, L, B, h3 = proj.shape
    H = h3 // 3
    h = np.zeros((2, B, H), np.float32)
    states = np.empty((2, L, B, H), np.float32)
    tape = []
    for t in range(L):
        hu = h @ net["U"]
        g = _sig(proj[:, t, :, :2 * H] + hu[..., :2 * H])
        z, r = g[..., :H], g[..., H:]
        n = np.tanh(proj[:, t, :, 2 * H:] + r * hu[..., 2 * H:])
        new = n + z * (h - n)
        new = h + mask[:, t] * (new - h)
        if keep:
            tape.append((h, hu, z, r, n))
        h = new
        states[:, t] = h
    both = np.concatenate([states[0], states[1, ::-1]], -1)  # (L, B, 2H) at each word
    e = np.tanh(both @ net["A"])
    s = np.where(mask[0, :, :, 0] > 0, e @ net["v"], np.float32(-1e9))
    s = np.exp(s - s.max(0))
    a = s * mask[0, :, :, 0]
    a = a / np.maximum(a.sum(0), np.float32(1e-9))
    pooled = (a[..., None] * both).sum(0)
    logit = pooled @ net["o"] + net["c"]
    return (logit, (tape, both, e, a, pooled)) if keep else logit


def backward(net: dict, x: np.ndarray, mask: np.ndarray, saved, dlogit: np.ndarray) -> dict:
    """Gradients for windows with inputs x (2, L, B, INPUTS) given d loss / d logit."""
    tape, both, e, a, pooled = saved
    H = net["U"].shape[1]
    L = len(tape)
    d = {k: np.zeros_like(p) for k, p in net.items()}
    d["o"], d["c"] = pooled.T @ dlogit, np.array([dlogit.sum()], np.float32)
    dp = dlogit[:, None] * net["o"]
    dboth = a[..., None] * dp
    da = (both * dp).sum(-1)
    ds = a * (da - (a * da).sum(0))
    d["v"] = np.einsum("lb,lba->a", ds, e)
    de = ds[..., None] * net["v"] * (1 - e * e)
    d["A"] = np.einsum("lbh,lba->ha", both, de)
    dboth = dboth + de @ net["A"].T
    dstate = np.stack([dboth[..., :H], dboth[::-1, :, H:]])
    dh = np.zeros((2, both.shape[1], H), np.float32)
    for t in range(L - 1, -1, -1):
        h, hu, z, r, n = tape[t]
        m = mask[:, t]
        dnew = dh + dstate[:, t]
        live = dnew * m
        dz, dn = live * (h - n) * z * (1 - z), live * (1 - z) * (1 - n * n)
        dr = dn * hu[..., 2 * H:] * r * (1 - r)
        gates = np.concatenate([dz, dr, dn], -1)
        rec = np.concatenate([dz, dr, dn * r], -1)
        d["W"] += x[:, t].transpose(0, 2, 1) @ gates
        d["b"] += gates.sum(1, keepdims=True)
        d["U"] += h.transpose(0, 2, 1) @ rec
        dh = dnew * (1 - m) + live * z + rec @ net["U"].transpose(0, 2, 1)
    return d


def _gather(table: np.ndarray, ids: np.ndarray, base, start, n, size):
    """Rows of ``table`` for windows in both reading orders, and their masks."""
    step = np.arange(size)[:, None]
    live = step < n
    pos = np.where(live, base + start + np.minimum(step, np.maximum(n - 1, 0)), 0)
    rows = table[..., ids[pos], :] if len(ids) else np.zeros(table.shape[:-2] + pos.shape + table.shape[-1:], np.float32)
    if table.ndim == 2:
        rows = np.stack([rows, rows[::-1]])
    else:
        rows = np.stack([rows[0], rows[1][::-1]])
    m = np.stack([live, live[::-1]])[..., None].astype(np.float32)
    return rows, m


class Vocabulary:
    """Ids of raw words and their inputs; begins anew past ``limit`` words."""

    def __init__(self, ev: dict, project=None, limit: int = 400_000):
        self.ev, self.project, self.limit = ev, project, limit
        self.reset()

    def reset(self):
        self.ids: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []

    def encode(self, texts: list[bytes]):
        if len(self.ids) > self.limit:
            self.reset()
        split = [t.split() for t in texts]
        new = [w for w in set().union(*split) if w not in self.ids] if split else []
        if new:
            x = word_inputs([_clean(w) for w in new], self.ev)
            self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new))))
            x = x if self.project is None else self.project(x)
            self.parts = [np.concatenate([*self.parts, x], axis=-2)]
        get = self.ids.__getitem__
        lens = np.array([len(s) for s in split], np.int64)
        ids = np.fromiter((i for s in split for i in map(get, s)), np.int64, int(lens.sum()))
        return lens, ids

    @property
    def table(self):
        return self.parts[0] if self.parts else np.zeros((1, INPUTS), np.float32)


def fit(texts: list[bytes], labels: np.ndarray, size: int = 48, stride: int = 32, epochs: int = 14, batch: int = 128,
        rate: float = 0.01, updates: int = 300, seed: int = 7) -> dict:
    """Train on labelled texts: evidence from two thirds, the network on the other third."""
    part = np.arange(len(texts)) % 3
    order = np.random.default_rng(seed).permutation(len(texts))
    texts, labels = [texts[i] for i in order], labels[order]
    pick = lambda m: ([t for t, k in zip(texts, m) if k], labels[m])
    ev = evidence(*pick(part != 2))
    tx, ty = pick(part == 2)
    net = init_net(seed=seed)
    model = {"ev": ev, "net": net, "size": size, "stride": stride}
    if not len(tx) or ty.min() == ty.max():
        net["o"][:] = 0  # nothing to tell apart: everything gets the same low score
        net["c"][:] = -3
        return model
    # few samples: smaller batches and more rounds, for about ``updates`` steps at least
    batch = max(16, min(batch, len(tx) // 12))
    epochs = max(epochs, -(-updates // max(1, len(tx) // batch)))
    voc = Vocabulary(ev, limit=1 << 60)
    lens, ids = voc.encode(tx)
    base = np.cumsum(lens) - lens
    doc, start, n = windows(lens, size, stride)
    first = np.searchsorted(doc, np.arange(len(lens) + 1))
    weight = np.where(ty == 1, 0.5 / max(1, (ty == 1).sum()), 0.5 / max(1, (ty == 0).sum())) * len(ty)
    weight = np.sqrt(weight)
    mom = {k: (np.zeros_like(p), np.zeros_like(p)) for k, p in net.items()}
    rng, step = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        for b in np.array_split(rng.permutation(len(lens)), max(1, len(lens) // batch)):
            w = np.concatenate([np.arange(first[i], first[i + 1]) for i in b])
            which = np.repeat(np.arange(len(b)), first[b + 1] - first[b])
            logit = score_windows(net, voc.table @ net["W"] + net["b"], ids, base[doc[w]], start[w], n[w], size)
            top = np.array([w[which == i][np.argmax(logit[which == i])] for i in range(len(b))])
            x, m = _gather(voc.table, ids, base[doc[top]], start[top], n[top], size)
            proj = np.matmul(x, net["W"][:, None]) + net["b"][:, None]
            out, saved = forward(net, proj.astype(np.float32), m, keep=True)
            y = ty[b].astype(np.float32)
            dl = ((_sig(out) - y) * weight[b] / len(b)).astype(np.float32)
            grad, step = backward(net, x, m, saved, dl), step + 1
            lr = rate * min(1.0, step / 20) * (0.5 if epoch >= epochs - 4 else 1.0)
            for k, p in net.items():
                g = np.clip(grad[k], -1, 1)
                m1, m2 = mom[k]
                m1 += 0.1 * (g - m1)
                m2 += 0.01 * (g * g - m2)
                p -= (lr * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return model


def score_windows(net, table, ids, base, start, n, size, chunk: int = 4096) -> np.ndarray:
    out = [forward(net, *_gather(table, ids, base[k:k + chunk], start[k:k + chunk], n[k:k + chunk], size))
           for k in range(0, len(start), chunk)]
    return np.concatenate(out) if out else np.zeros(0, np.float32)


class Scorer:
    def __init__(self, model: dict):
        self.m, net = model, model["net"]
        self.voc = Vocabulary(model["ev"], lambda x: (x @ net["W"] + net["b"]).astype(np.float32))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        m = self.m
        lens, ids = self.voc.encode(texts)
        table = self.voc.table if self.voc.parts else np.zeros((2, 1, m["net"]["b"].shape[-1]), np.float32)
        base = np.cumsum(lens) - lens
        doc, start, n = windows(lens, m["size"], m["stride"])
        logit = score_windows(m["net"], table, ids, base[doc], start, n, m["size"])
        top = np.full(len(lens), -np.inf)
        np.maximum.at(top, doc, logit)
        return 1 / (1 + np.exp(-top))


# ---- Spark ---------------------------------------------------------------------------
def sample_labelled(docs: DataFrame, labels: DataFrame, target: str, positives: int, negatives: int) -> DataFrame:
    """(text bytes, label) of a bounded sample of labelled training rows, by id hash."""
    lab = (labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & (fold() != 0))
           .groupBy("doc_id").agg(F.max(target).alias("_y")))
    h = F.xxhash64("doc_id")
    pick = (lab.where("_y = 1").orderBy(h).limit(positives)
            .unionByName(lab.where("_y = 0").orderBy(h).limit(negatives)))
    # at most positives + negatives ids
    return docs.join(F.broadcast(pick), "doc_id").select("doc_id", bytes_of().alias("_b"), "_y")


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", positives: int = 1500, negatives: int = 3000,
          **kw) -> dict:
    """Fit on at most ``positives`` + ``negatives`` labelled documents outside the held-out fold."""
    rows = sorted(sample_labelled(docs, labels, target, positives, negatives).collect(), key=lambda r: (r["doc_id"], r["_b"]))
    return fit([bytes(r["_b"]) for r in rows], np.array([r["_y"] for r in rows], np.int64), **kw)


def score(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default doc_id) and score (double) for every row of ``docs``.

    Null and empty texts are one window without words.  Arrow batches are scored in
    bounded chunks of windows; nothing is shuffled.
    """
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, set by WORD_BITS and GRAM_BITS

    def run(batches):
        drop_stores()
        scorer = Scorer(shared.value)
        for b in batches:
            texts = b.column("_b").to_pylist()
            s = np.concatenate([scorer.scores(texts[k:k + 500]) for k in range(0, len(texts), 500)]) if texts else np.zeros(0)
            cols = [b.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(s, pa.float64())], schema=pa.schema(
                [*[b.schema.field(i) for i in range(len(keep))], pa.field("_score", pa.float64())]))

    src = docs.select(*[F.col(f"`{c}`") for c in keep], bytes_of().alias("_b"))
    from pyspark.sql import types as T
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("_score", T.DoubleType())])
    return src.mapInArrow(run, schema)


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **kw) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    s = score(docs, train(docs, labels, **kw))
    return s.select("doc_id", (fold() == 0).alias("held_out"), F.col("_score").alias("score"),
                    (F.col("_score") >= threshold).cast("int").alias("predicted"))


@other_columns_aside
def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **kw) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic."""
    return score(docs, train(docs, labels, **kw), docs.columns).where(F.col("_score") < threshold).drop("_score")
