"""Embedding near-dedup by an epsilon grid order join.

Vectors at cosine >= c lie within epsilon = sqrt(2 - 2c) of each other once scaled to
length one, and so do their projections.  Distinct vectors are sorted by the cells of an
epsilon grid over the leading principal dimensions and cut into sequences.  Pairs of
sequences whose boxes are within epsilon are joined by halving both in turn: blocks that
are provably distant are skipped, small ones are compared by exact dot products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import parallelism
from .graph import components

SLACK = 1e-9


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def principal(sample: list[np.ndarray], keep: int) -> dict[int, np.ndarray]:
    """Orthonormal leading directions for each vector length of the sample."""
    out = {}
    for n in {len(v) for v in sample}:
        x = unit(np.array([v for v in sample if len(v) == n], np.float64))
        _, vec = np.linalg.eigh((x - x.mean(0)).T @ (x - x.mean(0)))
        out[n] = vec[:, ::-1][:, :keep]
    return out


def project(x: np.ndarray, basis: dict, keep: int) -> np.ndarray:
    """Coordinates on the leading directions; lengths without any use plain coordinates."""
    b = basis.get(x.shape[1])
    y = x @ (b if b is not None else np.eye(x.shape[1])[:, :keep])
    return np.pad(y, ((0, 0), (0, keep - y.shape[1])))


class Sequence:
    """Vectors in grid order: class ids, weights, unit vectors, projections."""

    def __init__(self, ids: bytes, weights: bytes, raw: bytes, dim: int, basis, keep: int):
        self.ids, self.w = np.frombuffer(ids, "<i8"), np.frombuffer(weights, "<i8")
        self.raw = np.frombuffer(raw, "<f8").reshape(-1, dim)
        self.u = unit(self.raw)
        self.p = project(self.u, basis, keep)


def _apart(a: np.ndarray, b: np.ndarray) -> float:
    """Least distance of the boxes of two sets of projections."""
    gap = np.maximum(0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
    return float(np.sqrt((gap * gap).sum()))


def join_sequences(a: Sequence, b: Sequence, same: bool, cosine: float, eps: float, leaf: int = 96):
    """(links to others per vector of a, of b, parents): parents join a's then b's vectors."""
    na, nb = len(a.ids), len(b.ids)
    count_a, count_b = np.zeros(na, np.int64), np.zeros(nb, np.int64)
    parent = np.arange(na + (0 if same else nb))
    off = 0 if same else na

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def compare(s, e, t, f):
        dot = a.u[s:e] @ b.u[t:f].T
        hit = dot >= cosine
        near = np.argwhere(np.abs(dot - cosine) < 1e-12)
        for i, j in near:  # on the edge: the cosine as it is defined
            x, y = a.raw[s + i], b.raw[t + j]
            hit[i, j] = (x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= cosine
        if same and s == t:
            np.fill_diagonal(hit, False)
        if not hit.any():
            return
        count_a[s:e] += hit @ b.w[t:f]
        if not same or s != t:
            count_b[t:f] += a.w[s:e] @ hit
        rows, cols = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        hit = hit[np.ix_(rows, cols)]
        # components inside the block by least label, then into the sequences' forest
        left, right = np.arange(len(rows)), np.full(len(cols), len(rows))
        while True:
            right = np.where(hit, left[:, None], len(rows)).min(0)
            new = np.minimum(left, np.where(hit, right[None, :], len(rows)).min(1))
            if (new == left).all():
                break
            left = new
        for k, lab in [*zip((rows + s).tolist(), left), *zip((cols + t + off).tolist(), right)]:
            x, y = root(k), root(int(rows[lab] + s))
            if x != y:
                parent[max(x, y)] = min(x, y)

    todo = [(0, na, 0, nb)]
    while todo:
        s, e, t, f = todo.pop()
        if same and t > s or s == e or t == f or _apart(a.p[s:e], b.p[t:f]) > eps:
            continue
        if e - s <= leaf and f - t <= leaf:
            compare(s, e, t, f)
            continue
        # both sides are halved at the same places, so a sequence meets itself in squares
        m, n = ((s + e) // 2 if e - s > leaf else e), ((t + f) // 2 if f - t > leaf else f)
        todo += [(x, y, z, w) for x, y in {(s, m), (m, e)} for z, w in {(t, n), (n, f)}]
    return count_a, count_b, np.array([root(i) for i in range(len(parent))])


def classes(vectors: DataFrame) -> DataFrame:
    """Distinct usable vectors of a label: cid, label, embedding, least vec_id, w (ids that have it)."""
    e = F.col("embedding")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ok = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & ~F.exists(e, bad)
          & F.exists(e, lambda x: x != 0))
    one = vectors.where(ok).select("vec_id", "label", "embedding").distinct()
    grouped = one.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("w"))
    return materialize(grouped.withColumn("cid", F.monotonically_increasing_id()))


def near_classes(cls: DataFrame, cosine: float, keep: int = 6, sample: int = 8192, length: int = 1024):
    """(links, edges): per class the weight of its linked classes, and links that span them."""
    eps = float(np.sqrt(2 - 2 * cosine)) + SLACK
    picked = cls.orderBy(F.xxhash64("embedding")).limit(sample).select("embedding").collect()
    shared = cls.sparkSession.sparkContext.broadcast(principal([np.array(r[0], np.float64) for r in picked], keep))

    def grid(batches):
        for b in batches:
            vec = b.column(3).to_pylist()
            p = [project(unit(np.array([v], np.float64)), shared.value, keep)[0] for v in vec]
            cells = np.floor(np.array(p).reshape(-1, keep) / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(v) for v in vec], pa.int32()), b.column(2),
                 pa.array([np.array(v, "<f8").tobytes() for v in vec], pa.binary()),
                 *[pa.array(cells[:, k], pa.int32()) for k in range(keep)]],
                names=["cid", "label", "dim", "w", "v", *[f"c{k}" for k in range(keep)]])

    cells = [f"c{k}" for k in range(keep)]
    src = cls.select("cid", "label", "w", "embedding")
    kind = dict(src.dtypes)["label"]
    ordered = (src.mapInArrow(grid, f"cid long, label {kind}, dim int, w long, v binary, " + ", ".join(f"{c} int" for c in cells))
               .repartitionByRange(parallelism(cls), "label", "dim", *cells, "cid")
               .sortWithinPartitions("label", "dim", *cells, "cid"))

    def cut(batches):
        """Sequences of at most ``length`` vectors of one label, with the box of their projections."""
        for b in batches:
            lab, dim = b.column(1).to_pylist(), b.column(2).to_pylist()
            at = [0] + [i for i in range(1, len(lab)) if (lab[i], dim[i]) != (lab[i - 1], dim[i - 1])] + [len(lab)]
            out = []
            for s, e in zip(at[:-1], at[1:]):
                for i in range(s, e, length):
                    t = b.slice(i, min(length, e - i))
                    raw = b"".join(t.column(4).to_pylist())
                    seq = Sequence(np.array(t.column(0).to_pylist(), "<i8").tobytes(),
                                   np.array(t.column(3).to_pylist(), "<i8").tobytes(), raw, dim[s], shared.value, keep)
                    out.append((lab[s], dim[s], seq.ids.tobytes(), seq.w.tobytes(), raw,
                                seq.p.min(0).tolist(), seq.p.max(0).tolist()))
            col = lambda k, t=None: pa.array([o[k] for o in out], t)
            yield pa.RecordBatch.from_arrays(
                [col(0, b.schema.field(1).type), col(1, pa.int32()), col(2, pa.binary()), col(3, pa.binary()), col(4, pa.binary()),
                 col(5, pa.list_(pa.float64())), col(6, pa.list_(pa.float64()))],
                names=["label", "dim", "ids", "ws", "raw", "lo", "hi"])

    seqs = materialize(ordered.mapInArrow(
        cut, f"label {kind}, dim int, ids binary, ws binary, raw binary, lo array<double>, hi array<double>")
        .withColumn("seq", F.monotonically_increasing_id()))
    # pairs of sequences meet in a cell of the first two dimensions (one side reaches a cell further)
    box = seqs.select("seq", "label", "dim", "lo", "hi")

    def spread(reach, side):
        d = box
        for k in (0, 1):
            at = lambda c: F.floor(F.get(c, F.lit(k)) / eps)  # noqa: B023,E731
            d = d.withColumn(f"g{k}", F.explode(F.sequence(at("lo") - reach, at("hi") + reach)))
        return d.select("label", "dim", "g0", "g1", *[F.col(c).alias(f"{c}_{side}") for c in ("seq", "lo", "hi")])

    gap = F.aggregate(F.sequence(F.lit(0), F.lit(keep - 1)), F.lit(0.0), lambda acc, k: acc + F.pow(F.greatest(
        F.lit(0.0), F.get("lo_a", k) - F.get("hi_b", k), F.get("lo_b", k) - F.get("hi_a", k)), F.lit(2.0)))
    pairs = (spread(0, "a").join(spread(1, "b"), ["label", "dim", "g0", "g1"])
             .where((F.col("seq_a") >= F.col("seq_b")) & (gap <= eps * eps)).select("seq_a", "seq_b").distinct())
    pay = lambda s: seqs.select(F.col("seq").alias(f"seq_{s}"), "dim", F.col("ids").alias(f"ids_{s}"),
                                F.col("ws").alias(f"ws_{s}"), F.col("raw").alias(f"raw_{s}"))
    work = (pairs.join(pay("a"), "seq_a").join(pay("b").drop("dim"), "seq_b")
            .select("seq_a", "seq_b", "dim", "ids_a", "ws_a", "raw_a", "ids_b", "ws_b", "raw_b"))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                sa, sb, dim, *rest = (c[i].as_py() for c in b.columns)
                x, y = Sequence(*rest[:3], dim, shared.value, keep), Sequence(*rest[3:], dim, shared.value, keep)
                ca, cb, parent = join_sequences(x, y, sa == sb, cosine, eps)
                ids, n = (x.ids, ca + cb) if sa == sb else (np.concatenate([x.ids, y.ids]), np.concatenate([ca, cb]))
                hit = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(n[hit]), pa.array(ids[parent][hit])],
                                                 names=["cid", "n", "root"])

    got = materialize(work.mapInArrow(run, "cid long, n long, root long"))
    return got.groupBy("cid").agg(F.sum("n").alias("n")), got.select(F.col("cid").alias("a"), F.col("root").alias("b"))


def embedding_join(vectors: DataFrame, cosine: float = 0.93, **kw) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Only vectors of one label and length can be linked.  Null, zero and non-finite
    vectors, null labels and null ids link with nothing.  Equal vectors are joined as
    one with a weight; repeated rows count once.
    """
    cls = classes(vectors)
    links, edges = near_classes(cls, cosine, **kw)
    comps = components(edges)
    c = (cls.join(links, "cid", "left").join(comps, F.col("cid") == F.col("node"), "left")
         .select("label", "embedding", "least", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"),
                 F.coalesce("component", "cid").alias("comp")))
    c = materialize(c)
    first = c.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = c.join(first, "comp").select("label", "embedding", "n_links", "component_id")
    out = vectors.select("vec_id", "label", "embedding").join(named, ["label", "embedding"], "left")
    linked = F.col("vec_id").isNotNull()
    out = out.select("vec_id", F.when(linked, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
                     F.when(linked, F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def keep_components(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """``vectors`` without the rows that are near copies of a kept one."""
    keep = embedding_join(vectors, cosine).where("kept").select(F.col("vec_id").alias("_id")).distinct()
    return vectors.join(keep, vectors["vec_id"].eqNullSafe(keep["_id"]), "left_semi")
