"""Hard-negative mining by a secondary sort of scores.

Anchors meet the rows in bounded blocks: a block of anchors is broadcast and every task
scores its own rows against it.  Scores travel as packed keys (anchor, descending score,
positives first, id), dealt by anchor and sorted within partitions, so a streaming reader
sees the rows of an anchor best first: a positive opens its window of scores, negatives
are emitted for every open window they fall into, and a window closes when it is full or
passed.  Only the open windows of one anchor are held.

A first sort of this kind finds the positives.  Their windows are then known, so a task
sends for the second one only what can be emitted: of its rows the best of each window.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .common import parallelism

KEY = struct.Struct(">QQBQ")  # anchor, flipped score, 0 for a positive and 1 for a negative, id
TOP = (1 << 63) - 1
FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> Column:
    """Rows that take part: id, label and vector present, every component finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.exists(vector_col, bad)


def pack(anchor: int, score: int, kind: int, ident: int) -> bytes:
    """Sorts by anchor, falling score, positives before negatives, rising id."""
    return KEY.pack(anchor, TOP - score, kind, ident + (1 << 63))


def unpack(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, kind, ident = KEY.unpack(key)
    return anchor, TOP - score, kind, ident - (1 << 63)


def quantised(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of doubles; held as doubles, which are exact for whole numbers of that size."""
    return np.floor(np.asarray(values, np.float64) * scale)


def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products, held at the ends of the 64-bit range.

    A matrix product of doubles is exact while every partial sum stays below 2^53; other
    blocks are multiplied with Python's integers.
    """
    if not a.size or not x.size:
        return np.zeros((len(a), len(x)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(x).max()) * a.shape[1] < 2.0 ** 53:
        return (a @ x.T).astype(np.int64)
    whole = [[[int(v) for v in r] for r in m.tolist()] for m in (a, x)]
    return np.array([[max(-TOP, min(TOP, sum(p * q for p, q in zip(r, s)))) for s in whole[1]] for r in whole[0]], np.int64)


class _Rows:
    """Vectors of one length out of an Arrow batch (id, label, vector), in the order of their ids."""

    def __init__(self, batch: pa.RecordBatch, scale: float):
        self.ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.labels = batch.column(1).to_numpy(zero_copy_only=False)
        vec = batch.column(2)
        self.lens = np.diff(vec.offsets.to_numpy())
        self.flat, self.at = quantised(vec.flatten().to_numpy(zero_copy_only=False), scale), np.cumsum(self.lens) - self.lens

    def of_length(self, dim: int, most: int = 2048):
        """(ids, labels, matrix) of at most ``most`` rows at a time."""
        pick = np.flatnonzero(self.lens == dim)
        pick = pick[np.argsort(self.ids[pick], kind="stable")]
        for k in range(0, len(pick), most):
            p = pick[k:k + most]
            yield self.ids[p], self.labels[p], self.flat[self.at[p][:, None] + np.arange(dim)]


class _Best:
    """The ``keep`` best (score, then smaller id) of each of ``n`` lists, from blocks of rows."""

    def __init__(self, n: int, keep: int):
        self.keep = keep
        self.floor = np.full(n, -TOP - 1, np.int64)  # a list's last kept score once it is full
        self.list, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, score: np.ndarray, ok: np.ndarray, ids: np.ndarray) -> None:
        i, j = np.nonzero(ok & (score >= self.floor[:, None]))
        if not len(i):
            return
        lists, got = np.concatenate([self.list, i]), np.concatenate([self.score, score[i, j]])
        idents = np.concatenate([self.id, ids[j]])
        order = np.lexsort((idents, -got, lists))
        lists, got, idents = lists[order], got[order], idents[order]
        # a repeated row counts once
        new = np.ones(len(lists), bool)
        new[1:] = (np.diff(lists) != 0) | (np.diff(got) != 0) | (np.diff(idents) != 0)
        lists, got, idents = lists[new], got[new], idents[new]
        first = np.flatnonzero(np.diff(lists, prepend=-1))
        rank = np.arange(len(lists)) - np.repeat(first, np.diff(first, append=len(lists)))
        full = rank == self.keep - 1
        self.floor[lists[full]] = got[full]
        keep = rank < self.keep
        self.list, self.score, self.id = lists[keep], got[keep], idents[keep]


def _window(positive: int, low: int, high: int, whole: int) -> tuple[int, int]:
    """Least and largest score inside the window of a positive score."""
    return -(-low * positive // whole), high * positive // whole


def _keys(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> pa.RecordBatch:
    """Packed keys with the anchor by which they are dealt."""
    packed = [pack(a, s, kind, i) for a, s, i in zip(anchor.tolist(), score.tolist(), ids.tolist())]
    return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(packed, pa.binary())], names=["anchor", "key"])


def _meet(shared, scale: float, keep: int, windows: bool):
    """Packed keys of the rows of a task: the best positives, or the best of every window."""
    def run(batches):
        block = shared.value
        best = {}
        for batch in batches:
            rows = _Rows(batch, scale)
            for dim, g in block["dims"].items():
                for ids, labels, x in rows.of_length(dim):
                    s = scores(g["matrix"], x)
                    same = g["labels"][:, None] == labels[None, :]
                    if not windows:
                        lists = best.setdefault((dim, 0), _Best(len(s), keep))
                        lists.add(s, same & (g["ids"][:, None] != ids[None, :]), ids)
                        continue
                    for k in range(g["low"].shape[1]):
                        lists = best.setdefault((dim, k), _Best(len(s), keep))
                        lists.add(s, ~same & (s >= g["low"][:, k, None]) & (s <= g["high"][:, k, None]), ids)
        for dim, g in block["dims"].items():
            parts = [(b.list, b.score, b.id) for (d, _), b in best.items() if d == dim]
            if parts:
                # a row that falls into several windows travels once
                got = np.unique(np.stack([np.concatenate(p) for p in zip(*parts)]), axis=1)
                yield _keys(g["number"][got[0]], got[1], int(windows), got[2])
    return run


def _sorted(keys: DataFrame, n: int) -> DataFrame:
    """Dealt by anchor, in the order of the packed keys within partitions."""
    return keys.repartition(n, "anchor").sortWithinPartitions("key")


def _first_positives(positives: int):
    """The first distinct positives of every anchor, from a stream of sorted keys."""
    def run(batches):
        anchor, left, last = None, 0, None
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                a, score, _, ident = unpack(key)
                if a != anchor:
                    anchor, left, last = a, positives, None
                if left and key != last:
                    out.append((a, score, ident))
                    left -= 1
                last = key
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["anchor", "score", "id"])
    return run


def _emit(names, negatives: int, low: int, high: int, whole: int):
    """Negatives for the open windows, from a stream of sorted keys."""
    def run(batches):
        anchor, last, windows = None, None, []
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                if key == last:  # a row that several tasks or rows hold
                    continue
                last = key
                a, score, kind, ident = unpack(key)
                if a != anchor:
                    anchor, windows = a, []
                if kind == 0:
                    least, most = _window(score, low, high, whole)
                    windows.append([ident, score, least, most, 0])
                    continue
                for w in windows:
                    if w[2] <= score <= w[3] and w[4] < negatives:
                        w[4] += 1
                        out.append((names.value["names"][a], w[0], w[4], ident, w[1], score))
                windows = [w for w in windows if w[4] < negatives and score >= w[2]]
            cols = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                             names=[c.split()[0] for c in FOUND.split(", ")])
    return run


def _block(rows: pa.Table, scale: float) -> dict:
    """Anchors of a block by vector length; their numbers are places in ``names``."""
    rows = rows.combine_chunks().to_batches()
    out = {"names": {}, "dims": {}}
    for batch in rows:
        r = _Rows(batch, scale)
        for dim in sorted(set(r.lens.tolist())):
            parts = list(r.of_length(dim))
            ids, labels, x = (np.concatenate(p) for p in zip(*parts))
            number = len(out["names"]) + np.arange(len(ids))
            out["names"].update(zip(number.tolist(), ids.tolist()))
            out["dims"][dim] = {"number": number, "ids": ids, "labels": labels, "matrix": x}
    return out


def _open(block: dict, found: pa.Table, positives: int, low: int, high: int, whole: int) -> list:
    """Adds the windows of the positives found to the block; the packed keys of these positives."""
    got: dict = {}
    for a, s, i in zip(*(found.column(c).to_pylist() for c in ("anchor", "score", "id"))):
        got.setdefault(a, []).append((s, i))
    for g in block["dims"].values():
        g["low"], g["high"] = np.ones((len(g["ids"]), positives), np.int64), np.zeros((len(g["ids"]), positives), np.int64)
        for k, a in enumerate(g["number"].tolist()):
            for p, (s, _) in enumerate(got.get(a, [])):
                g["low"][k, p], g["high"][k, p] = (max(-TOP, min(TOP, x)) for x in _window(s, low, high, whole))
    return [(a, pack(a, s, 0, i)) for a, all_ in got.items() for s, i in all_]


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         whole: int = 100, scale: float = 256, block_rows: int = 4096, id_col: str = "vec_id",
         vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Hard negatives of every anchor and positive: anchor_id, positive_id, rank, negative_id and the two scores.

    Components are scaled and rounded down; a row's score is its inner product with the
    anchor.  Higher scores come first, ties by smaller id.  The positives of an anchor are
    its first ``positives`` rows of the same label with another id; the negatives of a
    positive are the first ``negatives`` rows of other labels whose score times ``whole``
    lies between ``low`` and ``high`` times the positive's.

    Rows with a null id, label, vector or component, or a component that is not finite,
    take no part.  Vectors meet only vectors of their length.  Scores that a 64-bit number
    cannot hold stand at its ends.  Of rows that share id and
    score with an anchor one counts, so repeated rows change nothing; different anchor rows
    with one id are anchors of their own.  An empty table gives no rows.  Anchors are
    taken in blocks of about ``block_rows`` (dealt by a hash of the id); only one block of
    them and its positives is ever in the driver or a task.
    """
    spark = rows.sparkSession
    src = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    src = src.where(usable())
    picked = rows.where(anchor).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
                                       F.col(vector_col).alias("embedding")).where(usable()).distinct()
    picked = materialize(picked)
    blocks = max(1, -(-picked.count() // block_rows))
    n, out = parallelism(rows), scratch_path(spark, "negatives")
    for k in range(blocks):
        mine_ = picked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k)
        block = _block(mine_.toArrow(), scale)
        shared = spark.sparkContext.broadcast(block)
        near = src.mapInArrow(_meet(shared, scale, positives, False), "anchor long, key binary")
        found = (_sorted(near, n).select("key")
                 .mapInArrow(_first_positives(positives), "anchor long, score long, id long").toArrow())
        opened = _open(block, found, positives, low, high, whole)
        wide = spark.sparkContext.broadcast(block)
        far = src.mapInArrow(_meet(wide, scale, negatives, True), "anchor long, key binary")
        both = far.unionByName(spark.createDataFrame(opened, "anchor long, key binary"))
        (_sorted(both, n).select("key").mapInArrow(_emit(wide, negatives, low, high, whole), FOUND)
         .write.mode("append").parquet(out))
        shared.unpersist()
        wide.unpersist()
    return spark.read.schema(FOUND).parquet(out)


def mining_report(vectors: DataFrame) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by 100; every seventh id has the next label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)
