"""Substring dedup: repeated windows of words, found by Rabin-Karp hashes.

Documents are dealt to buckets of a few MB.  A bucket hashes every window of ``size``
words and sends each distinct hash once, with the least doc_id that has it there, to the
part of the hash space that counts it.  A part finds the least doc_id of each hash over
all buckets and answers the buckets that hold it only in larger ids.  Each bucket then
marks covered windows and merges them into maximal removal intervals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import WordHasher, compressed, decompressor, power_of_two, total_bytes, window_hashes

FOUND = "doc_id long, n_words long, removed array<struct<start:int,end:int>>, kept binary"


def _narrow(a: np.ndarray) -> bytes:
    """Non-negative numbers in the fewest bytes each; the first byte says how many."""
    width = next(w for w in (1, 2, 4, 8) if not len(a) or int(a.max()) < 1 << (8 * w - (w == 8)))
    return bytes([width]) + a.astype(f"<u{width}").tobytes()


def _wide(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


def _low7(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _from7(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(b, np.uint8).reshape(-1, 7)
    return out.view("<u8").ravel()


class _Bucket:
    """Words and windows of the documents of one bucket, by doc_id (null ids last)."""

    def __init__(self, table: pa.Table, size: int, hasher):
        t = table.select(["doc_id", "z"]).sort_by([("doc_id", "ascending")])
        self.ids = t.column("doc_id").to_pylist()
        un = decompressor()
        texts = [un(z) for z in t.column("z").to_pylist()]
        self.words, self.lens, hashes = hasher(texts)
        self.base = np.cumsum(self.lens) - self.lens
        h = window_hashes(hashes, size)
        start = np.arange(len(h))
        of = np.repeat(np.arange(len(self.ids)), self.lens)[:len(h)]
        known = np.array([i is not None for i in self.ids], bool)
        ok = (start + size <= (self.base + self.lens)[of]) & known[of] if len(h) else np.zeros(0, bool)
        self.hash, self.start, self.of = h[ok], start[ok], of[ok]
        # documents with one id count as one
        num = np.array([i if i is not None else 0 for i in self.ids], np.int64)
        self.doc = num[self.of]
        self.uniq, first, self.inv = np.unique(self.hash, return_index=True, return_inverse=True)
        self.least = self.doc[first]  # windows are in doc_id order, so the first is the least


def _send(size: int, parts: int):
    shift = np.uint64(64 - (parts.bit_length() - 1))

    def run(key, table):
        hasher = WordHasher()
        b = _Bucket(table, size, hasher)
        part = (b.uniq >> shift).astype(np.int64)
        order = np.lexsort((b.least, part))
        h, doc, part = b.uniq[order], b.least[order], part[order]
        cut = np.flatnonzero(np.diff(part, prepend=-1, append=parts))
        rows = [(part[s], _low7(h[s:e]), int(doc[s]), _narrow(np.diff(doc[s:e], prepend=doc[s])))
                for s, e in zip(cut[:-1], cut[1:])] if len(h) else []
        return pa.table({"part": pa.array([int(r[0]) for r in rows], pa.int32()),
                         "bucket": pa.array([key[0].as_py()] * len(rows), pa.int64()),
                         "h": pa.array([r[1] for r in rows], pa.binary()),
                         "first": pa.array([r[2] for r in rows], pa.int64()),
                         "doc": pa.array([r[3] for r in rows], pa.binary())})
    return run


def _count(key, table):
    """Of one part of the hash space: the hashes each bucket has only in larger ids."""
    cols = [table.column(c).to_pylist() for c in ("bucket", "h", "first", "doc")]
    hs = [_from7(x) for x in cols[1]]
    docs = [np.cumsum(_wide(d)) + f for f, d in zip(cols[2], cols[3])]
    n = [len(x) for x in hs]
    h, doc = np.concatenate(hs), np.concatenate(docs)
    row = np.repeat(np.arange(len(n)), n)
    order = np.argsort(h)
    h, doc, row = h[order], doc[order], row[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    least = np.repeat(np.minimum.reduceat(doc, at), np.diff(at, append=len(h)))
    hit = doc > least
    h, row = h[hit], row[hit]
    order = np.argsort(row, kind="stable")
    h, row = h[order], row[order]
    cut = np.flatnonzero(np.diff(row, prepend=-1, append=len(n))) if len(row) else []
    out = [(cols[0][row[s]], _low7(h[s:e])) for s, e in zip(cut[:-1], cut[1:]) if s < len(row)]
    return pa.table({"bucket": pa.array([o[0] for o in out], pa.int64()),
                     "part": pa.array([key[0].as_py()] * len(out), pa.int32()),
                     "h": pa.array([o[1] for o in out], pa.binary())})


def _remove(size: int, parts: int):
    shift = np.uint64(64 - (parts.bit_length() - 1))

    def run(key, docs, answers):
        b = _Bucket(docs, size, WordHasher())
        back = [np.zeros(0, np.uint64)]
        for p, x in zip(answers.column("part").to_pylist(), answers.column("h").to_pylist()):
            back.append(_from7(x) | (np.uint64(p) << shift))
        covered = np.isin(b.uniq, np.concatenate(back))[b.inv] | (b.doc > b.least[b.inv])
        total = int(b.lens.sum())
        edge = np.zeros(total + size + 1, np.int64)
        np.add.at(edge, b.start[covered], 1)
        np.add.at(edge, b.start[covered] + size, -1)
        gone = np.cumsum(edge)[:total] > 0
        removed, kept = [], []
        for w, s, n in zip(b.words, b.base, b.lens):
            g = gone[s:s + n]
            if not g.any():
                removed.append([])
                kept.append(b" ".join(w))
                continue
            turn = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
            removed.append([{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2])])
            kept.append(b" ".join([x for x, d in zip(w, g.tolist()) if not d]))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table({"doc_id": pa.array(b.ids, pa.int64()), "n_words": pa.array(b.lens, pa.int64()),
                         "removed": pa.array(removed, kind), "kept": pa.array(kept, pa.binary())})
    return run


def substring_dedup(docs: DataFrame, size: int = 13, bucket_bytes: int = 4 << 20, part_windows: int = 1 << 20,
                    least_parts: int = 256) -> DataFrame:
    """One row per document: doc_id, n_words, removed (word intervals), kept (UTF-8 bytes).

    A word goes when a window that covers it also starts in a document with a smaller
    doc_id.  Null text has no words.  Rows with a null id lose nothing and cost others
    nothing; rows that share an id count as one document.  Windows are told apart by 64
    hash bits: of n distinct windows about n^2 / 2^65 pairs would be confused.
    """
    total = total_bytes(docs)
    buckets = max(1, -(-total // bucket_bytes))
    # parts of the hash space: at least 2^8, as a window travels with 56 of its 64 hash bits
    parts = max(least_parts, power_of_two(total / 6 / part_windows))
    key = F.coalesce(F.xxhash64("doc_id"), F.lit(0))
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("z")).otherwise(key)
    dealt = compressed(docs).withColumn("bucket", F.pmod(spread, F.lit(buckets)))
    sent = dealt.groupBy("bucket").applyInArrow(
        _send(size, parts), "part int, bucket long, h binary, first long, doc binary")
    answers = sent.groupBy("part").applyInArrow(_count, "bucket long, part int, h binary")
    return dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_remove(size, parts), FOUND)


def substring_report(docs: DataFrame, **kw) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + (r["end"] - r["start"]))
    return substring_dedup(docs, **kw).select("doc_id", "n_words", gone.alias("n_removed"),
                                              F.sha2("kept", 256).alias("kept_sha256"))
