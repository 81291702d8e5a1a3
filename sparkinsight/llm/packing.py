"""Cost-balanced packing of tokenised documents into fixed-length sequences.

Documents go to groups of a few MB.  In a group, pieces in descending length go to
the sequence of lowest cost (linear plus quadratic in the piece length, as attention
costs) that still has room; a piece that fits nowhere is cut at the room of the
emptiest sequence.  The room of a group is its exact number of tokens: full
sequences, and powers of two (which need no padding) for the rest.
"""

from __future__ import annotations

import heapq
import os
import zlib
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_store

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


class Encoder:
    """Token ids of whole texts as little-endian uint32 bytes.

    The vocabulary drops white space and never joins characters across it, so a
    text's ids are those of its white-space-free chunks in a row.  It folds case and
    parts letters from punctuation, so a chunk of letters with punctuation behind has
    the ids of its lower-case letters and those of the punctuation.  Chunks and words
    repeat, so their ids are kept (at most ``limit`` of each, then that store starts anew).
    """

    # ASCII punctuation without the apostrophe, which the vocabulary joins to letters
    TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str, limit: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok, self.limit, self.known, self.words = Tokenizer.from_file(path), limit, {}, {}
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def learn(self, chunks) -> None:
        if len(self.known) > self.limit:
            self.known = {}
        if len(self.words) > self.limit:
            self.words = {}
        known, words, made, new, other = self.known, self.words, [], set(), []
        for c in chunks:
            if c in known:
                continue
            t = c.decode("utf-8", "replace")
            core = t.rstrip(self.TAIL)
            low = core.lower()
            # a capital sigma's lower case depends on its place; letters that normalise to
            # letter and mark would join the mark to the punctuation behind
            if core.isalpha() and low.isalpha() and "\u03a3" not in core and is_normalized("NFC", core):
                tail = t[len(core):]
                made.append((c, low, tail))
                if low not in words:
                    new.add(low)
                if tail not in words:
                    words[tail] = self._ids([tail])[0]
            else:
                other.append((c, t))
        # many words go as one text, and their ids part after each end-of-word token
        order, odd = list(new), []
        lines = [order[k:k + 500] for k in range(0, len(order), 500)]
        for line, e in zip(lines, self._batches([" ".join(x) for x in lines])):
            at = np.flatnonzero(self.ends[e]) + 1
            if len(at) != len(line) or at[-1] != len(e):
                odd += line
                continue
            b, at = e.tobytes(), (at * 4).tolist()
            words.update(zip(line, [b[f:t] for f, t in zip([0, *at], at)]))
        words.update(zip(odd, self._ids(odd)))
        for c, low, tail in made:
            known[c] = words[low] + words[tail]
        known.update(zip([c for c, _ in other], self._ids([t for _, t in other])))

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [e.tobytes() for e in self._batches(texts)]

    def _batches(self, texts: list[str], size: int = 2_000):
        for k in range(0, len(texts), size):
            for e in self.tok.encode_batch_fast(texts[k:k + size], add_special_tokens=False):
                yield np.array(e.ids, "<u4")

    def encode(self, texts: list[bytes], end: bytes) -> list[bytes]:
        split = [t.split() for t in texts]  # bytes.split(): ASCII white space only
        self.learn(set().union(*split))
        get = self.known.__getitem__
        return [b"".join(map(get, s)) + end for s in split]


def capacities(total: int, length: int) -> list[int]:
    """Rooms that hold ``total`` tokens exactly: full sequences, then powers of two."""
    q, r = divmod(total, length)
    return [length] * q + [1 << b for b in range(r.bit_length() - 1, -1, -1) if r >> b & 1]


def assign(lengths: list[int], length: int, linear: float, quadratic: float):
    """Pieces (doc index, start, length, sequence, offset) that fill ``capacities`` exactly."""
    caps = capacities(sum(lengths), length)
    room, cost = np.array(caps, np.int64), np.zeros(len(caps))
    heap = [(-min(n - s, length), i, s) for i, n in enumerate(lengths) for s in range(0, n, length)]
    heapq.heapify(heap)
    out = []
    while heap:
        n, i, s = heapq.heappop(heap)
        n = -n
        fits = room >= n
        if fits.any():
            j = int(np.argmin(np.where(fits, cost, np.inf)))
        else:
            j = int(np.argmax(room))
            heapq.heappush(heap, (int(room[j]) - n, i, s + int(room[j])))
            n = int(room[j])
        out.append((i, s, n, j, caps[j] - int(room[j])))
        room[j] -= n
        cost[j] += linear * n + quadratic * n * n
    return out


def _pack_group(path: str, length: int, end_id: int, linear: float, quadratic: float, kept: int):
    def run(key, table):
        enc = worker_store(("packing", path, kept), lambda: Encoder(path, kept))
        group = key[0].as_py()
        table = table.sort_by([("doc_id", "ascending"), ("_row", "ascending")])
        doc = table.column("doc_id").to_pylist()
        ids = enc.encode(table.column("_bytes").to_pylist(), np.array([end_id], "<u4").tobytes())
        lens = [len(b) // 4 for b in ids]
        rows = assign(lens, length, linear, quadratic)
        cols = [[doc[i] for i, *_ in rows], [s for _, s, *_ in rows], [n for _, _, n, *_ in rows],
                [zlib.crc32(memoryview(ids[i])[4 * s:4 * (s + n)]) for i, s, n, *_ in rows],
                [lens[i] for i, *_ in rows], [(group << 32) + j for *_, j, _ in rows], [o for *_, o in rows]]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=names)
    return run


def pack(docs: DataFrame, tokenizer_path: str, length: int = 4096, end_id: int = 2, linear: float = 1.0,
         quadratic: float = 1.0 / 4096, group_bytes: int = 4 << 20, kept: int = 800_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text counts as empty (only the end id).  Every row is packed, repeated rows
    and null ids too.  Groups hold about ``group_bytes`` of text, their number comes
    from the table's size, and rows are dealt by row number, so no key is hot.  A Python
    worker keeps the ids of ``kept`` chunks and as many words: memory against time, not the result.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_bytes"),
                       F.monotonically_increasing_id().alias("_row"))
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    return rows.groupBy("_group").applyInArrow(_pack_group(tokenizer_path, length, end_id, linear, quadratic, kept), SCHEMA)
