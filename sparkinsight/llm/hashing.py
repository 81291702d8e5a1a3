"""64-bit hashes of words and word runs in numpy, and compressed texts for shuffles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of

MULT = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * BASE
    x = (x ^ (x >> np.uint64(29))) * MULT
    return x ^ (x >> np.uint64(32))


class WordHasher:
    """64-bit hashes of the words of texts; known words are kept, at most ``limit``."""

    def __init__(self, lower: bool = False, limit: int = 200_000):
        self.lower, self.limit, self.known = lower, limit, {}

    def __call__(self, texts: list[bytes]):
        """(words of each text, their number, hashes in a row).

        bytes.split() cuts at \\x20 and \\x09-\\x0D, bytes.lower() changes A-Z only.
        """
        if len(self.known) > self.limit:
            self.known = {}
        known = self.known
        words = [t.lower().split() if self.lower else t.split() for t in texts]
        for w in words:
            for x in set(w):
                if x not in known:
                    known[x] = xxhash.xxh64_intdigest(x)
        lens = np.array([len(w) for w in words], np.int64)
        get = known.__getitem__
        return words, lens, np.fromiter((h for w in words for h in map(get, w)), np.uint64, int(lens.sum()))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash (polynomial in BASE modulo 2^64) of every run of ``size`` words."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * BASE + hashes[k:k + n]
    return mix(out)


def chunks(texts: list, limit: int = 4 << 20, most: int = 30_000):
    """(from, to) runs of about ``limit`` bytes and at most ``most`` texts."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit or i + 1 - start >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def compressed(docs: DataFrame) -> DataFrame:
    """(doc_id, z): texts as zstd bytes, about half of what a shuffle would write."""
    def run(batches):
        import zstandard
        c = zstandard.ZstdCompressor(level=3)
        for b in batches:
            z = [c.compress(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z, pa.binary())], names=["doc_id", "z"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), bytes_of().alias("b")).mapInArrow(
        run, "doc_id long, z binary")


def decompressor():
    import zstandard
    return zstandard.ZstdDecompressor().decompress


def power_of_two(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, n)))))


def total_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
