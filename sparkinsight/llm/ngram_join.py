"""N-gram Jaccard join with one-partition signatures, a count filter and a prefix filter.

A document's set holds the hashes of its distinct word shingles.  Sets are dealt to size
bands of ratio just over 1 / similarity, so that similar sets lie in one band or in
neighbours; a set joins the scheme of its band and that of the band below.  A scheme
deals the hash domain to partitions as PartEnum does, but enumerates no subsets of them:
the signatures are the contents of the single non-empty partitions.  Sets at
least ``similarity`` alike differ in at most k elements, each of which spoils one
signature, so of A's m signatures they share m - k or more (``needed``, over 0).

The texts are read once for sets and signatures alike (and once more for those sets that
may have a partner).  Signatures are counted in parts of the signature space.  Those of one set only drop out;
a set with fewer repeated signatures than needed has no partner; and of the others, in
order of frequency, only the first (repeated - needed + 1) must be looked at, as similar
sets share one of them.  So a very common passage costs no pairs.  Candidates are
verified exactly.  The components come from few links: first each set with the centre it
shares most with; sets that hang together by these candidates form clusters.  Where a
signature's sets are not connected yet, those of one cluster are compared in blocks of
bounded size (which give back spanning links only), and pairs across clusters one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import bytes_of, drop_stores, other_columns_aside
from .graph import components
from .hashing import MULT, WordHasher, chunks, decompressor, mix, power_of_two, total_bytes, window_hashes

SETS = "doc_id long, n_shingles long, set_id long, needed array<int>"


# ---- sets ------------------------------------------------------------------------
def shingle_sets(texts: list[bytes], size: int, hasher: WordHasher):
    """(hashes, owner, n): the distinct shingle hashes of all texts, by text and value, the
    text each belongs to, and each text's number.  Fewer words than ``size`` make one
    shingle, no words none.  At most 65,535 texts."""
    _, lens, words = hasher(texts)
    end = np.cumsum(lens)
    h = window_hashes(words, size)
    of = np.repeat(np.arange(len(lens)), lens)[:len(h)]
    ok = np.arange(len(h)) + size <= end[of]
    h, of = h[ok], of[ok]
    few = [i for i in np.flatnonzero((lens > 0) & (lens < size))]
    if few:
        one = [mix(window_hashes(words[end[i] - lens[i]:end[i]], int(lens[i])) + np.uint64(lens[i])) for i in few]
        h, of = np.concatenate([h, *one]), np.concatenate([of, few])
    order = np.argsort(h)
    order = order[np.argsort(of[order].astype(np.uint16), kind="stable")]
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, of, np.bincount(of, minlength=len(lens))


def set_ids(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit identity of each text's set (0 for the empty set)."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h), dtype=np.uint64)])
    end = np.cumsum(n)
    out = mix(total[end] - total[end - n] + n.astype(np.uint64) * MULT).astype(np.int64)
    return np.where(n > 0, out, 0)


# ---- schemes -----------------------------------------------------------------------
class Schemes:
    def __init__(self, percent: int, seed: int = 0):
        self.percent, self.seed = percent, seed
        ratio = 100 / percent * 1.004  # a little over, so that rounding cannot part neighbours
        b = [0.9]
        while b[-1] < 1e12:
            b.append(b[-1] * ratio)
        self.bounds = s = np.array(b)
        # many partitions for small sets (one element each), about three elements each for
        # large ones, and always more than similar sets of the scheme can differ in
        size = np.where(s < 64, 1 << 20, np.where(s < 128, s, np.where(s < 400, s / 2, s / 2.5)))
        self.partitions = size.astype(np.uint64) + np.uint64(1)

    def bands(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, n, "right") - 1

    def spoiled(self, n: np.ndarray, lower: bool) -> np.ndarray:
        """The most elements in which a set of n and a similar one can differ.

        |A xor B| <= (|A| + |B|) (100 - p) / (100 + p) and |B| <= 100 |A| / p; in the scheme of
        the band below, the partner lies in that band.
        """
        p = self.percent
        both = n + (self.bounds[np.maximum(0, self.bands(n))].astype(np.int64) if lower else n * 100 // p)
        return both * (100 - p) // (100 + p)

    def signatures(self, h: np.ndarray, of: np.ndarray, n: np.ndarray, lower: bool):
        """(signatures, owner) of all sets in the scheme of their band or of the one below."""
        scheme = self.bands(n) - int(lower)
        tag = (scheme + 2).astype(np.uint64) * np.uint64(1_000_003) + np.uint64(self.seed)
        tag, salt = tag[of], (tag * MULT)[of]
        part = (mix(h ^ salt) >> np.uint64(20)) % self.partitions[np.maximum(0, scheme)][of]
        key = (of.astype(np.uint64) << np.uint64(44)) | part
        order = np.argsort(key)
        key = key[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        if not len(at):
            return np.zeros(0, np.uint64), at
        first = order[at]
        content = np.add.reduceat(mix(h + tag)[order], at)
        return mix(content + mix(part[first] + salt[first])), of[first]


# ---- signatures counted in parts of their space ----------------------------------------
def _low5(h):
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from5(b):
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _set_texts(size: int):
    """(set_id, z): the set of each text and the text as zstd bytes."""
    def run(batches):
        import zstandard
        hasher, squeeze = WordHasher(lower=True), zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            texts = b.column(0).to_pylist()
            for s, e in chunks(texts):
                h, of, n = shingle_sets(texts[s:e], size, hasher)
                use = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(set_ids(h, n)[use]), pa.array([squeeze(texts[s + i]) for i in use], pa.binary())], names=["set_id", "z"])
    return run


def _send(size: int, schemes: Schemes, parts: int, buckets: int):
    """One reading of the texts: each set's signatures, dealt to parts, and beside the parts
    (from number ``parts`` on) what is told of the documents: id, size and id of the set,
    and the number of signatures that a similar set shares."""
    mask, bits = np.uint64(parts - 1), np.uint64(parts.bit_length() - 1)

    def run(batches):
        drop_stores()
        hasher = WordHasher(lower=True)
        for b in batches:
            texts = b.column(1).to_pylist()
            for s, e in chunks(texts):
                h, of, n = shingle_sets(texts[s:e], size, hasher)
                ids = set_ids(h, n)
                two = [schemes.signatures(h, of, n, low) for low in (False, True)]
                need = [np.bincount(t[1], minlength=len(n)) - schemes.spoiled(n, low) for t, low in zip(two, (False, True))]
                # documents are dealt by a hash of all their ids and sets: a retried task deals them alike
                docs = b.column(0).slice(s, e - s).to_pylist()
                spread = xxhash.xxh64_intdigest(ids.tobytes() + repr(docs).encode()) % buckets
                out = [(parts + spread, ids.astype("<i8").tobytes(), n.astype("<i8").tobytes(), np.stack(need, 1).astype("<i4").tobytes(), docs)]
                # equal sets of one chunk are sent once
                first = np.zeros(len(n), bool)
                first[np.unique(ids, return_index=True)[1]] = True
                first &= n > 0
                # the scheme (own band or the one below) is the lowest bit of the owner
                sig, own = np.concatenate([t[0] for t in two]), np.concatenate([t[1] * 2 + low for low, t in enumerate(two)])
                use = first[own >> 1]
                sig, own = sig[use], own[use]
                part = (sig & mask).astype(np.int64)
                order = np.argsort(part * (2 * len(n)) + own, kind="stable")
                sig, part, own = sig[order] >> bits, part[order], own[order]
                cut = np.flatnonzero(np.diff(part, prepend=-1, append=parts)) if len(sig) else []
                for f, t in zip(cut[:-1], cut[1:]):
                    r, k = np.unique(own[f:t], return_counts=True)
                    out.append((int(part[f]), ids[r >> 1].astype("<i8").tobytes(), (k * 2 + (r & 1)).astype("<u4").tobytes(), _low5(sig[f:t]), None))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.int64()), *[pa.array([o[k] for o in out], pa.binary()) for k in (1, 2, 3)],
                     pa.array([o[4] for o in out], pa.list_(pa.int64()))], names=["part", "sets", "counts", "sigs", "docs"])
    return run


SENT = "part long, sets binary, counts binary, sigs binary, docs array<long>"
# of the parts: repeated signatures by bucket of sets; of the documents (bucket -1): ids and what is told of them
BACK = "bucket long, sets binary, low binary, n binary, sig binary, freq binary, docs array<long>"


def _sets(batches):
    """Per document: its set's size, id and the number of signatures a similar set shares."""
    for b in batches:
        docs = b.column(3).flatten()
        ids, n, need = (np.frombuffer(b"".join(b.column(k).to_pylist()), t) for k, t in ((0, "<i8"), (1, "<i8"), (2, "<i4")))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(n) + 1, 2), pa.int32()), pa.array(need.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([docs, pa.array(n.astype(np.int64)), pa.array(ids.astype(np.int64), mask=n == 0), lists],
                                         names=["doc_id", "n_shingles", "set_id", "needed"])


def _repeated(parts: int, buckets: int):
    """Of one part: signatures of two or more sets, with their frequency, by set."""
    bits = np.uint64(parts.bit_length() - 1)

    def run(key, table):
        if key[0].as_py() >= parts:  # documents, told as they are
            none = pa.nulls(table.num_rows, pa.binary())
            return pa.table({"bucket": pa.array([-1] * table.num_rows, pa.int64()), "sets": table.column("sets"), "low": none,
                             "n": table.column("counts"), "sig": table.column("sigs"), "freq": none, "docs": table.column("docs")})
        part = np.uint64(key[0].as_py())
        cols = [table.column(c).to_pylist() for c in ("sets", "counts", "sigs")]
        sets = np.concatenate([np.frombuffer(x, "<i8") for x in cols[0]])
        count = np.concatenate([np.frombuffer(x, "<u4") for x in cols[1]])
        sig = np.concatenate([_from5(x) for x in cols[2]])
        owner = np.repeat(np.arange(len(sets)), count >> 1)
        order = np.lexsort((sets[owner], sig))
        sig, owner = sig[order], owner[order]
        # a set that came from several batches counts once
        same = (sig[1:] == sig[:-1]) & (sets[owner[1:]] == sets[owner[:-1]])
        keep = np.concatenate([[True], ~same])
        sig, owner = sig[keep], owner[keep]
        at = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        freq = np.repeat(np.diff(at, append=len(sig)), np.diff(at, append=len(sig)))
        hit = freq > 1
        sig, owner, freq = (sig[hit] << bits) | part, owner[hit], freq[hit]
        order = np.argsort(owner, kind="stable")
        sig, owner, freq = sig[order], owner[order], freq[order]
        cut = np.flatnonzero(np.diff(owner, prepend=-1, append=len(sets) + 1)) if len(owner) else []
        rows = [(int(sets[owner[s]]), int(count[owner[s]] & 1), sig[s:e].astype(np.int64), freq[s:e])
                for s, e in zip(cut[:-1], cut[1:]) if s < len(owner)]
        by = {}
        for r in rows:
            by.setdefault(r[0] % buckets, []).append(r)
        cat = lambda x, k, t: np.concatenate([np.atleast_1d(r[k]) for r in x]).astype(t).tobytes()
        return pa.table({
            "bucket": pa.array(list(by), pa.int64()),
            "sets": pa.array([cat(x, 0, "<i8") for x in by.values()], pa.binary()),
            "low": pa.array([cat(x, 1, "u1") for x in by.values()], pa.binary()),
            "n": pa.array([np.array([len(r[2]) for r in x], "<u4").tobytes() for x in by.values()], pa.binary()),
            "sig": pa.array([cat(x, 2, "<i8") for x in by.values()], pa.binary()),
            "freq": pa.array([cat(x, 3, "<u4") for x in by.values()], pa.binary()),
            "docs": pa.nulls(len(by), pa.list_(pa.int64()))})
    return run


PREFIX = "set_id long, size long, sigs array<long>"


def _prefix(key, table, needed):
    """Of one bucket of sets: the signatures each must look at (none: no partner)."""
    if not table.num_rows:
        return pa.table({"set_id": pa.array([], pa.int64()), "size": pa.array([], pa.int64()),
                         "sigs": pa.array([], pa.list_(pa.int64()))})
    col = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()])
    n = col("n", "<u4")
    own = np.repeat(np.stack([col("sets", "<i8"), col("low", "u1").astype(np.int64)], 1), n, axis=0)
    sig, freq = col("sig", "<i8"), col("freq", "<u4")
    order = np.lexsort((sig, freq, own[:, 1], own[:, 0]))
    own, sig = own[order], sig[order]
    info = {i: (s, t) for i, s, t in zip(*(needed.column(c).to_pylist() for c in ("set_id", "n_shingles", "needed")))}
    at = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]).any(1)]))
    found = {}
    for s, e in zip(at, np.append(at[1:], len(own))):
        k = int(own[s, 0])
        t = info[k][1][int(own[s, 1])]
        if e - s >= t:
            found.setdefault(k, []).append(sig[s:e - max(1, t) + 1])
    return pa.table({"set_id": pa.array(list(found), pa.int64()), "size": pa.array([info[k][0] for k in found], pa.int64()),
                     "sigs": pa.array([np.concatenate(v) for v in found.values()], pa.list_(pa.int64()))})


# ---- exact verification ------------------------------------------------------------------
def _verify(size: int, percent: int):
    def run(batches):
        hasher, un = WordHasher(lower=True), decompressor()
        for b in batches:
            x, y = (b.column(k).to_pylist() for k in (2, 3))
            for s in range(0, len(x), 200):
                # both sides' sets in one go, each text once
                place, texts = {}, []
                for z in [*x[s:s + 200], *y[s:s + 200]]:
                    if z not in place:
                        place[z] = len(texts)
                        texts.append(un(z))
                h, _, n = shingle_sets(texts, size, hasher)
                end = np.cumsum(n)
                ok = []
                for i, j in zip(map(place.get, x[s:s + 200]), map(place.get, y[s:s + 200])):
                    two = np.concatenate([h[end[i] - n[i]:end[i]], h[end[j] - n[j]:end[j]]])
                    two.sort()
                    both = int((two[1:] == two[:-1]).sum())
                    ok.append(100 * both >= percent * (len(two) - both))
                k = len(ok)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, k), b.column(1).slice(s, k), pa.array(ok, pa.bool_())],
                                                 names=["a", "b", "linked"])
    return run


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b, linked) for candidate pairs of sets, from the sets' texts."""
    ta = texts.select(F.col("set_id").alias("a"), F.col("z").alias("za"))
    tb = texts.select(F.col("set_id").alias("b"), F.col("z").alias("zb"))
    j = pairs.join(tb, "b").join(ta, "a").select("a", "b", "za", "zb")
    return materialize(j.mapInArrow(_verify(size, percent), "a long, b long, linked boolean"))


# ---- clusters of candidates, in blocks ------------------------------------------------------
BLOCK = "clu long, blk long, ids array<long>, comps array<long>, zs array<binary>"


def _pack_block(key, table):
    return pa.table({"clu": [key[0].as_py()], "blk": [key[1].as_py()], "ids": [table.column("set_id").to_pylist()],
                     "comps": [table.column("comp").to_pylist()], "zs": [table.column("z").to_pylist()]},
                    schema=pa.schema([("clu", pa.int64()), ("blk", pa.int64()), ("ids", pa.list_(pa.int64())),
                                      ("comps", pa.list_(pa.int64())), ("zs", pa.list_(pa.binary()))]))


def overlaps(h: np.ndarray, of: np.ndarray, sets: int, width: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections of a bounded number of sets."""
    order = np.argsort(h, kind="stable")
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    col = np.cumsum(new) - 1
    often = np.bincount(col) > 1 if len(col) else np.zeros(0, bool)
    keep = often[col] if len(col) else np.zeros(0, bool)
    col, of = (np.cumsum(often) - 1)[col[keep]], of[keep]
    out = np.zeros((sets, sets), np.float32)
    for c in range(0, int(often.sum()), width):
        s, e = np.searchsorted(col, (c, c + width))
        m = np.zeros((sets, width), np.float32)
        m[of[s:e], col[s:e] - c] = 1
        out += m @ m.T
    return out


def _verify_blocks(size: int, percent: int):
    """Links that span what two blocks of a cluster connect: a row per set at most."""
    def run(batches):
        hasher, un = WordHasher(lower=True), decompressor()
        for b in batches:
            for i in range(b.num_rows):
                i1, c1, z1, i2, c2, z2, same = (c[i].as_py() for c in b.columns)
                ids, comp, zs = (i1, c1, z1) if same else (i1 + i2, c1 + c2, z1 + z2)
                h, of, n = shingle_sets([un(z) for z in zs], size, hasher)
                both = overlaps(h, of, len(n)).astype(np.int64)
                hit = 100 * both >= percent * (n[:, None] + n[None, :] - both)
                comp = np.array(comp)
                hit &= comp[:, None] != comp[None, :]
                root = np.arange(len(n))
                while True:
                    new = np.minimum(root, np.where(hit, root[None, :], len(n)).min(1))
                    new = np.minimum(new, new[new])
                    if (new == root).all():
                        break
                    root = new
                k = np.flatnonzero(root != np.arange(len(n)))
                ids = np.array(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[k]), pa.array(ids[root[k]])], names=["a", "b"])
    return run


def near_sets(docs: DataFrame, size: int = 5, percent: int = 80, part_sigs: int = 1 << 20, least_parts: int = 64,
              block: int = 256):
    """(rows, components): per document (doc_id, n_shingles, set_id) and each linked set's component."""
    total = total_bytes(docs)
    parts = max(least_parts, power_of_two(total / 12 / part_sigs))
    buckets = max(1, -(-total // (8 << 20)))
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bytes_of().alias("b"))
    for seed in range(64):
        schemes = Schemes(percent, seed)
        sent = raw.mapInArrow(_send(size, schemes, parts, buckets), SENT)
        back = materialize(sent.groupBy("part").applyInArrow(_repeated(parts, buckets), BACK))
        rows = materialize(back.where("bucket < 0").select("sets", "n", "sig", "docs").mapInArrow(_sets, SETS))
        thin = F.least(F.get("needed", F.lit(0)), F.get("needed", F.lit(1)))
        # the guarantee needs one shared signature: another dealing if a set has too few
        if rows.where((F.col("n_shingles") > 0) & (thin < 1)).isEmpty():
            break
    back = back.where("bucket >= 0").drop("docs")
    info = (rows.where("set_id is not null").groupBy("set_id").agg(
        F.max("n_shingles").alias("n_shingles"), F.max("needed").alias("needed"))
        .withColumn("bucket", F.pmod("set_id", F.lit(buckets))))
    pre = materialize(back.groupBy("bucket").cogroup(info.groupBy("bucket")).applyInArrow(_prefix, PREFIX))
    texts = materialize(raw.select("b").mapInArrow(_set_texts(size), "set_id long, z binary")
                        .join(pre.select("set_id"), "set_id", "left_semi").dropDuplicates(["set_id"]))

    # each set with the centre (the member of least hash of a signature's sets) it shares most with
    fits = F.least("size", "size2") * 100 >= F.greatest("size", "size2") * percent
    m = pre.select("set_id", "size", F.explode("sigs").alias("sig"))
    centre = (m.groupBy("sig").agg(F.min(F.struct(F.xxhash64("set_id"), F.col("set_id"), F.col("size"))).alias("c"), F.count("*").alias("n"))
              .where("n > 1").select("sig", F.col("c.set_id").alias("b"), F.col("c.size").alias("size2")))
    cand = (m.join(centre, "sig").where((F.col("set_id") != F.col("b")) & fits)
            .groupBy(F.col("set_id").alias("a"), "b").agg(F.count("*").alias("n")))
    best = materialize(cand.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))).where("r = 1")
                       .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = verify(best, texts, size, percent).where("linked").select("a", "b")
    comps, clusters = components(links), components(best)

    # signatures whose sets are not one component yet
    named = (pre.join(comps, F.col("set_id") == F.col("node"), "left").select(
        "set_id", "size", "sigs", F.coalesce("component", "set_id").alias("comp"))
        .join(clusters.withColumnRenamed("component", "clu"), F.col("set_id") == F.col("node"), "left")
        .select("set_id", "size", "comp", F.coalesce("clu", "set_id").alias("clu"), F.explode("sigs").alias("sig")))
    open_ = named.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig")
    rest = materialize(named.join(open_, "sig", "left_semi"))
    # inside a cluster: all its open sets against each other, in blocks of bounded size
    members = rest.groupBy("set_id").agg(F.first("clu").alias("clu"), F.first("comp").alias("comp"))
    sizes = members.groupBy("clu").agg(F.ceil(F.count("*") / block).alias("nb"), F.min("comp").alias("lo"),
                                       F.max("comp").alias("hi")).where("lo < hi").select("clu", "nb")
    blocks = materialize(members.join(sizes, "clu").withColumn("blk", F.pmod(F.xxhash64("set_id"), F.col("nb")))
                         .join(texts, "set_id").groupBy("clu", "blk").applyInArrow(_pack_block, BLOCK))
    two = blocks.select(F.col("clu"), F.col("blk").alias("blk2"), F.col("ids").alias("ids2"), F.col("comps").alias("comps2"),
                        F.col("zs").alias("zs2"))
    work = blocks.join(two, "clu").where("blk <= blk2").select("ids", "comps", "zs", "ids2", "comps2", "zs2",
                                                                (F.col("blk") == F.col("blk2")).alias("same"))
    inside = materialize(work.mapInArrow(_verify_blocks(size, percent), "a long, b long"))
    # across clusters: the candidate pairs one by one
    other = rest.select("sig", F.col("set_id").alias("b"), F.col("size").alias("size2"), F.col("comp").alias("comp2"),
                        F.col("clu").alias("clu2"))
    pairs = (rest.join(other, "sig").where((F.col("set_id") < F.col("b")) & (F.col("clu") != F.col("clu2"))
                                           & (F.col("comp") != F.col("comp2")) & fits)
             .select(F.col("set_id").alias("a"), "b").distinct())
    across = verify(pairs, texts, size, percent).where("linked").select("a", "b")
    return rows.select("doc_id", "n_shingles", "set_id"), components(links.unionByName(inside).unionByName(across))


def ngram_join(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable by links).

    Words are lower-cased (A-Z) runs without white space.  Documents without words, or
    null, have the empty set and are linked with nothing.  Null ids take part but are
    never the least id.  Repeated rows have equal sets, so they share a component.
    """
    rows, comps = near_sets(docs, size, percent)
    # sets first: a set of a third of all documents joins as one row
    own = (rows.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"))
           .join(comps, F.col("set_id") == F.col("node"), "left")
           .select("set_id", "least", F.coalesce("component", "set_id").alias("comp")))
    own = materialize(own)
    least = own.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = own.join(least, "comp").select("set_id", "component_id")
    return (rows.join(named, "set_id", "left")
            .select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id"))
                    .otherwise(F.col("component_id")).alias("component_id")))


@other_columns_aside
def keep_first(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: that of the least doc_id.

    Documents without words are kept.  Rows that repeat the kept id stay; a component
    whose ids are all null stays whole.
    """
    r = ngram_join(docs, size, percent).where(
        F.col("component_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("_id")).distinct()
    return docs.join(r, docs["doc_id"].eqNullSafe(r["_id"]), "left_semi")
