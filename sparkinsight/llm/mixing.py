"""Mixing sources to target weights by cube-method balanced sampling.

Every document of a source has the same expected number of copies r = target / size
of the source.  floor(r) copies are certain; the fraction is drawn with the cube
method: inclusion probabilities move along null-space vectors of the constraints
(document total, word total) until they are 0 or 1.  Flights run on bounded blocks
of one source: units too long for a landing to make up for are settled first, against
all others of the block and for the word total alone.  ``landing`` units of all sizes stay
aside and fly on with the at most two open ones in the next level, until one block of the
source is left; so every source lands over ``landing`` + 2 units, or all it has, whatever
the sizes of the other sources.
"""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import row_positions
from ..session import materialize
from .common import WORD, other_columns_aside, parallelism

EPS = 1e-9


def word_count(text_col: str = "text"):
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")


def source_targets(units: DataFrame, weights=(5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """One row per source: source, source_size, n_units, weight, target.

    Sources take ``weights`` in turn by code point order (null last).  target =
    min(max_repeat * size, level * weight), where the level makes the targets share
    the total of all sizes; it rises until no further source meets its cap, one small
    aggregation over the source table per step.
    """
    src = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"),
                                      F.count("*").alias("n_units"))
    src = src.withColumn("_one", F.lit(1)).withColumn("_null", F.col("source").isNull().cast("int"))
    src = row_positions(src, ["_one"], ["_null", "source"], out="_pos", partitions=min(8, parallelism(units)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_pos") % len(weights) + 1).cast("int"))
    src = materialize(src.select("source", "source_size", "n_units", w.alias("weight"),
                                 (F.col("source_size") * F.lit(float(max_repeat))).alias("cap")))
    total = src.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = F.col("cap") < F.lit(level) * F.col("weight")
        row = src.agg(F.count(F.when(over, 1)).alias("n"),
                      F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)).alias("fixed"),
                      F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("open")).first()
        if row["n"] == capped or row["open"] == 0:
            break
        capped, level = row["n"], (total - row["fixed"]) / row["open"]
    return src.withColumn("target", F.least(F.col("cap"), F.lit(level) * F.col("weight")))


def _step(open_, u, probs, rng):
    """Move open units along ``u``, up or down, until one settles; the ones still open."""
    up = down = math.inf
    for x, v in zip(open_, u):
        p = probs[x]
        if v > 0:
            up, down = min(up, (1 - p) / v), min(down, p / v)
        elif v < 0:
            up, down = min(up, -p / v), min(down, (p - 1) / v)
    step = up if rng.random() * (up + down) < down else -down
    keep = []
    for x, v in zip(open_, u):
        p = probs[x] + step * v
        if p <= EPS or p >= 1 - EPS:
            probs[x] = float(round(min(1.0, max(0.0, p))))
        else:
            probs[x] = p
            keep.append(x)
    return keep


def fly(sizes, counts, probs, rng):
    """Flight phase over one block, in place: probabilities move until <= 2 are open.

    Two balancing totals need a vector in the null space of a 2 x 3 matrix, so three
    open units move at a time; a settled one is replaced by the next unit.
    """
    open_, nxt, n = [], 0, len(probs)
    while True:
        while len(open_) < 3 and nxt < n:
            if EPS < probs[nxt] < 1 - EPS:
                open_.append(nxt)
            else:
                probs[nxt] = float(round(probs[nxt]))
            nxt += 1
        if len(open_) < 3:
            return open_
        i, j, k = open_
        # null vector of [[m_i, m_j, m_k], [s_i m_i, ...]]
        u = ((sizes[k] - sizes[j]) / counts[i], (sizes[i] - sizes[k]) / counts[j], (sizes[j] - sizes[i]) / counts[k])
        if not any(u):
            u = (1.0 / counts[i], -1.0 / counts[j], 0.0)
        open_ = _step(open_, u, probs, rng)


def aside(units, landing):
    """``landing`` of the units, of all sizes as they are sorted by it; few units: all."""
    n = len(units)
    return list(units) if n <= landing + 2 else [units[(2 * k + 1) * n // (2 * landing)] for k in range(landing)]


def settle_long(sizes, counts, probs, units, landing, rng):
    """Settle, in place, the units with more words than ``landing`` others can make up for.

    Each moves against all others, but for those of the landing, at once, in proportion to p (1 - p), which
    keeps the word total and every expectation.  The units still open are returned.
    """
    units = sorted(units, key=lambda x: -sizes[x] * counts[x])
    w = np.array([sizes[x] * counts[x] for x in units], float)
    p = np.array([probs[x] for x in units])
    at = aside(range(len(units)), landing)
    free = np.ones(len(units), bool)
    free[at] = False  # for the landing
    limit = float((p * (1 - p) * w)[at].sum()) / 2
    for x in np.flatnonzero(free).tolist():
        if w[x] <= limit:
            break
        while EPS < p[x] < 1 - EPS:
            v = np.where(free & (w > 0), p * (1 - p), 0.0)
            v[x] = 0.0
            rest = np.flatnonzero(v)
            total = float(v @ w)
            if not len(rest):
                break
            up = min(1 - p[x], total / (w[x] * (1 - p[rest]).max()))
            down = min(p[x], total / (w[x] * p[rest].max()))
            step = up if rng.random() * (up + down) < down else -down
            p[x] += step
            p -= step * w[x] * v / total
            p = np.where(p <= EPS, 0.0, np.where(p >= 1 - EPS, 1.0, p))
    for x, q in zip(units, p.tolist()):
        probs[x] = q
    return sorted(x for x in units if EPS < probs[x] < 1 - EPS)


def land(sizes, counts, probs, open_):
    """Landing: of all completions of the open units, the one nearest in words, then in rows."""
    p = np.array([probs[x] for x in open_])
    m = np.array([counts[x] for x in open_], float)
    s = np.array([sizes[x] for x in open_], float) * m
    pick = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    words, rows = np.abs(np.rint((pick - p) @ s)), np.abs((pick - p) @ m)
    best = pick[np.lexsort((rows, words))[0]]
    for x, v in zip(open_, best):
        probs[x] = float(v)


def _flight(seed: int, landing: int):
    def run(key, table):
        if table.num_rows == 0:
            return table
        t = table.sort_by([("size", "descending"), ("doc_id", "ascending")])
        sizes, counts, probs = (t.column(c).to_pylist() for c in ("size", "m", "p"))
        rng = random.Random(zlib.crc32(repr((seed, [k.as_py() for k in key])).encode()))
        units = [i for i, p in enumerate(probs) if EPS < p < 1 - EPS]
        probs = [p if EPS < p < 1 - EPS else float(round(p)) for p in probs]
        if len(units) > 2:
            units = settle_long(sizes, counts, probs, units, landing, rng)
        # every flight leaves units of all sizes, down to the landing of the source
        spare = set(aside(units, landing))
        ready = [i for i in units if i not in spare]
        moved = [probs[i] for i in ready]
        left = fly([sizes[i] for i in ready], [counts[i] for i in ready], moved, rng)
        for i, p in zip(ready, moved):
            probs[i] = p
        left = sorted([ready[i] for i in left] + list(spare))
        if left and t.column("nb")[0].as_py() <= 1:  # the only block of its source
            land(sizes, counts, probs, left)
        return t.set_column(t.schema.get_field_index("p"), "p", pa.array(probs, pa.float64()))
    return run


def mix_units(docs: DataFrame, weights=(5, 2, 1), max_repeat: int = 3, block: int = 4096, seed: int = 1,
              landing: int = 14) -> DataFrame:
    """Copies per document: doc_id, source, size, m, source_size, target, copies (long).

    Rows with equal (doc_id, source, size) are one unit of m rows that get the same
    number of copies.  Null text: size 0.  An empty table gives an empty result.
    """
    units = materialize(docs.select("doc_id", "source", word_count().alias("size"))
                        .groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")))
    src = source_targets(units, weights, max_repeat)
    rate = F.when(F.col("target") >= F.col("cap"), F.lit(float(max_repeat))).otherwise(
        F.try_divide(F.col("target"), F.col("source_size")))
    src = src.select(F.col("source").alias("_src"), "source_size", "target",
                     F.when(F.col("source_size") == 0, 0.0).otherwise(rate).alias("_rate"),
                     F.ceil(F.col("n_units") / block).cast("long").alias("nb"))
    most = src.agg(F.max("nb")).first()[0] or 1
    cols = ["doc_id", "source", "size", "m", "source_size", "target", "base", "nb", "b", "p"]
    cur = (units.join(src, F.col("source").eqNullSafe(F.col("_src")))
           .withColumn("base", F.floor("_rate").cast("long"))
           .withColumn("p", F.col("_rate") - F.col("base"))
           .withColumn("b", F.pmod(F.xxhash64("doc_id", "size"), F.col("nb"))).select(*cols))
    # landing + 2 open units a block at most: half a block's worth of them meet in one
    fan = max(2, block // (2 * (landing + 2)))
    done, level = [], 0
    while True:
        cur = materialize(cur.groupBy("source", "b").applyInArrow(_flight(seed + level, landing), cur.schema))
        if most <= 1:
            done.append(cur)
            break
        settled = (F.col("p") == 0) | (F.col("p") == 1)
        done.append(cur.where(settled))
        cur = (cur.where(~settled).withColumn("b", F.floor(F.col("b") / fan).cast("long"))
               .withColumn("nb", F.ceil(F.col("nb") / fan).cast("long")))
        most, level = math.ceil(most / fan), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "source", "size", "m", "source_size", "target",
                      (F.col("base") + F.col("p").cast("long")).alias("copies"))


def mix_report(docs: DataFrame, **kw) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted)."""
    u = mix_units(docs, **kw)
    return (u.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("_i"))
            .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")))


@other_columns_aside
def mix(docs: DataFrame, **kw) -> DataFrame:
    """The mixed documents themselves: each row of ``docs`` as often as the mix takes it."""
    cols = docs.columns
    u = mix_units(docs, **kw).where("copies > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "copies")
    d = docs.withColumn("_words", word_count())
    j = d.join(u, d["doc_id"].eqNullSafe(u["_id"]) & d["source"].eqNullSafe(u["_source"])
               & (d["_words"] == u["_size"]))
    return (j.select(*[d[c] for c in cols], F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
            .select(*cols))
