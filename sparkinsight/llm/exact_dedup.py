"""Exact dedup by deterministic block naming.

Each text is cut into fixed-size blocks.  The distinct blocks are sorted and numbered,
then the distinct pairs of adjacent names are sorted and numbered, level by level,
until a document has one name.  Equal names at a level mean equal bytes, so (level,
name) identifies a text without collisions.  DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import other_columns_aside, parallelism


def number_sorted(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct key rows with an integer ``name`` in key order.

    Range partitions are sorted and numbered in place and the table is written, so
    later reads and retried tasks see the same names.
    """
    n = max(2, parallelism(df))
    return materialize(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                       .withColumn("name", F.monotonically_increasing_id()))


def name_blocks(rows: DataFrame, hash_bits: int = 64) -> DataFrame:
    """Level 0: (doc_id, sha, n, pos, name) from (doc_id, sha, blocks).

    Blocks meet by a 64-bit hash; where one hash holds several distinct blocks, their
    rank in sorted order is part of the key, so names never collide.  Only distinct
    blocks are shuffled (equal ones combine before it); the occurrences are joined by
    hash.  ``hash_bits`` exists to test the collision path.
    """
    h = F.xxhash64("block")
    if hash_bits < 64:
        h = F.pmod(h, F.lit(1 << hash_bits))
    occ = (rows.select("doc_id", "sha", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
           .withColumn("h", h))
    counts = materialize(occ.select("h", "block").distinct().groupBy("h").agg(F.count("*").alias("k")))
    clash = counts.where("k > 1").select("h")
    if clash.isEmpty():
        occ = occ.withColumn("r", F.lit(1))
    else:
        ranked = (occ.join(clash, "h").select("h", "block").distinct()
                  .withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("block"))))
        occ = occ.join(ranked, ["h", "block"], "left").withColumn("r", F.coalesce("r", F.lit(1)))
    keys = counts.select("h", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("r"))
    named = number_sorted(keys, ["h", "r"])
    return occ.select("doc_id", "sha", "n", "pos", "h", "r").join(named, ["h", "r"]).select(
        "doc_id", "sha", "n", "pos", "name")


def identities(docs: DataFrame, block_bytes: int = 4096, hash_bits: int = 64) -> DataFrame:
    """(doc_id, sha, level, name): equal (level, name) if and only if equal text."""
    b = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), ((F.octet_length("b") - 1) / block_bytes).cast("int")))
    rows = docs.select("doc_id", b.alias("b")).select(
        "doc_id", F.sha2("b", 256).alias("sha"),
        F.transform(cuts, lambda i: F.substring(F.col("b"), i * block_bytes + 1, F.lit(block_bytes))).alias("blocks"))
    cur, level, done = materialize(name_blocks(rows, hash_bits)), 0, []
    most = cur.agg(F.max("n")).first()[0] or 1
    while True:
        done.append(cur.where("n = 1").select("doc_id", "sha", F.lit(level).alias("level"), "name").distinct())
        if most <= 1:
            break
        side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = (cur.where("n > 1").withColumn("half", F.floor(F.col("pos") / 2).cast("int"))
                 .groupBy("doc_id", "sha", "n", "half")
                 .agg(side(0).alias("l"), F.coalesce(side(1), F.lit(-1)).alias("r")))
        named = number_sorted(pairs.select("l", "r").distinct(), ["l", "r"])
        cur = materialize(pairs.join(named, ["l", "r"]).select(
            "doc_id", "sha", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.col("half").alias("pos"), "name"))
        most, level = math.ceil(most / 2), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def dedup_report(docs: DataFrame, block_bytes: int = 4096, hash_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The largest doc_id of equal texts stays; a null id is smaller than any other.
    Null text counts as empty.  Repeated rows (same id and text) get the same answer.
    """
    ids = identities(docs, block_bytes, hash_bits).select(
        F.col("doc_id").alias("_id"), F.col("sha").alias("_sha"), "level", "name")
    base = docs.select("doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("text_sha256"))
    rows = materialize(base.join(ids, (base["text_sha256"] == ids["_sha"]) & base["doc_id"].eqNullSafe(ids["_id"]))
                       .select("doc_id", "text_sha256", "level", "name"))
    groups = rows.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return rows.join(groups, ["level", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


@other_columns_aside
def exact_dedup(docs: DataFrame, block_bytes: int = 4096) -> DataFrame:
    """``docs`` with one row of each text: that of the largest doc_id."""
    cols = docs.columns
    keep = (dedup_report(docs, block_bytes).where("kept").select(F.col("doc_id").alias("_id"),
                                                                 F.col("text_sha256").alias("_sha")).distinct())
    d = docs.withColumn("_text_sha", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    j = d.join(keep, (d["_text_sha"] == keep["_sha"]) & d["doc_id"].eqNullSafe(keep["_id"]))
    return j.select(*[d[c] for c in cols], "_text_sha").dropDuplicates(["doc_id", "_text_sha"]).select(*cols)
