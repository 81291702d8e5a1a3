"""Approximate retrieval over an inverted-file index.

Cells are k-means centres fitted on a bounded sample; every vector is assigned to its
nearest cell and the store is written partitioned by cell, a large cell as many files.
A search reads only the cells nearest to its queries (partition pruning) and ranks their
rows by the exact cosine.  How many cells that takes for a wanted recall is measured:
of sampled rows the exact neighbours are found, and the place of each neighbour's cell
in the query's order of cells says how many cells must be read to see it.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .retrieval import MAX_QUERY_BLOCK, TOP_K, DENSE_ROWS, TopK, ids_of, query_blocks, ranked_hits, retrieve_dense, \
    rows_at_once, unit_rows

# Rows that fit the cells, and the rounds of the fit.
FIT_ROWS = 16_384
FIT_ROUNDS = 10
# Most cells of an index (the centres travel to every task).
MAX_CELLS = 16_384
# Rows of a file of a cell; a larger cell is split by a hash of the id.
ROWS_PER_FILE = 1_000_000
# Rows whose exact neighbours set the number of cells read, and the recall wanted of them.
TUNE_ROWS = 256
RECALL = 0.95
# Rows that cannot be compared (no vector, zero, not finite, another length) are kept here.
NO_CELL = -1


@dataclass
class VectorIndex:
    """A written index: its folder, unit centres by cell, and the cells read by a search."""

    path: str
    centres: np.ndarray
    probes: int
    recall: float
    id_col: str
    vec_col: str
    schema: str

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(os.path.join(self.path, "vectors"))


def _comparable(vec_col: str) -> Column:
    v = F.col(vec_col)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)


def _drawn(rows: DataFrame, id_col: str, n: int, most: int, seed: int) -> DataFrame:
    """About ``most`` of ``n`` rows by a hash of the id (a threshold, so no task orders them all)."""
    span = 1 << 30
    share = min(1.0, 1.1 * most / max(n, 1))
    return rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(span)) < int(share * span)).limit(2 * most)


def _fit_cells(sample: DataFrame, vec_col: str, cells: int, rounds: int, seed: int) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    rows = sample.select(array_to_vector(F.transform(vec_col, lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=cells, maxIter=rounds, seed=seed, distanceMeasure="cosine").fit(rows)
    return unit_rows(np.array(model.clusterCenters(), dtype="float64"))


def _assign(centres, vec_col: str):
    """The nearest cell of every row of an Arrow batch; the vector is the last column."""
    def run(batches):
        c = centres.value
        for b in batches:
            vec = b.column(b.num_columns - 1)
            cell = np.full(b.num_rows, NO_CELL, np.int32)
            ok = np.flatnonzero(np.array([v is not None and len(v) == c.shape[1] for v in vec.to_pylist()], bool))
            for s in range(0, len(ok), DENSE_ROWS):
                at = ok[s:s + DENSE_ROWS]
                m = np.array(vec.take(pa.array(at)).to_pylist(), dtype="float64").reshape(len(at), -1)
                usable = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
                cell[at[usable]] = np.argmax(m[usable] @ c.T, axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"])
    return run


def build_index(store: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding", keep: list[str] | None = None,
                cells: int | None = None, fit_rows: int = FIT_ROWS, rounds: int = FIT_ROUNDS, recall: float = RECALL,
                k: int = TOP_K, seed: int = 42) -> VectorIndex:
    """Writes an index of every row of ``store`` below ``path`` and measures the cells a search must read.

    About the square root of the row count is taken for the cells.  The sample (``fit_rows``)
    only places the cells: every row is indexed, and those without a comparable vector
    stand in a cell of their own that no search reads.
    """
    spark = store.sparkSession
    ship_package(spark)
    src = store.select(id_col, *(keep or []), vec_col)
    good = src.where(_comparable(vec_col))
    n = good.count()
    cells = max(1, min(MAX_CELLS, cells or round(np.sqrt(n)), max(n, 1)))
    if n:
        dim = good.select(F.size(vec_col).alias("d")).groupBy("d").count().orderBy(F.desc("count"), "d").first()["d"]
        good = good.where(F.size(vec_col) == dim)
        fit = _drawn(good, id_col, n, max(fit_rows, cells), seed)
        centres = _fit_cells(fit, vec_col, cells, rounds, seed)
    else:
        centres = np.zeros((1, 1))
    shared = spark.sparkContext.broadcast(centres)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)
    schema = ddl + ", cell int"
    placed = materialize(src.mapInArrow(_assign(shared, vec_col), schema))
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("__n"))
    files = sizes.select("cell", F.ceil(F.col("__n") / ROWS_PER_FILE).alias("__files"))  # at most MAX_CELLS + 1 rows
    dealt = placed.join(F.broadcast(files), "cell").withColumn("__file", F.pmod(F.xxhash64(id_col), F.col("__files")))
    (dealt.repartition("cell", "__file").drop("__file", "__files")
     .write.partitionBy("cell").parquet(os.path.join(path, "vectors")))
    table = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    index = VectorIndex(path, centres, len(centres), 1.0, id_col, vec_col, schema)
    if n:
        index.probes, index.recall = tune(index, good, n, recall, k, seed)
    spark.createDataFrame([(*r, index.probes, index.recall, id_col, vec_col, schema) for r in table],
                          "cell int, centre array<double>, probes int, recall double, id_col string, vec_col string, schema string") \
        .coalesce(1).write.parquet(os.path.join(path, "cells"))
    return index


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.parquet(os.path.join(path, "cells")).orderBy("cell").collect()  # at most MAX_CELLS rows
    r = rows[0]
    return VectorIndex(path, np.array([x["centre"] for x in rows]), r["probes"], r["recall"], r["id_col"], r["vec_col"],
                       r["schema"])


def tune(index: VectorIndex, good: DataFrame, n: int, wanted: float, k: int, seed: int, rows: int = TUNE_ROWS) -> tuple[int, float]:
    """(cells to read, recall at k): the fewest cells that hold the wanted share of the exact
    neighbours of about ``rows`` indexed rows."""
    spark = good.sparkSession
    drawn = materialize(_drawn(good, index.id_col, n, rows, seed + 1).select(
        F.col(index.id_col).alias("__q"), index.vec_col).dropDuplicates(["__q"]))
    hits = retrieve_dense(drawn, good, k, "__q", index.id_col, index.vec_col).select("__q", F.col(index.id_col).alias("__hit"))
    at = index.rows(spark).select(F.col(index.id_col).alias("__hit"), "cell")
    found = hits.join(at, "__hit").where(F.col("cell") != NO_CELL).groupBy("__q").agg(F.collect_list("cell").alias("cells"))
    places = []
    for r in found.join(drawn, "__q").collect():  # a bounded sample of queries, k hits each
        if len(r[index.vec_col]) == index.centres.shape[1]:
            order = np.argsort(-(index.centres @ np.array(r[index.vec_col], dtype="float64")), kind="stable")
            place = np.empty(len(order), int)
            place[order] = np.arange(len(order))
            places += place[r["cells"]].tolist()
    if not places:
        return len(index.centres), 1.0
    seen = np.cumsum(np.bincount(places, minlength=len(index.centres))) / len(places)
    probes = int(np.argmax(seen >= wanted)) + 1
    return probes, float(seen[probes - 1])


def _search_cells(shared, k: int, id_col: str, vec_col: str):
    """The tasks' best rows: each row meets the queries that read its cell."""
    def run(it):
        block = shared.value
        best = TopK(len(block["ids"]), k)
        for pdf in it:
            cell = pdf["cell"].to_numpy()
            order = np.argsort(cell, kind="stable")
            cut = np.flatnonzero(np.diff(cell[order], prepend=-2))
            for s, e in zip(cut, [*cut[1:], len(order)]):
                asked = block["by_cell"].get(int(cell[order[s]]))
                step = rows_at_once(0 if asked is None else len(asked))
                for f in range(s, e if asked is not None else s, step):
                    part = pdf.iloc[order[f:min(e, f + step)]]
                    m = unit_rows(np.stack(part[vec_col].to_numpy()).astype("float64"))
                    best.add(asked, block["unit"][asked] @ m.T, ids_of(part[id_col]))
        out = best.frame(block["ids"], id_col)
        if out is not None:
            yield out
    return run


def search_index(index: VectorIndex, queries: DataFrame, k: int = TOP_K, probes: int | None = None,
                 query_id: str = "query_id", vec_col: str | None = None) -> DataFrame:
    """Top-k of every query among the rows of its ``probes`` nearest cells: (query, rank, id, score).

    With as many probes as cells the answer is exact.  Queries without a comparable vector
    of the index's length have no hits.  Queries travel in bounded blocks.
    """
    spark = queries.sparkSession
    ship_package(spark)
    vec_col = vec_col or index.vec_col
    probes = min(probes or index.probes, len(index.centres))
    rows = index.rows(spark)
    q_type, id_type = (df.schema[c].dataType.simpleString() for df, c in ((queries, query_id), (rows, index.id_col)))
    asked = queries.where(_comparable(vec_col) & (F.size(vec_col) == index.centres.shape[1])).select(query_id, vec_col)
    parts = []
    blocks, n_blocks = query_blocks(asked, query_id, None, MAX_QUERY_BLOCK)
    tagged = asked.join(blocks, query_id)
    for b in range(n_blocks):
        block = tagged.where(F.col("__block") == b).orderBy(query_id).collect()  # one bounded block
        if not block:
            continue
        unit = unit_rows(np.array([r[vec_col] for r in block], dtype="float64"))
        near = np.argsort(-(unit @ index.centres.T), axis=1, kind="stable")[:, :probes]
        of, cell = np.repeat(np.arange(len(block)), probes), near.ravel()
        order = np.argsort(cell, kind="stable")
        cut = np.flatnonzero(np.diff(cell[order], prepend=-1))
        by_cell = {int(cell[order[s]]): of[order[s:e]] for s, e in zip(cut, [*cut[1:], len(order)])}
        shared = spark.sparkContext.broadcast({"ids": [r[query_id] for r in block], "unit": unit, "by_cell": by_cell})
        read = rows.where(F.col("cell").isin(sorted(by_cell))).select(index.id_col, index.vec_col, "cell")
        parts.append(read.mapInPandas(_search_cells(shared, k, index.id_col, index.vec_col),
                                      f"query_id {q_type}, `{index.id_col}` {id_type}, similarity double"))
    if not parts:
        return spark.createDataFrame([], f"`{query_id}` {q_type}, rank bigint, `{index.id_col}` {id_type}, score double")
    return ranked_hits(parts, k, query_id, index.id_col)


def recall_report(found: DataFrame, exact: DataFrame, query_id: str, id_col: str) -> DataFrame:
    """One row: queries, neighbours (exact hits), found (of them in ``found``), recall."""
    hit = found.select(query_id, id_col, F.lit(1).alias("__hit")).dropDuplicates([query_id, id_col])
    both = exact.select(query_id, id_col).join(hit, [query_id, id_col], "left")
    return both.agg(F.count_distinct(query_id).alias("queries"), F.count(F.lit(1)).alias("neighbours"),
                    F.count("__hit").alias("found")).withColumn("recall", F.try_divide("found", "neighbours"))
