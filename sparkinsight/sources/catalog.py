"""Parquet metadata catalog (S10-S17): datasets, query history, model runs, reports.

Each table is a Parquet folder; writes are appends (new files), so concurrent
readers never see a half-written table.  Bulk appends take dense ids in a given
order without a global sort into one task: rows are range-sorted, each
partition counts its rows, and the ids are partition offsets plus positions.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

# Catalog table schemas.
SCHEMAS = {
    "datasets": "id bigint, name string, file_type string, rows bigint, columns bigint, file_path string, "
                "hash string, created_at timestamp",
    "query_history": "id bigint, session_id string, dataset_id bigint, question string, answer string, "
                     "agent string, created_at timestamp",
    "model_runs": "id bigint, dataset_id bigint, model_type string, task string, target_column string, "
                  "metrics string, params string, created_at timestamp",
    "reports": "id bigint, dataset_id bigint, report_type string, file_path string, created_at timestamp",
}
HISTORY_LIMIT = 20


def with_dense_ids(df: DataFrame, order_cols: list[str], start: int, out: str = "id") -> DataFrame:
    """Consecutive ids ``start, start+1, ...`` in ``order_cols`` order."""
    ordered = materialize(df.orderBy(*order_cols).withColumn("__pid", F.spark_partition_id())
                          .withColumn("__mono", F.monotonically_increasing_id()))
    counts = ordered.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: bounded, broadcast
    offs = counts.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0))).select("__pid", "__off")
    local = F.col("__mono") - F.shiftleft(F.col("__pid").cast("bigint"), 33)
    return (ordered.join(F.broadcast(offs), "__pid")
            .withColumn(out, (F.lit(start) + F.col("__off") + local).cast("bigint"))
            .drop("__pid", "__mono", "__off"))


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def bootstrap(self) -> None:
        """Create the four tables when absent (idempotent)."""
        for name, ddl in SCHEMAS.items():
            if not self._exists(name):
                self.spark.createDataFrame([], ddl).write.mode("append").parquet(self.path(name))

    def _exists(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(self.path(name))
        return p.getFileSystem(conf).exists(p)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(self.path(name))

    def _next_id(self, name: str) -> int:
        m = self.table(name).agg(F.max("id").alias("m")).first()["m"]
        return (m or 0) + 1

    def _append(self, name: str, df: DataFrame) -> None:
        cols = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        df.select(*cols).write.mode("append").parquet(self.path(name))

    # -- datasets
    def register_dataset(self, name, file_type, rows, columns, file_path, hash_) -> int:
        i = self._next_id("datasets")
        row = self.spark.createDataFrame([(i, name, file_type, rows, columns, file_path, hash_)],
                                         "id bigint, name string, file_type string, rows bigint, columns bigint, "
                                         "file_path string, hash string")
        self._append("datasets", row.withColumn("created_at", F.current_timestamp()))
        return i

    def register_datasets(self, entries: list[tuple]) -> list[int]:
        """Append several (name, file_type, rows, columns, file_path, hash) entries in one write."""
        start = self._next_id("datasets")
        rows = [(start + i, *e) for i, e in enumerate(entries)]
        df = self.spark.createDataFrame(rows, "id bigint, name string, file_type string, rows bigint, "
                                              "columns bigint, file_path string, hash string")
        self._append("datasets", df.withColumn("created_at", F.current_timestamp()))
        return [r[0] for r in rows]

    def list_datasets(self) -> DataFrame:
        return self.table("datasets").orderBy(F.desc("id")).select(
            "id", "name", "file_type", "rows", "columns", "created_at")

    # -- history
    def save_queries(self, qa: DataFrame, order_cols: list[str]) -> None:
        """Append (session_id, dataset_id, question, answer, agent) rows with dense ids."""
        ids = with_dense_ids(qa, order_cols, self._next_id("query_history"))
        self._append("query_history", ids.withColumn("created_at", F.current_timestamp()))

    def get_history(self, session_id: str | None = None, limit: int = HISTORY_LIMIT) -> DataFrame:
        """Newest ``limit`` entries of one session, or of every session (per-session top-k)."""
        h = self.table("query_history")
        if session_id is not None:
            return h.where(F.col("session_id") == session_id).orderBy(F.desc("id")).limit(limit)
        w = Window.partitionBy("session_id").orderBy(F.desc("id"))
        return h.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= limit).drop("__rn")

    # -- model runs
    def save_model_run(self, dataset_id, model_type, task, target_column, metrics: dict, params: dict) -> int:
        i = self._next_id("model_runs")
        row = self.spark.createDataFrame(
            [(i, dataset_id, model_type, task, target_column, json.dumps(metrics), json.dumps(params))],
            "id bigint, dataset_id bigint, model_type string, task string, target_column string, "
            "metrics string, params string")
        self._append("model_runs", row.withColumn("created_at", F.current_timestamp()))
        return i

    def save_model_runs(self, runs: DataFrame) -> None:
        """Bulk append of (dataset_id, model_type, task, target_column, metrics map, params map)."""
        runs = runs.withColumn("metrics", F.to_json("metrics")).withColumn("params", F.to_json("params"))
        ids = with_dense_ids(runs, ["model_type"], self._next_id("model_runs"))
        self._append("model_runs", ids.withColumn("created_at", F.current_timestamp()))

    def list_model_runs(self, dataset_id: int | None = None) -> DataFrame:
        """Runs newest first with decoded metrics/params (NULL -> empty map)."""
        r = self.table("model_runs")
        if dataset_id is not None:
            r = r.where(F.col("dataset_id") == dataset_id)
        return r.orderBy(F.desc("id")).select(
            "id", "dataset_id", "model_type", "task", "target_column",
            F.from_json(F.coalesce("metrics", F.lit("{}")), "map<string,double>").alias("metrics"),
            F.from_json(F.coalesce("params", F.lit("{}")), "map<string,string>").alias("params"), "created_at")

    # -- reports
    def record_report(self, dataset_id, file_path: str, report_type: str = "full") -> int:
        i = self._next_id("reports")
        row = self.spark.createDataFrame([(i, dataset_id, report_type, file_path)],
                                         "id bigint, dataset_id bigint, report_type string, file_path string")
        self._append("reports", row.withColumn("created_at", F.current_timestamp()))
        return i
