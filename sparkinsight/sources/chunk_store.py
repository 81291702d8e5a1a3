"""A stored collection of rows by id (D3): hash buckets on disk and a version per merge.

A merge reads and rewrites only the buckets that its rows fall into, as new folders, and
then adds a version: a small table that says which folder holds each bucket.  Readers
follow the newest version, so a merge that fails, or is repeated by a retry, leaves
what they see as it was; older versions stay readable.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.documents import upsert_chunks

BUCKETS = 64
_VERSIONS = "version long, bucket int, folder string, rows long, buckets int"


class ChunkStore:
    """Rows of ``schema`` by unique ``id`` below ``path``; of clashing ids the later merge wins,
    within a merge the highest ``seq_col``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, seq_col: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.seq_col = spark, path, schema, seq_col
        held = self._versions().select("buckets").first()
        self.buckets = held["buckets"] if held else buckets

    def _versions(self) -> DataFrame:
        try:
            return self.spark.read.schema(_VERSIONS).parquet(os.path.join(self.path, "versions"))
        except AnalysisException:  # nothing merged yet
            return self.spark.createDataFrame([], _VERSIONS)

    def version(self) -> int:
        """The newest version; 0 before the first merge."""
        return self._versions().agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()["v"]

    def _folders(self, version: int | None = None) -> list:
        """(bucket, folder, rows) of a version: the newest entry of each bucket up to it."""
        v = self._versions()
        v = v if version is None else v.where(F.col("version") <= version)
        newest = v.groupBy("bucket").agg(F.max_by(F.struct("folder", "rows"), "version").alias("r"))
        return newest.select("bucket", "r.*").collect()  # at most one row per bucket

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest (or a given) version."""
        return self._rows([f["folder"] for f in self._folders(version)])

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[os.path.join(self.path, f) for f in folders])

    def count(self) -> int:
        return sum(f["rows"] for f in self._folders())

    def merge(self, new: DataFrame) -> int:
        """Merges rows into the store and returns the new version.

        Rows with a null id cannot be merged.  A merge without rows changes nothing.
        """
        fields = self.spark.createDataFrame([], self.schema).columns
        bucket = F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")
        rows = new.select(*fields).where(F.col("id").isNotNull())
        touched = [r["b"] for r in rows.select(bucket.alias("b")).distinct().collect()]  # at most one row per bucket
        version = self.version()
        if not touched:
            return version
        kept = self._rows([f["folder"] for f in self._folders() if f["bucket"] in set(touched)])
        # a later merge goes before an earlier one whatever the order column says
        seq = F.struct(F.col("__merge"), F.col(self.seq_col)).alias("__seq")
        both = kept.withColumn("__merge", F.lit(0)).unionByName(rows.withColumn("__merge", F.lit(1)))
        best = upsert_chunks(None, both.withColumn("__seq", seq).drop("__merge"), "__seq").select(*fields)
        run = f"data/v{version + 1}-{uuid.uuid4().hex[:8]}"
        (best.withColumn("bucket", bucket).repartition("bucket")
         .write.partitionBy("bucket").parquet(os.path.join(self.path, run)))
        written = self.spark.read.schema(self.schema + ", bucket int").parquet(os.path.join(self.path, run))
        entry = written.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(version + 1).cast("long").alias("version"), "bucket",
            F.concat(F.lit(f"{run}/bucket="), F.col("bucket").cast("string")).alias("folder"), "rows",
            F.lit(self.buckets).alias("buckets"))
        # the commit: one small file that names the new folders
        entry.coalesce(1).write.mode("append").parquet(os.path.join(self.path, "versions"))
        return version + 1
