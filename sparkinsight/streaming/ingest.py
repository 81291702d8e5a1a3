"""Incremental document ingestion with Structured Streaming.

New documents arriving as Parquet files are chunked (a stateless projection)
and appended to a chunk log together with the micro-batch id; the chunk store
is the log's last write per chunk id (``store_view``).  Appends are idempotent
per batch (Spark's file sink commit log), and the checkpoint folder lets a
restarted query resume where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as D

DOCUMENT_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def start_chunk_stream(spark: SparkSession, source_dir: str, log_dir: str, checkpoint_dir: str,
                       available_now: bool = True, max_files: int | None = None):
    """Start the streaming query: documents -> chunks -> append-only chunk log."""
    reader = spark.readStream.schema(DOCUMENT_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    docs = reader.parquet(source_dir)
    chunks = D.chunk_ids(D.chunk_text(docs.select("doc_id", "source", "text")))
    chunks = chunks.select("id", "doc_id", "source", "chunk", "text",
                           F.current_timestamp().alias("ingested_at"))
    w = chunks.writeStream.format("parquet").option("path", log_dir) \
        .option("checkpointLocation", checkpoint_dir).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def store_view(spark: SparkSession, log_dir: str) -> DataFrame:
    """The chunk store: per id, the most recently ingested write."""
    log = spark.read.parquet(log_dir)
    return D.upsert_chunks(None, log.select("id", "doc_id", "source", "chunk", "text", "ingested_at"),
                           "ingested_at").drop("ingested_at")
