"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

# Fixed value: a word is a run of characters other than space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; makes the package importable in Python workers."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(df: DataFrame) -> int:
    """The session's number of shuffle partitions (sized with the data by its owner)."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fold(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds


def bytes_of(col: str = "text") -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def other_columns_aside(stage):
    """For stages that return the columns of their documents: columns the stage does not read
    go through it under names of their own, so none can clash with a helper column."""
    @wraps(stage)
    def run(docs: DataFrame, *args, **kw) -> DataFrame:
        read = ("doc_id", "text", "source")
        plain = docs.toDF(*[c if c in read else f"own_{i}" for i, c in enumerate(docs.columns)])
        return stage(plain, *args, **kw).toDF(*docs.columns)
    return run


_STORES: dict = {}


def worker_store(key, build):
    """An object that this Python worker keeps between tasks.  A worker keeps one at a time, so
    those of operators that ran before do not add up."""
    if key not in _STORES:
        drop_stores()
        _STORES[key] = build()
    return _STORES[key]


def drop_stores() -> None:
    """For tasks that keep nothing but need the memory; freed buffers go back to the system as well."""
    _STORES.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed memory otherwise
    if trim:
        trim(0)
