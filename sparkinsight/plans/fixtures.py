"""Table loading and the deterministic derived inputs used by the query registry.

The driver tables are clean (no NULLs, no repeated rows), so cleaning operators
run on ``dirty_orders``: the whole ``orders`` table with NULLs, a scaled-up price
outlier, a constant column, numeric and date text columns and a sparse column
injected by fixed rules on the key, plus a second copy of every urgent finished
order (repeated rows).  The same
derivation is written once in Spark and once in SQL (``DIRTY_ORDERS_SQL``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    b = o.select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.when(k % 11 == 0, F.lit(None).cast("double"))
         .when(k % 101 == 0, F.col("o_totalprice") * 20)
         .otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when(k % 13 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        F.lit("x").alias("const_col"),
        (k % 50).cast("string").alias("o_size_txt"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_date_txt"),
        F.when(k % 4 == 0, F.col("o_custkey").cast("double")).alias("o_rare"),
    )
    # repeated rows: every urgent, finished order appears twice
    return b.unionByName(b.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")))


DIRTY_ORDERS_SQL = """
dirty_base AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN o_totalprice * 20
         ELSE o_totalprice END AS o_totalprice,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
    'x' AS const_col,
    CAST(o_orderkey % 50 AS VARCHAR) AS o_size_txt,
    strftime(o_orderdate, '%Y-%m-%d') AS o_date_txt,
    CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey AS DOUBLE) END AS o_rare
  FROM orders),
dirty_orders AS (SELECT * FROM dirty_base UNION ALL
  SELECT * FROM dirty_base WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')
""".strip()


def events_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` numeric columns plus ``v2``, a near-copy of ``value`` (for collinearity)."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "value",
                    (F.col("value") * 2 + F.col("user_id") / 100).alias("v2"))


EVENTS_V2_SQL = "events_v2 AS (SELECT event_id, user_id, value, value * 2 + user_id / 100 AS v2 FROM events)"
