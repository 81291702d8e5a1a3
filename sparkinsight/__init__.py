"""sparkinsight: table and document analytics as lazy Spark DataFrame jobs.

Sub-packages
------------
sources    readers, writers and the Parquet catalog
functions  reusable Column expressions (statistics, text, hashing)
operators  validation, cleaning, EDA, KPIs, models, sequences, documents, routing
plans      fixtures, pipelines, reports and the query registry
streaming  incremental document ingestion with Structured Streaming
"""

__version__ = "0.1.0"
