"""Training-data pipeline over ``documents``: five stages, each written and read again.

toxicity (rejected documents go) -> exact dedup -> n-gram Jaccard join (one document of
each group stays) -> mixing to source weights (documents are repeated or left out) ->
packing into token sequences.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkinsight.llm.common import read_table
from sparkinsight.llm.exact_dedup import exact_dedup
from sparkinsight.llm.mixing import mix
from sparkinsight.llm.ngram_join import keep_first
from sparkinsight.llm.packing import pack
from sparkinsight.llm.queries import tokenizer_path
from sparkinsight.llm.toxicity import drop_toxic
from sparkinsight.session import materialize, ship_package


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the workers share their executor with what the stages before left behind: a smaller store
    return pack(docs, tokenizer_path(), kept=200_000)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_copies), ("ngram_join", near_copies),
          ("mixing", mixing), ("packing", packing)]

# a trained network, a verified similarity join, a random draw and a tokenizer: not SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
