"""A corpus pipeline: quality, near duplicates, benchmark leaks, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; all but
the last return the columns of documents.  Between stages rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from featherfold.llm.common import materialize, ship, table
from featherfold.llm.op1_decontaminate import drop_leaks
from featherfold.llm.op5_quality import keep_good, train
from featherfold.llm.op7_sharding import place
from featherfold.llm.op9_jaccard import keep_one
from featherfold.llm.op10_mixing import mixed


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    ship(spark)
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8 or more."""
    ship(spark)
    return keep_one(docs, n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as a mix of all words takes them, sources weighing 5, 2, 1 in turn."""
    return mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the number of their shard."""
    return place(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: The quality stage is a trained network, which SQL cannot express: the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
