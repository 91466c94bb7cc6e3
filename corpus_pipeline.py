"""A corpus from documents: quality rules, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and is
written as Parquet to the shared folder and read again before the next one starts. Stages
that hand texts to Python lower the session's number of rows a batch, and leave it so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.llm import exact_dedup, mixing, packing, prob_minhash, quality_rules
from gaugeworks.llm.common import table
from gaugeworks.session import materialize

# Whole texts that a Python worker holds at a time; a stage's result is written after it returned.
TEXTS_AT_ONCE = "500"


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS_AT_ONCE)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    _small_batches(spark)
    return quality_rules.keep_good(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate texts, the document with the smallest id stays."""
    return prob_minhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the sources' target weights; repeated ones are rows of their own."""
    return mixing.mixed(docs, mixing.plan_mix(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    _small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", pack)]

# The learned list, the classes and the draws are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
