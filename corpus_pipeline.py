"""From raw documents to packed sequences: quality, toxicity, near duplicates, benchmark passages, packing.

Every stage decides row by row, so null and repeated ids are documents like any other; null texts count as empty. An
empty table passes through all stages; columns beyond those of documents are kept by all but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import crf_quality, decontaminate, jaccard_join, packing, toxicity
from lexmill.llm.common import ensure_checkpoint_dir, small, table

#: Near duplicates: words of a shingle and least similarity in percent.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier doesn't reject; it learns from the labelled documents outside the held-out fold."""
    return crf_quality.keep_good(docs, crf_quality.train(docs, table(spark, sf_dir, "labels")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of any toxic grade is below the operator's threshold."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id, null ids last, and of equal ids the first row.

    Every row is a document of its own, whatever its id. Texts without words are no duplicates.
    """
    at = f"{ensure_checkpoint_dir(spark)}/rows-{uuid.uuid4().hex}"
    docs.withColumn("__row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(at)  # numbered once, so that all scans agree
    keyed = spark.read.parquet(at)
    groups = jaccard_join.jaccard_components(keyed, NEAR_WORDS, NEAR_PERCENT, id_col="__row")
    several = groups.join(keyed.select(F.col("__row").alias("__r"), "doc_id"), F.col("__row") == F.col("__r"))
    first = several.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("f"), F.count("*").alias("n"))
    first = first.where("n > 1").select(F.col("component_id").alias("__c"), F.col("f.__row").alias("__first"))
    gone, _ = small(groups.join(first, F.col("component_id") == F.col("__c")).where("__row <> __first").select(F.col("__row").alias("__gone")))
    return keyed.join(gone, F.col("__row") == F.col("__gone"), "left_anti").drop("__row")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Fitted models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs, at = table(spark, sf_dir, "documents"), f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
