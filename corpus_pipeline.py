"""The corpus pipeline: stages that each apply one text operator to what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchframe.llm.base import prepare, read, scratch_dir
from matchframe.llm.bpe_codec import encode_documents
from matchframe.llm.decontamination import drop_leaks
from matchframe.llm.secret_scan import mask_secrets
from matchframe.llm.simhash_gray import keep_one
from matchframe.llm.toxicity import drop_toxic
from matchframe.plans.session import scratch_scope

# No SQL: the tokenizer, toxicity model and edit distance have no SQL form.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model rejects."""
    prepare(spark)
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    prepare(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    prepare(spark)
    return drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    prepare(spark)
    return mask_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with their decoded text."""
    prepare(spark)
    return encode_documents(docs)


STAGES = [("toxicity", toxicity), ("simhash_near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secret_scan", secrets), ("bpe_codec", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in order; each result is written as Parquet and read again, and what a stage
    wrote on the way is removed after it."""
    docs, folder = read(spark, sf_dir, "documents"), scratch_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
