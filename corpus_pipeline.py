"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read by the next one."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailwarden.llm import jaccard_join, packing, quality_classifier, secret_scan, substring_dedup
from mailwarden.llm.common import ROW_GROUP, read, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model of trusted text does not reject."""
    return quality_classifier.keep_good(docs, read(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of every group of near copies: five-word shingles at Jaccard 0.8 or more."""
    return jaccard_join.keep_one(docs, size=5, least=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; one that is nothing but such passages goes."""
    columns = docs.columns
    cut = substring_dedup.substring_dedup(docs)
    return (cut.filter("n_removed = 0 or n_removed < n_words")
            .withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
            .select(*columns))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    clean = secret_scan.redact(docs.withColumn("_n", F.char_length("text").cast("long")))
    changed = F.char_length("text").cast("long") != F.col("_n")
    return clean.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1,024 tokens."""
    return packing.pack(docs)


STAGES = [("quality classifier", good_quality), ("n-gram Jaccard join", one_of_each), ("substring dedup", without_repeats),
          ("secret scans", without_secrets), ("packing", packed)]
#: Language model, components and tokens are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; returns the pieces of the last one."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, name.replace(" ", "_"), ROW_GROUP)
    return docs
