"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Quality comes first, then near-duplicates, repeated passages and benchmark
passages go, and what is left is encoded.  Every stage but the last returns the
columns of its input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewise.llm import bpe, decontam, minhash, quality, suffix_dups
from scorewise.llm.common import add_uid, free_name, staged, table
from scorewise.session import ship_package


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    ship_package(spark)
    return quality.quality_stage(spark, docs, sf_dir)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (five words, 0.8)."""
    ship_package(spark)
    key = free_name("_uid", docs.columns)
    keyed = add_uid(docs, key)
    groups = minhash.near_duplicates(docs, words=5, percent=80)
    gone = groups.filter("uid <> component").select(F.col("uid").alias(key)).distinct()
    left = keyed.join(gone.hint("merge"), key, "left_anti")
    odd = docs.groupBy("doc_id").count().filter("count > 1")
    if not odd.isEmpty():  # equal rows are one document
        left = left.dropDuplicates([key])
    return left.drop(key)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that also start earlier."""
    ship_package(spark)
    return suffix_dups.cut_texts(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    key = free_name("_uid", docs.columns)
    keyed = add_uid(docs, key)
    found = decontam.matches(keyed, table(spark, sf_dir, "benchmark"), id_col=key)
    gone = found.select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(gone.hint("merge"), key, "left_anti").drop(key)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids, encoded and decoded, as digests."""
    ship_package(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_each_group),
    ("suffix-array dedup", no_repeats),
    ("benchmark decontamination", no_benchmark),
    ("byte-level BPE", encoded),
]
#: The classifier and the signatures aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs
