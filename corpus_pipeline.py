"""The corpus pipeline: five stages over ``documents``, each stored as Parquet for the next.

Rows in any state are handled: null and empty texts score as silence, count as equal and of
size 0; null sources are a source; repeated rows are reduced to one by the exact dedup. Columns
beyond those of ``documents`` pass through the first four stages whatever their names. An empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bpe_codec, exact_dedup, jaccard_join, mixing, toxicity
from shelfmark.runtime import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from ``labels``."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest identifier."""
    return exact_dedup.drop_duplicates(docs, keep="largest")


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingles of five words link at a similarity of 0.8."""
    return jaccard_join.keep_one(docs, k=5, percent=80)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mixture takes them; one that it takes twice is there twice."""
    return mixing.take_mixture(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens of each document, and whether the ids decode to its text."""
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    digested = docs.select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "text")
    # Stored, so that a task has one Python worker and not two: idle workers keep their memory.
    tokens = materialise(bpe_codec.encode(digested, ranks, pattern, keep_text=False), "ids")
    return bpe_codec.decode(tokens, ranks, pattern).select(
        "doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
        (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_deduplication),
    ("near_dedup", near_deduplication),
    ("mixing", source_mixture),
    ("byte_bpe", byte_bpe),
]

# The classifier is trained, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
