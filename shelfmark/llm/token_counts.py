"""Token counts through a cache of digests.

A text is known by the digest of its normalised content, a tokenizer by the digest of its
file. Counts of digests the cache has are joined; each other digest is encoded once, however
many documents have it, and appended to the cache. Copies are grouped before they cross the
network, so one text with very many copies costs no more than one row per map task.

Cases: a null text is the empty text, with 0 tokens. Rows that repeat get the same count once
per row. Null identifiers are kept. An empty table gives an empty table. Other columns are
ignored. Two runs that append the same digest at once leave equal rows; reading takes one.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from shelfmark.llm.common import map_batches, slices_by_size, text_of

CACHE_SCHEMA = "digest binary, n_tokens long"
# Characters given to the tokenizer at a time; bounds what its encodings hold.
BATCH_CHARS = 500_000


@lru_cache(maxsize=4)
def tokenizer_version(path: str) -> str:
    """A digest of the tokenizer's file."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()[:32]


@lru_cache(maxsize=2)
def _counter(path: str):
    """A function from texts to token counts, loaded once per worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)]


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) that the cache holds for a tokenizer version; empty without a cache."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(f"{cache}/version={version}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text", *,
    limit: int = 1024, normalise=lambda text: text,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    ``tokenizer`` is the path of a .json or .model file, ``cache`` a folder all executors reach.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    text = text_of(normalise(text_of(text_col)))
    digest = F.unhex(F.sha2(text, 256))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"), digest.alias("digest")
    )
    contents = docs.select(digest.alias("digest"), text.alias("content"))

    cached = read_cache(spark, cache, version)
    misses = contents.join(cached.select("digest"), "digest", "left_anti") if cached.head(1) else contents
    # One text per digest; the first step of the aggregation runs where the texts are read.
    distinct = misses.groupBy("digest").agg(F.first("content").alias("content"))

    def make():
        count = _counter(tokenizer)

        def step(batch):
            texts, counts = batch.column("content").to_pylist(), []
            for start, end in slices_by_size(texts, BATCH_CHARS):
                counts += count(texts[start:end])
            return {"digest": batch.column("digest"), "n_tokens": counts}

        return step

    map_batches(distinct, CACHE_SCHEMA, make).write.mode("append").parquet(f"{cache}/version={version}")
    counted = narrow.join(read_cache(spark, cache, version), "digest")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
