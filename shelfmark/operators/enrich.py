"""Summaries, vectors and verdicts from pluggable batch providers.

A provider is any object with ``column(text) -> Column`` or, if it looks at more than a row,
``table(df, text, out) -> DataFrame``. The defaults are built from Spark expressions, need no model
and always give the same result. :class:`BatchModel` wraps a user's own model, loaded once per
Python worker and called with batches of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import RegexTokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.text import first_words, lead_summary, summary_or_default
from shelfmark.operators.key_sentences import KeySentences
from shelfmark.runtime import materialise
from shelfmark.schema import VECTOR

# Fixed value: the longest summary, in words.
SUMMARY_WORDS = 250


class ColumnProvider(Protocol):
    def column(self, text: Column) -> Column: ...


class TableProvider(Protocol):
    def table(self, df: DataFrame, text: str, out: str) -> DataFrame: ...


Provider = ColumnProvider | TableProvider


@dataclass(frozen=True)
class LeadSummary:
    """The opening phrase and the first ``n`` words of the text, for when its beginning is wanted."""

    opening: str
    n: int

    def column(self, text: Column) -> Column:
        return lead_summary(text, self.opening, self.n)


@dataclass(frozen=True)
class BatchModel:
    """A user model: ``load()`` gives a function from a list of texts to a list of results.

    Null texts are not sent to it. Its column is not deterministic, so Spark never computes it
    twice for one use nor moves a filter on it in front of it. If a batch raises, its texts are sent one by one; those
    that raise again are null, for a later provider or a default to fill in.
    """

    load: Callable[[], Callable[[list[str]], Sequence[Any]]]
    returns: T.DataType | str = T.StringType()
    raise_errors: bool = False

    def column(self, text: Column) -> Column:
        load, raise_errors = self.load, self.raise_errors

        def ask(model, texts: list[str]) -> list:
            try:
                return list(model(texts))
            except Exception:
                if raise_errors:
                    raise
                if len(texts) == 1:
                    return [None]
                return [answer for text in texts for answer in ask(model, [text])]

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                wanted = texts.notna().to_numpy().nonzero()[0]
                results = pd.Series([None] * len(texts), dtype=object)
                if len(wanted):
                    for place, answer in zip(wanted, ask(model, texts.iloc[wanted].tolist())):
                        results.iat[place] = answer
                yield results

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, self.returns).asNondeterministic()(text)


def _answered(df: DataFrame, provider: Provider, text: str, out: str) -> DataFrame:
    if hasattr(provider, "table"):
        return provider.table(df, text, out)
    return df.withColumn(out, provider.column(F.col(text)))


def fallback(
    df: DataFrame, text: str, providers: Sequence[Provider], out: str, message: str | None = None
) -> DataFrame:
    """Ask each provider in turn, only for rows that still have no result; then ``message``.

    One pass over ``df`` with column providers: each gets null, and skips it, where an earlier one
    answered. A table provider reads its input twice, so what earlier ones answered is stored first.
    """
    df = _answered(df, providers[0], text, out)
    for provider in providers[1:]:
        df = df.withColumn("_open", F.when(F.col(out).isNull(), F.col(text)))
        if hasattr(provider, "table"):
            df = materialise(df, "answered")
        df = _answered(df, provider, "_open", "_next")
        df = df.withColumn(out, F.coalesce(out, "_next")).drop("_open", "_next")
    if message is not None:
        df = df.withColumn(out, summary_or_default(F.col(out), message))
    return df


def summarise(
    df: DataFrame,
    text: str,
    providers: Sequence[Provider] = (KeySentences(),),
    out: str = "summary",
    message: str | None = None,
    max_words: int = SUMMARY_WORDS,
) -> DataFrame:
    """Add a summary of at most ``max_words`` words."""
    df = fallback(df, text, providers, out, message)
    over = F.size(F.split(out, "[ \\t\\n\\r\\f]+", max_words + 2)) > max_words
    return df.withColumn(out, F.when(over, first_words(F.col(out), max_words)).otherwise(F.col(out)))


def hashed_vectors(df: DataFrame, text: str, out: str = "vector", dimensions: int = 256) -> DataFrame:
    """The default embedding: word counts, hashed by the first digits of each word's MD5, scaled
    to unit length. No shuffle; a word is hashed once a batch."""

    def run(words: pa.Array) -> pa.Array:
        import hashlib

        import numpy as np
        import pyarrow as pa

        found = words.flatten().dictionary_encode()
        # Digests in one piece; the first four bytes of each are the number of its word.
        digests = b"".join(hashlib.md5(w).digest() for w in found.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False))
        hashed = (np.frombuffer(digests, ">u4")[::4] % dimensions).astype(np.int64)
        places = hashed[found.indices.to_numpy(zero_copy_only=False)]
        ends = words.offsets.to_numpy() - words.offsets[0].as_py()
        vectors = np.empty((len(words), dimensions), np.float32)
        for start in range(0, len(words), 1024):
            upto = ends[start : start + 1025]
            rows = np.repeat(np.arange(len(upto) - 1), np.diff(upto))
            size = (len(upto) - 1) * dimensions
            counts = np.bincount(rows * dimensions + places[upto[0] : upto[-1]], minlength=size).reshape(-1, dimensions)
            norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            vectors[start : start + 1024] = counts / np.maximum(norms, 1)
        offsets = np.arange(0, vectors.size + 1, dimensions, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()))

    run.__annotations__ = {"words": pa.Array, "return": pa.Array}
    tokens = RegexTokenizer(inputCol="_text", outputCol="_words", pattern="[^\\p{L}\\p{N}]+")
    df = tokens.transform(df.withColumn("_text", F.coalesce(F.col(text), F.lit(""))))
    counted = F.arrow_udf(run, T.ArrayType(T.FloatType(), False))
    return df.withColumn(out, counted("_words")).drop("_text", "_words")


def embed(
    df: DataFrame, text: str, provider: Provider | None = None, out: str = "vector"
) -> DataFrame:
    """Add a vector for the text of each row.

    With a provider, ``df`` is stored once: its texts may come from another model, which must
    not be asked again. Each distinct text is sent to the provider once and the vector, stored
    too, is joined back on the digest of the text. Copies are folded before the shuffle, and
    the join's side of vectors has one row per digest, so a text that a third of the rows share
    only makes one large probe partition, which adaptive execution splits.
    """
    if provider is None:
        return hashed_vectors(df, text, out)
    keyed = materialise(df.withColumn("_digest", F.sha2(F.col(text), 256)), "embedded")
    distinct = keyed.where(F.col(text).isNotNull()).groupBy("_digest").agg(
        F.first(text).alias("_text")
    )
    vectors = materialise(
        distinct.select(F.col("_digest"), provider.column(F.col("_text")).cast(VECTOR).alias(out)), "vectors"
    )
    return keyed.join(vectors, "_digest", "left").drop("_digest")


def classify_segments(
    segments: DataFrame, provider: Provider, column: str = "segment", out: str = "meaningful"
) -> DataFrame:
    """Add the provider's verdict on each segment; a failed call counts as meaningful."""
    return segments.withColumn(
        out, F.coalesce(provider.column(F.col(column)).cast("boolean"), F.lit(True))
    )
