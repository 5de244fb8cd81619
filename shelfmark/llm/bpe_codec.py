"""Byte-level BPE over whole texts, with long texts encoded in overlapping chunks.

Chunks of a long text are cut into pre-tokens in parallel. A pre-token border depends only on
what follows it, so once the borders of two neighbouring chunks meet inside their overlap they
agree from there on: the text is cut at that place and the pieces are encoded one by one. Where
an overlap has no common border the rest of that text from its last cut is one piece. Texts of
one chunk need no cut and never leave their task. Decoding concatenates raw bytes.

Cases: a null text is the empty text, with no ids. Rows that repeat get the same ids once per
row; pieces of equal long texts are encoded once. Null identifiers are kept. An empty table
gives an empty table. Other columns are passed through.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from shelfmark.llm.common import fresh, map_batches, shares, text_of

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024
# What a worker encodes or decodes at a time.
SHARE_BYTES = 1 << 20
SHARE_IDS = 1 << 18


@lru_cache(maxsize=2)
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file, loaded once per worker."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) }
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def _id_lists(lists: Iterator[list[int]]) -> pa.Array:
    import numpy as np

    # Ids as numbers of Python take eight times the room, so one text has them at a time.
    arrays = [np.array(x, np.int32) for x in lists]
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int32)))


def _kept(batch: pa.RecordBatch, names: list[str]) -> dict:
    return {n: batch.column(batch.schema.get_field_index(n)) for n in names}


def _encode_whole(
    docs: DataFrame, text: str, out: str, rank_file: str, pattern: str, kept: list[str]
) -> DataFrame:
    """The columns ``kept`` with the ids of each text, each text encoded in one piece."""
    schema = StructType([docs.schema[c] for c in kept]).add(out, ArrayType(IntegerType()))

    def make():
        codec = encoding(rank_file, pattern)

        def step(batch):
            # A share at a time, so that ids of many long texts are never held together.
            for part in shares(batch, text, SHARE_BYTES):
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                yield _kept(part, kept) | {out: _id_lists(codec.encode_ordinary(t or "") for t in texts)}

        return step

    return map_batches(docs, schema, make)


def _chunks(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(digest, k, start, part): chunks of ``chunk`` characters and ``overlap`` more."""

    def make():
        def step(batch):
            at_once = max(1, SHARE_BYTES // chunk)
            for digest, text in zip(*batch.columns):
                digest, text = digest.as_py(), text.as_py()
                n = -(-len(text) // chunk)
                for first in range(0, n, at_once):
                    ks = range(first, min(first + at_once, n))
                    yield {
                        "digest": [digest] * len(ks), "k": list(ks), "start": [k * chunk for k in ks],
                        "part": [text[k * chunk : (k + 1) * chunk + overlap] for k in ks],
                    }

        return step

    return map_batches(texts.select("digest", "content"), "digest string, k int, start int, part string", make)


def _borders(chunks: DataFrame, chunk: int, overlap: int, pattern: str) -> DataFrame:
    """Chunks with the pre-token borders in the overlaps at their head and their tail."""

    def make():
        split = _splitter(pattern)

        def step(batch):
            for share in shares(batch, "part", SHARE_BYTES):
                head, tail = [], []
                for start, part in zip(share.column("start").to_pylist(), share.column("part").to_pylist()):
                    ends = [m.end() for m in split.finditer(part)]
                    if len(part) == chunk + overlap:
                        # The last two may look different with more text to the right.
                        ends = ends[:-2]
                    head.append([start, *(start + e for e in ends if e < overlap)] if start else [])
                    tail.append([start + e for e in ends if e >= chunk])
                yield _kept(share, ["digest", "k", "start", "part"]) | {"head": head, "tail": tail}

        return step

    return map_batches(chunks, "digest string, k int, start int, part string, head array<int>, tail array<int>", make)


def _pieces(texts: DataFrame, chunk: int, overlap: int, pattern: str) -> DataFrame:
    """(digest, k, piece): the texts cut where neighbouring chunks agree, in order of k."""
    spread = _chunks(texts, chunk, overlap).dropDuplicates(["digest", "k"])
    marked = _borders(spread, chunk, overlap, pattern)
    order = W.partitionBy("digest").orderBy("k")
    meets = F.array_min(F.array_intersect(F.lag("tail").over(order), F.col("head")))
    cut = F.when(F.col("k") == 0, F.lit(0)).otherwise(meets)
    # From the first overlap without a common border on, a text is not cut any more.
    whole_so_far = F.max(F.col("cut").isNull().cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    cuts = marked.withColumn("cut", cut).withColumn("rest", whole_so_far == 1)
    following = F.lead(F.when(~F.col("rest"), F.col("cut"))).over(order)
    cuts = cuts.withColumn("until", following)
    inside = F.col("cut") - F.col("start")
    length = F.when(F.col("until").isNotNull(), F.col("until") - F.col("cut")).otherwise(F.length("part"))
    # A chunk of an uncut rest gives what it adds; such parts are put together again.
    ordinary = F.expr("substring(part, cut - start + 1, length)")
    last_cut = F.max(F.when(~F.col("rest"), F.col("k"))).over(order.rowsBetween(W.unboundedPreceding, 0))
    more_rest = F.coalesce(F.lead("rest").over(order), F.lit(False))
    body = (
        F.when(F.col("rest") & more_rest, F.substring("part", 1, chunk))
        .when(F.col("rest"), F.col("part"))
        .when(more_rest, F.expr(f"substring(part, cut - start + 1, {chunk} - (cut - start))"))
        .otherwise(ordinary)
    )
    parts = cuts.withColumn("length", length).select("digest", last_cut.alias("k"), F.col("k").alias("part_no"), body.alias("body"))
    rejoined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_no", "body"))), lambda p: p["body"]), "")
    return parts.groupBy("digest", "k").agg(rejoined.alias("piece"))


def encode(
    docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", *,
    keep_text: bool = True, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """``docs`` with a column ``ids`` array<int> (``_ids`` if there is one already), with or
    without the text.

    Needs ``chunk`` of at least twice ``overlap``, so that a chunk has found its true borders
    before its own overlap begins.
    """
    if chunk < 2 * overlap or overlap < 4:
        raise ValueError("chunk must be at least twice the overlap, and that at least 4")
    out, long_text, digest = fresh(docs, "ids", "long_text", "digest")
    kept = [c for c in docs.columns if keep_text or c != text_col]
    texts = docs.select(*docs.columns, text_of(text_col).alias(long_text))
    is_long = F.length(long_text) > chunk
    short = _encode_whole(docs.where(F.length(text_of(text_col)) <= chunk), text_col, out, rank_file, pattern, kept)

    long_docs = texts.where(is_long).withColumn(digest, F.sha2(long_text, 256))
    pieces = _pieces(long_docs.select(F.col(digest).alias("digest"), F.col(long_text).alias("content")), chunk, overlap, pattern)
    encoded = _encode_whole(pieces, "piece", "ids", rank_file, pattern, ["digest", "k"])
    ordered = F.array_sort(F.collect_list(F.struct("k", "ids")))
    whole = encoded.groupBy("digest").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))
    joined = long_docs.drop(long_text).join(
        whole.select(F.col("digest").alias(f"{digest}_r"), F.col("ids").alias(out)), F.col(digest) == F.col(f"{digest}_r")
    )
    return short.unionByName(joined.select(*kept, out))


def decode(tokens: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with a column ``decoded`` binary: the raw bytes of the ids, put together."""
    (out,), kept = fresh(tokens, "decoded"), tokens.columns
    schema = StructType([*tokens.schema.fields]).add(out, BinaryType())

    def make():
        codec = encoding(rank_file, pattern)

        def step(batch):
            for part in shares(batch, ids_col, SHARE_IDS):
                lists = part.column(part.schema.get_field_index(ids_col))
                decoded = [codec.decode_bytes(x.values.to_pylist() if x.is_valid else []) for x in lists]
                yield _kept(part, kept) | {out: pa.array(decoded, pa.binary())}

        return step

    return map_batches(tokens, schema, make)
