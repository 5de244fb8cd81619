"""Nearest-vector search over documents, segments and folders.

Every query vector has to be compared with every corpus vector, but no pair is ever a row:
a task multiplies its block of corpus vectors with a block of queries and keeps the k best
per query, so what leaves it is k rows per query. Up to ``MAX_QUERIES`` query vectors (and
``QUERY_BYTES``) are broadcast, compared in blocks inside a task, and the corpus is read once, in
place, without a shuffle. More queries go in batches of that size, one after the other. Up to
``MAX_BOUNDED`` go at once where a task keeps few hits of each, as it knows how near they have to be.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.functions.text import WORD_BUDGET, break_to_html, count_words, question_prompt
from shelfmark.operators.enrich import Provider
from shelfmark.operators.grouping import child_pages
from shelfmark.runtime import materialise, small

# Fixed value: hits per query where the caller names no number.
DEFAULT_K = 20
DIGITS = 6
# Query vectors that are broadcast at once: rows, and bytes.
MAX_QUERIES = 16_384
MAX_BOUNDED = 65_536
QUERY_BYTES = 64 << 20
# Corpus vectors that a task multiplies at once.
ROWS_AT_ONCE = 2_048
MERGE_SALT = 64

_HITS = "query_id long, id string, distance double"


def _kernel():
    """The block top-k, as plain functions that travel to the workers by value."""
    import numpy as np
    import pyarrow as pa

    def matrix(column: pa.Array | np.ndarray) -> np.ndarray:
        """Rows of a list column, or of a matrix, at unit length; a zero vector stays zero."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if not isinstance(column, np.ndarray):
            flat = column.flatten().to_numpy(zero_copy_only=False)
            column = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
        rows = column.astype(np.float64)
        norms = np.linalg.norm(rows, axis=1, keepdims=True)
        rows[~(norms[:, 0] > 0)] = 0
        return np.divide(rows, norms, out=rows, where=norms > 0)

    def best(distances: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """Places of the k smallest by (distance, id), ties at the border included."""
        if len(distances) > k:
            border = np.partition(distances, k - 1)[k - 1]
            places = np.flatnonzero(distances <= border)
        else:
            places = np.arange(len(distances))
        order = np.lexsort((ids[places].astype(str), distances[places]))
        return places[order[:k]]

    def keeper(n_queries: int, k: int, within: np.ndarray | None = None):
        """``keep(queries, distances, ids)`` holds the k best of each query so far; only distances up
        to a query's present k-th are looked at, and up to ``within`` from the start. ``rows_of(names)``
        gives them, 1,024 queries a batch."""
        no_ids, none = np.array([], dtype=object), np.array([], dtype=np.float64)
        kept_ids, kept = [no_ids] * n_queries, [none] * n_queries
        border = np.full(n_queries, np.inf) if within is None else within.copy()

        def keep(queries: np.ndarray, distances: np.ndarray, ids: np.ndarray) -> None:
            near = distances <= border[queries][:, None]
            for i in np.flatnonzero(near.any(axis=1)):
                q, places = queries[i], np.flatnonzero(near[i])
                all_ids = np.concatenate([kept_ids[q], ids[places]])
                all_d = np.concatenate([kept[q], distances[i, places]])
                again = best(all_d, all_ids, k)
                kept_ids[q], kept[q] = all_ids[again], all_d[again]
                if len(again) == k:
                    border[q] = min(border[q], kept[q][-1])

        def keep_near(queries: np.ndarray, asked: np.ndarray, rows: np.ndarray, asked32: np.ndarray, rows32: np.ndarray, ids: np.ndarray, digits: int) -> None:
            """``keep`` for unit ``rows``; ``asked`` may have any length. Products in single precision, whose error
            is bounded, tell which rows may be within a query's border; their distances are in double precision,
            as are all of a query that has no border yet."""
            new = np.isinf(border[queries])
            if new.any():
                keep(queries[new], np.round(1.0 - matrix(asked[new]) @ rows.T, digits), ids)
                queries, asked, asked32 = queries[~new], asked[~new], asked32[~new]
            slack = (rows.shape[1] + 4) * 2.0**-23 + 10.0**-digits
            near = asked32 @ rows32.T >= (1.0 - border[queries] - slack).astype(np.float32)[:, None]
            for i in np.flatnonzero(near.any(axis=1)):
                places = np.flatnonzero(near[i])
                keep(queries[i : i + 1], np.round(1.0 - matrix(asked[i : i + 1]) @ rows[places].T, digits), ids[places])

        def rows_of(names: list[int]) -> Iterator[pa.RecordBatch]:
            some = [q for q in range(len(names)) if len(kept[q])]
            for start in range(0, len(some), 1024):
                part = some[start : start + 1024]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[q] for q in part for _ in kept[q]], pa.int64()),
                        pa.array([i for q in part for i in kept_ids[q].tolist()], pa.string()),
                        pa.array(np.concatenate([kept[q] for q in part]) + 0.0, pa.float64()),
                    ],
                    names=["query_id", "id", "distance"],
                )

        return keep, keep_near, rows_of

    return matrix, best, keeper


def _vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.where(F.col(vector).isNotNull()).select(
        F.col(key), F.col(vector).cast("array<float>").alias("vector")
    )


def _borders(names: list[int], within: DataFrame | None, k: int, digits: int) -> np.ndarray | None:
    """For each of a batch of queries the distance of its k-th known hit, and what rounding may add; a query
    with fewer hits has no border."""
    if within is None:
        return None
    asked = within.sparkSession.createDataFrame(pa.table({"query_id": pa.array(names, pa.int64())})).distinct()
    known = within.where(F.col("rank") == k).join(F.broadcast(asked), "query_id", "left_semi").select("query_id", "distance").toArrow()
    border = dict(zip(known.column(0).to_pylist(), known.column(1).to_pylist()))
    return np.array([border.get(name, np.inf) for name in names]) + 10.0**-digits


def _broadcast_scores(queries: pa.Table, corpus: DataFrame, k: int, digits: int, within: DataFrame | None = None) -> DataFrame:
    """(query_id, id, distance): the k best of each corpus partition."""
    matrix, _, keeper = _kernel()
    names, n = queries.column("query_id").to_pylist(), queries.num_rows
    vectors = queries.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    border = _borders(names, within, k, digits)
    shared = corpus.sparkSession.sparkContext.broadcast((names, vectors, border))
    at_once = ROWS_AT_ONCE

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        names, raw, border = shared.value
        starts = range(0, len(names), 256)
        unit32 = np.concatenate([matrix(raw[i : i + 256]).astype(np.float32) for i in starts])
        _, keep_near, rows_of = keeper(len(names), k, border)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(ids), at_once):
                rows = matrix(batch.column(1).slice(at, at_once))
                rows32 = rows.astype(np.float32)
                for i in starts:
                    part = np.arange(i, min(i + 256, len(names)))
                    keep_near(part, raw[i : i + 256], rows, unit32[i : i + 256], rows32, ids[at : at + at_once], digits)
        yield from rows_of(names)

    return corpus.mapInArrow(scan, _HITS)


def _in_batches(queries: DataFrame, max_queries: int, k: int, ask) -> DataFrame:
    """Hits of more queries than are broadcast: ``ask`` for each batch, stored before the next.

    Batches are dealt by hash, half full on average; one that is too full is dealt again. Rows that
    repeat count once, and rows of one ``query_id`` may go to several batches,
    hence the last ranking.
    """
    queries = materialise(queries.distinct(), "queries")
    parts = -(-2 * queries.count() // max_queries)
    batch = F.pmod(F.xxhash64("query_id", "vector", F.lit(parts)), F.lit(parts))
    dealt = materialise(queries.withColumn("_batch", batch), "queries")
    found = [materialise(ask(dealt.where(F.col("_batch") == i).drop("_batch")), "hits") for i in range(parts)]
    return top_k(reduce(DataFrame.unionByName, found).drop("rank"), k)


def top_k(scored: DataFrame, k: int, salt: int = MERGE_SALT) -> DataFrame:
    """(query_id, id, distance, rank) of the k nearest by (distance, id) of each query.

    First within slices of a query's rows, then among the best of the slices, so that one
    query over a very large corpus is not merged by one task.
    """
    order = [F.col("distance"), F.col("id")]
    slices = W.partitionBy("query_id", "_slice").orderBy(*order)
    whole = W.partitionBy("query_id").orderBy(*order)
    return (
        scored.withColumn("_slice", F.pmod(F.xxhash64("id"), F.lit(salt)))
        .withColumn("_place", F.row_number().over(slices))
        .where(F.col("_place") <= k)
        .withColumn("rank", F.row_number().over(whole))
        .where(F.col("rank") <= k)
        .select("query_id", "id", "distance", "rank")
    )


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = DEFAULT_K,
    exact: bool = True,
    digits: int = DIGITS,
    max_queries: int | None = None,
    cells: str | None = None,
    probes: int | None = None,
    within: DataFrame | None = None,
    **lsh,
) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest corpus vectors of each query.

    ``queries`` is (query_id, vector), ``corpus`` (id, vector). Distance is cosine distance,
    rounded to ``digits`` so that the order does not hang on the last bits of a sum. With
    ``exact=False`` only vectors that share a hash bucket with the query are compared; see
    :func:`shelfmark.operators.ann.nearest_in_buckets` for the options. With ``cells`` the hits come
    from the ``probes`` nearest cells of the vectors that
    :func:`shelfmark.operators.cells.write_cells` has stored there from this corpus.

    ``within`` are hits that an approximate search has found for these queries in this corpus, with the same
    ``k`` and ``digits``. The exact search still compares all vectors, but keeps none beyond a query's k-th known hit.

    Up to ``max_queries`` queries, and ``QUERY_BYTES``, pass the corpus at once; by default ``MAX_QUERIES``,
    or ``MAX_BOUNDED`` with ``cells`` or ``within``.
    """
    queries = _vectors(queries, "query_id", "vector").withColumn("query_id", F.col("query_id").cast("long"))
    corpus = _vectors(corpus, "id", "vector").withColumn("id", F.col("id").cast("string"))
    size = queries.select(F.size("vector")).first()
    if size is None:
        return queries.sparkSession.createDataFrame([], f"{_HITS}, rank int")
    max_queries = max_queries or (MAX_QUERIES if cells is None and within is None else MAX_BOUNDED)
    max_queries = max(1, min(max_queries, QUERY_BYTES // (4 * max(size[0], 1))))
    if cells is not None:
        from shelfmark.operators.cells import PROBES, nearest_in_cells

        return nearest_in_cells(queries, cells, k, probes or PROBES, digits, max_queries)
    few = queries.limit(max_queries + 1).toArrow()
    if few.num_rows > max_queries:
        again = lambda part: nearest(part, corpus, k, exact, digits, max_queries, within=within, **lsh)
        return _in_batches(queries, max_queries, k, again)
    if not exact:
        from shelfmark.operators.ann import nearest_in_buckets

        return nearest_in_buckets([(r["query_id"], r["vector"]) for r in few.to_pylist()], corpus, k, digits, **lsh)
    return top_k(_broadcast_scores(few, corpus, k, digits, within), k)


# --- the three collections -------------------------------------------------------------


def _stored_hits(queries: DataFrame, corpus: DataFrame, k: int, how: dict) -> DataFrame:
    """The hits as a small stored table: read more than once, and broadcast to the big side
    when their records are fetched, which then is not shuffled."""
    return small(materialise(nearest(queries, corpus.select("id", "vector"), k, **how), "hits"))


def search_documents(queries: DataFrame, documents: DataFrame, k: int = DEFAULT_K, **how) -> DataFrame:
    """Nearest documents by summary vector, with their record. The record is fetched after
    the top k is known, so only k rows per query are joined."""
    hits = _stored_hits(queries, documents, k, how)
    record = documents.select("id", "summary", "name", "file_path", "created_ms")
    return record.join(hits, "id").select(
        "query_id", "rank", "distance", "id", "name", "file_path", "summary", "created_ms"
    )


def search_folders(
    queries: DataFrame, folders: DataFrame, documents: DataFrame, k: int = DEFAULT_K, **how
) -> DataFrame:
    """Nearest folders, with their documents and subfolders (name, summary, file_path).

    A hit with more children than fit on one page comes as several rows, one per page.
    """
    hits = _stored_hits(queries, folders, k, how)
    record = folders.select("id", "summary", "name", "file_path", "created_ms")
    found = materialise(record.join(hits, "id"), "found")
    wanted = small(found.select("file_path").distinct())
    docs = documents.join(wanted.withColumnRenamed("file_path", "folder"), "folder", "left_semi")
    subs = folders.join(wanted.withColumnRenamed("file_path", "parent"), "parent", "left_semi")
    pages = folder_pages(docs, subs, ["name", "summary", "file_path"])
    return found.join(pages, "file_path", "left").select(
        "query_id", "rank", "distance", "id", "name", "file_path", "summary", "created_ms",
        F.coalesce("page", F.lit("")).alias("page"), "documents", "folders",
    )


def search_segments(
    queries: DataFrame, segments: DataFrame, documents: DataFrame, k: int = DEFAULT_K, **how
) -> DataFrame:
    """Nearest segments with the name of their document, ``''`` if it is gone."""
    hits = _stored_hits(queries, segments, k, how)
    record = segments.select("id", "document_id", "text", "created_ms")
    found = materialise(record.join(hits, "id"), "found")
    return named_segments(found, documents).select(
        "query_id", "rank", "distance", "id", "text", "document", "created_ms"
    )


def search_context(
    queries: DataFrame,
    segments: DataFrame,
    documents: DataFrame,
    k: int = DEFAULT_K,
    word_budget: int = WORD_BUDGET,
    provider: Provider | None = None,
    question: str = "question",
    **how,
) -> DataFrame:
    """(query_id, n_segments, context): the hits of each query as one text for an answer.

    Segments are taken in rank order while the words before them are within the budget. A
    query without hits has a null context. With a ``provider`` there is a column ``answer``:
    what it says to the query's ``question`` and context; null where there is no context.
    """
    hits = search_segments(queries, segments, documents, k, **how)
    before = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    used = hits.withColumn(
        "_before", F.coalesce(F.sum(count_words(F.col("text"))).over(before), F.lit(0))
    ).where(F.col("_before") < word_budget)
    parts = F.array_sort(F.collect_list(F.struct("rank", "text")))
    texts = used.groupBy("query_id").agg(parts.alias("parts")).select(
        "query_id",
        F.size("parts").alias("n_segments"),
        F.array_join(F.col("parts.text"), "\n\n").alias("context"),
    )
    found = queries.select("query_id", *([question] if provider else [])).join(texts, "query_id", "left").withColumn(
        "n_segments", F.coalesce("n_segments", F.lit(0))
    )
    columns = ["query_id", "n_segments", "context"]
    if provider is None:
        return found.select(columns)
    asked = materialise(found.withColumn("_asked", question_prompt(F.col(question), F.col("context"))), "asked")
    return asked.select(*columns, provider.column(F.col("_asked")).alias("answer"))


# --- joins and flat rows ---------------------------------------------------------------


def segment_documents(segments: DataFrame, documents: DataFrame) -> DataFrame:
    """Segments with ``document``, the name of their document or ``''``."""
    names = documents.select(F.col("id").alias("document_id"), F.col("name").alias("document"))
    return segments.join(names, "document_id", "left").withColumn(
        "document", F.coalesce("document", F.lit(""))
    )


def named_segments(found: DataFrame, documents: DataFrame) -> DataFrame:
    """As :func:`segment_documents` for a few stored segments: their documents are picked
    out with a broadcast first, so the document table is not shuffled."""
    owners = small(found.select(F.col("document_id").alias("id")).distinct())
    return segment_documents(found, documents.select("id", "name").join(owners, "id", "left_semi"))


def folder_pages(documents: DataFrame, folders: DataFrame, fields: list[str]) -> DataFrame:
    """(file_path, page, documents, folders): the children of each folder, page by page."""
    docs = child_pages(documents, "folder", fields, "documents").withColumnRenamed("folder", "file_path")
    below = folders.where(F.col("parent").isNotNull())
    subs = child_pages(below, "parent", fields, "folders").withColumnRenamed("parent", "file_path")
    return docs.join(subs, ["file_path", "page"], "full")


def flat_documents(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id", "distance", "name", "file_path", break_to_html(F.col("summary")).alias("summary")
    )


def flat_folders(hits: DataFrame) -> DataFrame:
    def names(children: str):
        return F.coalesce(F.array_join(F.array_sort(F.col(f"{children}.name")), "<br>– "), F.lit(""))

    return hits.select(
        "query_id", "distance", "name", "file_path", break_to_html(F.col("summary")).alias("summary"),
        "page", names("documents").alias("documents"), names("folders").alias("folders"),
    )


def flat_segments(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "distance", "document", break_to_html(F.col("text")).alias("text"))
