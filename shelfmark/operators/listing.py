"""Listings, lookups and links of the stored collections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.grouping import child_pages
from shelfmark.operators.search import folder_pages, named_segments, segment_documents
from shelfmark.runtime import materialise


def lookup(
    table: DataFrame,
    ids: Sequence[str] | DataFrame | None = None,
    hashes: Sequence[str] | DataFrame | None = None,
    paths: Sequence[str] | DataFrame | None = None,
) -> DataFrame:
    """Rows by id, content hash or path: given values, or a table with the column.

    Values become a filter that the Parquet scan applies, a table becomes a semi-join.
    """
    for column, wanted in (("id", ids), ("hash", hashes), ("file_path", paths)):
        if wanted is None:
            continue
        if isinstance(wanted, DataFrame):
            table = table.join(wanted.select(column), column, "left_semi")
        else:
            table = table.where(F.col(column).isin(*wanted))
    return table


def segments_of(segments: DataFrame, documents: DataFrame) -> DataFrame:
    """Segments whose document is among ``documents``."""
    return segments.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi")


def document_segments(segments: DataFrame) -> DataFrame:
    """(document_id, segments): segment ids of each document, in text order.

    A document is one text value, which bounds the number of its segments.
    """
    pieces = F.array_sort(F.collect_list(F.struct("ord", "id")))
    return segments.groupBy("document_id").agg(pieces.alias("pieces")).select(
        "document_id", F.col("pieces.id").alias("segments")
    )


def linked_documents(documents: DataFrame, segments: DataFrame) -> DataFrame:
    """Documents with ``segments``, the ids of their segments; empty where there are none."""
    links = document_segments(segments).withColumnRenamed("document_id", "id")
    return documents.join(links, "id", "left").withColumn(
        "segments", F.coalesce("segments", F.array().cast("array<string>"))
    )


def list_documents(documents: DataFrame, segments: DataFrame) -> DataFrame:
    """All documents with the texts of their segments nested."""
    pieces = F.array_sort(F.collect_list(F.struct("ord", "text")))
    texts = segments.groupBy("document_id").agg(pieces.alias("pieces")).select(
        F.col("document_id").alias("id"), F.col("pieces.text").alias("segments")
    )
    return documents.select("id", "name", "file_path", "hash", "summary", "created_ms").join(
        texts, "id", "left"
    )


def list_folders(folders: DataFrame, documents: DataFrame) -> DataFrame:
    """All folders with the names of their documents and subfolders, page by page."""
    pages = folder_pages(documents, folders, ["name"])
    return (
        folders.select("id", "name", "file_path", "summary", "created_ms")
        .join(pages, "file_path", "left")
        .select(
            "id", "name", "file_path", "summary", "created_ms",
            F.coalesce("page", F.lit("")).alias("page"),
            F.col("documents.name").alias("documents"),
            F.col("folders.name").alias("folders"),
        )
    )


def limit_rows(table: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in the given order."""
    return table.orderBy(*order).limit(n)


def list_segments(segments: DataFrame, documents: DataFrame, limit: int | None = None) -> DataFrame:
    """All segments, or the first ``limit`` by id, with the name of their document."""
    columns = segments.select("id", "document_id", "text", "created_ms")
    if limit is None:
        return segment_documents(columns, documents).select("id", "text", "document", "created_ms")
    first = materialise(limit_rows(columns, limit, "id"), "listing")
    return named_segments(first, documents).select("id", "text", "document", "created_ms")


def folder_document_ids(documents: DataFrame) -> DataFrame:
    """(folder, page, ids): the ids of the documents in each folder, page by page."""
    pages = child_pages(documents, "folder", [], "items")
    return pages.select("folder", "page", F.col("items.id").alias("ids"))
