"""Corpora as DataFrames: listings and whole-file texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.paths import (
    AVOID_NAMES, FILE_TYPES, accepted_name, base_name, document_type, ignored_folder, parent_path,
)
from shelfmark.sources.tree import list_tree, read_contents


def _named(files: DataFrame, *others: str | Column) -> DataFrame:
    path = F.col("path")
    return files.select(
        "path",
        base_name(path).alias("name"),
        parent_path(path).alias("folder"),
        document_type(path).alias("ext"),
        *others,
    )


def accept(
    files: DataFrame,
    file_types: Sequence[str] = FILE_TYPES,
    avoid_names: Sequence[str] = AVOID_NAMES,
    ignore: Sequence[str] = (),
) -> DataFrame:
    """Keep the files an index takes in."""
    return files.where(
        accepted_name(F.col("name"), file_types, avoid_names)
        & ~ignored_folder(F.col("folder"), ignore)
    )


def scan_files(
    spark: SparkSession,
    root: str,
    file_types: Sequence[str] = FILE_TYPES,
    avoid_names: Sequence[str] = AVOID_NAMES,
    ignore: Sequence[str] = (),
) -> DataFrame:
    """Recursive listing (path, name, folder, ext, length, last_modified) of accepted files.

    Executors list the folders; no file is opened. Empty files and names that start with
    ``_`` or ``.`` are files like any other.
    """
    return accept(_named(list_tree(spark, root, ignore), "length", "last_modified"), file_types, avoid_names, ignore)


def read_text_files(
    spark: SparkSession,
    root: str,
    file_types: Sequence[str] = (".txt",),
    ignore: Sequence[str] = (),
) -> DataFrame:
    """One row per text file: (path, name, folder, ext, text, error).

    Line ends become ``\\n``; an empty file has an empty text. A file that is not UTF-8 or
    cannot be read gives a null text and an error instead of stopping the run.
    """
    found = read_contents(scan_files(spark, root, file_types, (), ignore))
    decoded = F.try_validate_utf8(F.col("content").cast("string"))
    return _named(
        found,
        F.regexp_replace(decoded, "\r\n?", "\n").alias("text"),
        F.coalesce("error", F.when(decoded.isNull(), F.lit("not UTF-8 text"))).alias("error"),
    )


def corpus_files(rows: DataFrame, path: Column, text: Column) -> DataFrame:
    """Any table with a path and a text as corpus files; its other columns are kept."""
    own = [c for c in rows.columns if c not in ("path", "name", "folder", "ext", "text")]
    return rows.select(
        path.alias("path"), text.alias("text"), *own
    ).select(
        "path",
        base_name(F.col("path")).alias("name"),
        parent_path(F.col("path")).alias("folder"),
        document_type(F.col("path")).alias("ext"),
        "text",
        *own,
    )
