"""What a new scan changes in a stored index, and the index after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNCHANGED, REPLACED, NEW = "unchanged", "replaced", "new"


def unchanged_documents(scan: DataFrame, stored: DataFrame) -> DataFrame:
    """Scan rows whose hash is stored, with the ``id`` stored for it."""
    known = stored.groupBy("hash").agg(F.min("id").alias("id"))
    return scan.join(known, "hash")


def changed_or_new(scan: DataFrame, stored: DataFrame) -> DataFrame:
    """Scan rows whose hash is not stored."""
    return scan.join(stored.select("hash"), "hash", "left_anti")


def stale_rows(changed: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored rows at the path of a changed scan row; they are to be deleted.

    Serves documents and folders alike.
    """
    paths = changed.select(F.col("path").alias("file_path"))
    return stored.join(paths, "file_path", "left_semi")


def gone_rows(scan: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored rows at a path the scan no longer has."""
    return stored.join(scan.select(F.col("path").alias("file_path")), "file_path", "left_anti")


def without(rows: DataFrame, removed: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` less those whose ``key`` is the id of a removed row."""
    return rows.join(removed.select(F.col("id").alias(key)), key, "left_anti").select(rows.columns)


def cascade_delete(
    documents: DataFrame, segments: DataFrame, removed: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Documents and segments less the removed documents and all their segments."""
    return without(documents, removed), without(segments, removed, "document_id")


def classify(scan: DataFrame, stored: DataFrame) -> DataFrame:
    """Scan rows (path, hash) with their ``status``; the stored side is one row per key."""
    by_hash = stored.groupBy("hash").agg(F.lit(True).alias("_same"))
    by_path = stored.groupBy(F.col("file_path").alias("path")).agg(F.lit(True).alias("_there"))
    status = (
        F.when(F.col("_same"), UNCHANGED).when(F.col("_there"), REPLACED).otherwise(NEW)
    )
    return (
        scan.join(by_hash, "hash", "left")
        .join(by_path, "path", "left")
        .select(*scan.columns, status.alias("status"))
    )


def index_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def upsert(
    stored: DataFrame,
    new: DataFrame,
    scan: DataFrame | None = None,
) -> DataFrame:
    """The table after a run: stored rows less the replaced ones, and the new rows.

    ``new`` holds the changed and new records, with ``file_path``. With ``scan``, stored
    rows at paths that are gone are removed as well; the default keeps them.
    """
    kept = stored.join(new.select("file_path"), "file_path", "left_anti")
    if scan is not None:
        kept = kept.join(scan.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    return kept.select(new.columns).unionByName(new)


def insert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Append records to a collection; columns either side lacks are null."""
    return stored.unionByName(new, allowMissingColumns=True)
