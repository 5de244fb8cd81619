"""Index snapshots: one folder per snapshot, one Parquet table per collection.

A snapshot is a list of layers. A layer is a folder of rows that one run has written and, if that
run took rows away, a folder with their keys. Later snapshots carry the layers of the one before
on in their manifest and add their own, so a run writes what it changed. A key in a layer takes
away rows of earlier layers; a row that comes back later is there again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.paths import snapshot_name
from shelfmark.runtime import small
from shelfmark.schema import INDEX_TABLES
from shelfmark.sources.reconcile import reconcile

MANIFEST = "manifest"
# ``rows`` and ``gone`` are folders below the root of the snapshots, null where a layer has none.
MANIFEST_SCHEMA = "table string, path string, layer int, rows string, gone string"
# Which column names the rows that a layer takes away.
GONE_KEYS = {"documents": "id", "segments": "document_id", "folders": "id"}
# Point lookups are by these columns; their values are random digests or long paths, so
# row-group bloom filters prune where min/max ranges cannot.
LOOKUP_COLUMNS = ("id", "hash", "file_path", "document_id")


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write a table so that point lookups can skip row groups; return it as stored."""
    # Filters as large as the values of a row group ask for, not a megabyte each.
    writer = df.write.option("parquet.bloom.filter.adaptive.enabled", "true")
    for column in LOOKUP_COLUMNS:
        if column in df.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_snapshot_id(spark: SparkSession, path: str) -> str:
    row = spark.range(1).select(
        snapshot_name(F.lit(path), F.current_timestamp(), F.lit(str(uuid.uuid4()))).alias("id")
    )
    return row.first()["id"]


def write_manifest(spark: SparkSession, folder: str, tables: Iterable[str], path: str) -> None:
    """Mark a snapshot of the indexed ``path`` as complete. Without the mark it is never restored."""
    snapshot = folder.rstrip("/").rpartition("/")[2]
    write_layers(spark, folder, [(name, path, 0, f"{snapshot}/{name}", None) for name in tables])


def write_layers(spark: SparkSession, folder: str, layers: list[tuple]) -> None:
    """The manifest of a snapshot from its layers, one line for each table and layer."""
    spark.createDataFrame(layers, MANIFEST_SCHEMA).coalesce(1).write.parquet(f"{folder}/{MANIFEST}")


def layers_of(spark: SparkSession, root: str, snapshot: str) -> list[tuple]:
    """The lines of a snapshot's manifest, by table and layer."""
    lines = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{root}/{snapshot}/{MANIFEST}").collect()
    # A manifest from before there were layers only names tables.
    found = [(r["table"], r["path"], r["layer"] or 0, r["rows"] if r["layer"] is not None else f"{snapshot}/{r['table']}", r["gone"]) for r in lines]
    return sorted(found, key=lambda r: (r[0], r[2]))


def _layered(spark: SparkSession, root: str, name: str, layers: list[tuple]) -> DataFrame:
    """The rows of a table's layers, less those that a later layer takes away."""
    filled = [(layer, spark.read.parquet(f"{root}/{rows}")) for _, _, layer, rows, _ in layers if rows]
    if name in INDEX_TABLES:
        filled = [(layer, reconcile(t, INDEX_TABLES[name])) for layer, t in filled]
    gone = [
        spark.read.parquet(f"{root}/{folder}").select(F.col("key").alias("_gone"), F.lit(layer).alias("_until"))
        for _, _, layer, _, folder in layers if folder
    ]
    if not gone:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t for _, t in filled])
    marked = [t.withColumn("_layer", F.lit(layer)) for layer, t in filled]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    # Stored and narrow: broadcast up to a bound, so that the rows that stay are not moved.
    last = reduce(DataFrame.unionByName, gone).groupBy("_gone").agg(F.max("_until").alias("_until"))
    away = (F.col(GONE_KEYS[name]) == F.col("_gone")) & (F.col("_layer") < F.col("_until"))
    return rows.join(small(last), away, "left_anti").drop("_layer")


def write_snapshot(tables: dict[str, DataFrame], root: str, path: str) -> str:
    """Save ``tables`` under a new dated id that carries the indexed path; return the id.

    The manifest is written last. See also :func:`shelfmark.plans.index_to_snapshot`, which
    writes the tables of a run in place.
    """
    spark = next(iter(tables.values())).sparkSession
    snapshot = new_snapshot_id(spark, path)
    for name, df in tables.items():
        write_table(df, f"{root}/{snapshot}/{name}")
    write_manifest(spark, f"{root}/{snapshot}", tables, path)
    return snapshot


def blobs_under(spark: SparkSession, root: str) -> DataFrame:
    """(name, last_modified) of the stored Parquet files, names relative to ``root``."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(root)
    )
    plain_root = root.split(":", 1)[-1].strip("/")
    name = F.substring_index(F.col("path"), f"{plain_root}/", -1)
    return found.select(name.alias("name"), F.col("modificationTime").alias("last_modified"))


def snapshot_times(blobs: DataFrame) -> DataFrame:
    """(snapshot, last_modified): the newest blob of each first path part.

    A name without ``/`` belongs to no snapshot.
    """
    return (
        blobs.where(F.col("name").contains("/"))
        .groupBy(F.substring_index("name", "/", 1).alias("snapshot"))
        .agg(F.max("last_modified").alias("last_modified"))
    )


def latest_snapshot(blobs: DataFrame) -> DataFrame:
    """One row (snapshot, last_modified): the newest snapshot, ties by name."""
    return snapshot_times(blobs).orderBy(F.desc("last_modified"), F.desc("snapshot")).limit(1)


def complete_snapshots(spark: SparkSession, root: str, path: str | None = None) -> DataFrame:
    """(snapshot, last_modified) of the complete snapshots under ``root``, of one indexed
    ``path`` if it is given. Only manifests are listed."""
    try:
        manifests = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{root}/*/{MANIFEST}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "snapshot string, last_modified timestamp")
    if path is not None:
        manifests = manifests.where(F.col("path") == path)
    name = F.substring_index(F.substring_index("_metadata.file_path", f"/{MANIFEST}/", 1), "/", -1)
    return manifests.groupBy(name.alias("snapshot")).agg(
        F.max("_metadata.file_modification_time").alias("last_modified")
    )


def newest_snapshot(spark: SparkSession, root: str, path: str | None = None) -> str | None:
    """The newest complete snapshot, of the indexed ``path`` if it is given."""
    newest = complete_snapshots(spark, root, path).orderBy(F.desc("last_modified"), F.desc("snapshot")).first()
    return newest and newest["snapshot"]


def restore_snapshot(
    spark: SparkSession, root: str, snapshot: str | None = None, path: str | None = None
) -> dict[str, DataFrame]:
    """The tables of the named snapshot, or of the newest complete one, of the indexed ``path``
    if it is given. Declared tables that the snapshot lacks are there, empty."""
    if snapshot is None:
        snapshot = newest_snapshot(spark, root, path)
        if snapshot is None:
            raise LookupError(f"no complete snapshot under {root}" + (f" of {path}" if path else ""))
    layers = layers_of(spark, root, snapshot)
    names = dict.fromkeys(layer[0] for layer in layers)
    tables = {name: _layered(spark, root, name, [x for x in layers if x[0] == name]) for name in names}
    for name, schema in INDEX_TABLES.items():
        tables[name] = reconcile(tables[name], schema) if name in tables else spark.createDataFrame([], schema)
    return tables
