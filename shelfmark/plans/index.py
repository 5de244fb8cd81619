"""A whole index run: scan, find changes, enrich, cut, roll up, store."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import (
    DOCUMENT_INSTRUCTIONS, DOCUMENT_OPENING, FOLDER_INSTRUCTIONS, FOLDER_OPENING, NO_DOCUMENT_SUMMARY, WORD_BUDGET,
    document_hash, document_id,
    document_prompt, embedding_input, extracted_text, is_substantial, truncate_words,
)
from shelfmark.operators.changes import cascade_delete, changed_or_new, gone_rows, stale_rows
from shelfmark.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, chunk_documents
from shelfmark.operators.enrich import (
    SUMMARY_WORDS, KeySentences, Provider, classify_segments, embed, summarise,
)
from shelfmark.operators.folders import ancestors, rollup, upsert_folders
from shelfmark.runtime import materialise, new_scratch_path, small, spread, temporary_scratch
from shelfmark.sources.snapshots import (
    layers_of, new_snapshot_id, newest_snapshot, restore_snapshot, write_layers, write_manifest, write_table,
)


@dataclass
class Settings:
    """What a run uses; the defaults need no model."""

    document_summaries: Sequence[Provider] = (KeySentences(DOCUMENT_OPENING),)
    folder_summaries: Sequence[Provider] = (KeySentences(FOLDER_OPENING),)
    vectors: Provider | None = None
    prompts: bool = False
    document_instructions: str = DOCUMENT_INSTRUCTIONS
    folder_instructions: str = FOLDER_INSTRUCTIONS
    word_budget: int = WORD_BUDGET
    summary_words: int = SUMMARY_WORDS
    check_segments: bool = False
    segment_check: Provider | None = None
    chunk_size: int = CHUNK_SIZE
    chunk_overlap: int = CHUNK_OVERLAP
    root: str = ""
    prune: bool = False
    now_ms: Column | None = field(default=None)

    def created(self) -> Column:
        return F.unix_millis(F.current_timestamp()) if self.now_ms is None else self.now_ms


def extracted(files: DataFrame) -> DataFrame:
    """Files (path, name, folder, ext, text, ...) with their clean text and ``hash``."""
    return files.withColumn("text", extracted_text(F.col("ext"), F.col("text"))).withColumn(
        "hash", document_hash(F.col("path"), F.col("name"), F.col("text"))
    )


def document_records(texts: DataFrame, settings: Settings) -> DataFrame:
    """Document records of extracted files, with summary and vector."""
    asked = "text"
    if settings.prompts:
        cut = truncate_words(F.col("text"), settings.word_budget)
        texts = texts.withColumn("_cut", cut).withColumn(
            "_prompt", document_prompt(
                F.col("ext"), F.col("_cut.text"), F.col("_cut.truncated"), settings.document_instructions
            )
        )
        asked = "_prompt"
    done = summarise(
        texts, asked, settings.document_summaries, message=NO_DOCUMENT_SUMMARY, max_words=settings.summary_words
    )
    done = done.select(
        document_id(F.col("hash")).alias("id"), "name", F.col("path").alias("file_path"), "folder",
        F.col("ext").alias("doc_type"), "hash", "summary",
        embedding_input(F.col("summary"), F.col("name")).alias("_embed"),
    )
    return embed(done, "_embed", settings.vectors).select(
        "id", "name", "file_path", "folder", "doc_type", "hash", "summary", "vector",
        settings.created().alias("created_ms"),
    )


def segment_records(texts: DataFrame, settings: Settings) -> DataFrame:
    """Segment records of extracted files."""
    documents = texts.select(
        document_id(F.col("hash")).alias("id"), F.col("ext").alias("doc_type"), "text"
    )
    keep = is_substantial if settings.check_segments and settings.segment_check is None else None
    cut = chunk_documents(documents, settings.chunk_size, settings.chunk_overlap, keep)
    if settings.check_segments and settings.segment_check is not None:
        cut = classify_segments(cut, settings.segment_check).where("meaningful")
    return embed(cut, "segment", settings.vectors).select(
        F.col("segment_id").alias("id"), F.col("id").alias("document_id"), "ord",
        F.col("segment").alias("text"), "vector", settings.created().alias("created_ms"),
    )


def run_index(
    files: DataFrame,
    stored: dict[str, DataFrame] | None = None,
    settings: Settings | None = None,
    target: str | None = None,
) -> dict[str, DataFrame]:
    """The tables of the index after a run over accepted ``files``, a plain scan.

    Documents whose hash is stored are left as they are. The change test moves only paths
    and hashes; the texts of changed documents alone are stored and worked on. The tables are written under ``target``, a folder that is not the one
    ``stored`` is read from; by default one in the shared folder.
    """
    settings = settings or Settings()
    target = target or new_scratch_path(files.sparkSession, "index")
    texts = extracted(spread(files, "path"))
    if stored is None:
        # Stored once: documents and segments are made from the same reading of each file.
        texts = materialise(texts, "texts")
        documents, segments = document_records(texts, settings), segment_records(texts, settings)
    else:
        documents, segments = _refreshed(files, texts, stored, settings)
    documents = write_table(documents, f"{target}/documents")
    segments = write_table(segments, f"{target}/segments")
    visited = documents
    if stored is not None:
        # Folders are summarised from what the scan found, not from records of gone files.
        visited = documents.join(files.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    folders = rollup(
        ancestors(files, settings.root), visited, stored and stored["folders"],
        settings.folder_summaries, settings.vectors, settings.prompts, settings.created(),
        settings.word_budget, settings.summary_words, settings.folder_instructions,
    )
    if stored is not None and not settings.prune:
        folders = upsert_folders(stored["folders"], folders)
    folders = write_table(folders, f"{target}/folders")
    return {"documents": documents, "segments": segments, "folders": folders}


# The filter of many changed paths: bits for each of them, and bits at most.
BITS_PER_PATH = 64
MAX_BITS = 1 << 29


def _path_filter(paths: DataFrame, n: int) -> tuple[DataFrame, int]:
    """A Bloom filter of ``n`` stored paths as (bucket, bits), and how many bits it has.

    One hash; its size follows the number of paths, up to 64 MB of bits.
    """
    n_bits = min(MAX_BITS, 1 << max(15, (BITS_PER_PATH * n - 1).bit_length()))
    place = F.pmod(F.xxhash64("path"), F.lit(n_bits))
    # ``bitmap_bucket_number`` counts from 1 for places from 0 on.
    marks = paths.select(F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_bit"))
    return marks.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits")), n_bits


def _rows_at(texts: DataFrame, paths: DataFrame, few_paths: int = 200_000) -> DataFrame:
    """The rows of ``texts`` at the stored ``paths``, without moving the other texts.

    A few paths are broadcast. Of more, a Bloom filter is, and is looked up where the texts are
    read; only texts that it lets pass are shuffled for the exact join.
    """
    n = paths.count()
    if n <= few_paths:
        return texts.join(F.broadcast(paths), "path", "left_semi")
    bits, n_bits = _path_filter(paths, n)
    place = F.pmod(F.xxhash64("path"), F.lit(n_bits))
    position = F.bitmap_bit_position(place)
    octet = F.conv(F.hex(F.substring("_bits", (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.expr("shiftright(_octet, CAST(_position % 8 AS INT)) & 1 = 1")
    near = texts.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(materialise(bits, "filter")), "_bucket")
    near = near.withColumns({"_octet": octet, "_position": position}).where(marked)
    return near.drop("_bucket", "_bits", "_octet", "_position").join(paths, "path", "left_semi")


def _changes(files: DataFrame, texts: DataFrame, documents: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Paths to work on, and (id, folder) of stored documents to take away."""
    todo = materialise(changed_or_new(texts.select("path", "hash"), documents).select("path"), "changed")
    removed = stale_rows(todo, documents.select("id", "folder", "file_path")).select("id", "folder")
    if settings.prune:
        gone = gone_rows(files.select("path"), documents.select("id", "folder", "file_path"))
        removed = removed.unionByName(gone.select("id", "folder"))
    return todo, materialise(removed, "removed")


def _refreshed(
    files: DataFrame, texts: DataFrame, stored: dict[str, DataFrame], settings: Settings
) -> tuple[DataFrame, DataFrame]:
    """Documents and segments of a re-run: only changed and new files are worked on."""
    todo, removed = _changes(files, texts, stored["documents"], settings)
    changed = materialise(_rows_at(texts, todo), "texts")
    documents, segments = cascade_delete(stored["documents"], stored["segments"], removed)
    new_documents = document_records(changed, settings).select(documents.columns)
    new_segments = segment_records(changed, settings).select(segments.columns)
    return documents.unionByName(new_documents), segments.unionByName(new_segments)


# A snapshot with more layers is written anew as one.
MAX_LAYERS = 16


def refresh_snapshot(files: DataFrame, root: str, path: str, settings: Settings | None = None, max_layers: int = MAX_LAYERS) -> str:
    """A run over accepted ``files`` that writes what it changes; the id of the snapshot after it.

    The newest snapshot of ``path`` under ``root`` is the stored index; without one this is a
    first run. Changed documents, their segments and the folders above them make a new layer, with
    the keys of what they replace; all other files of the snapshot are carried over. If nothing
    changed, the stored snapshot is the result. What :func:`run_index` gives with the same
    ``stored`` is what the snapshot restores to.

    The change test moves paths and hashes, the folder digests move sums for each folder.
    """
    spark, settings = files.sparkSession, settings or Settings()
    newest = newest_snapshot(spark, root, path)
    if newest is None:
        return index_to_snapshot(files, root, path, None, settings)
    layers = layers_of(spark, root, newest)
    stored = restore_snapshot(spark, root, newest)
    depth = 1 + max(layer[2] for layer in layers)
    if depth >= max_layers:
        return index_to_snapshot(files, root, path, stored, settings)
    with temporary_scratch(spark):
        snapshot = new_snapshot_id(spark, path)
        changes = _layer_of_changes(files, stored, settings, f"{root}/{snapshot}")
        if not changes:
            return newest
        added = [
            (name, path, depth, f"{snapshot}/{name}" if new else None, f"{snapshot}/{name}-gone" if gone else None)
            for name, (new, gone) in changes.items()
        ]
        write_layers(spark, f"{root}/{snapshot}", [(t, path, n, rows, gone) for t, _, n, rows, gone in layers] + added)
    return snapshot


def _layer_of_changes(
    files: DataFrame, stored: dict[str, DataFrame], settings: Settings, target: str
) -> dict[str, tuple[bool, bool]]:
    """Writes new rows, and keys of rows to take away, under ``target``; for each table that
    changes whether it has either."""
    documents = stored["documents"]
    texts = extracted(spread(files, "path"))
    todo, removed = _changes(files, texts, documents, settings)
    # Stored documents whose file is not there now; their folders are summarised without them.
    absent = materialise(gone_rows(files.select("path"), documents.select("id", "folder", "file_path")).select("id", "folder"), "absent")
    tree = materialise(ancestors(files, settings.root), "tree")
    without = small(materialise(removed.select("id").unionByName(absent.select("id")).distinct(), "without"))
    children = documents.join(without, "id", "left_anti").select("folder", "id", "summary")
    any_new, any_gone = bool(todo.head(1)), bool(removed.head(1))
    if any_new:
        changed = materialise(_rows_at(texts, todo), "texts")
        new_documents = write_table(document_records(changed, settings), f"{target}/documents")
        write_table(segment_records(changed, settings), f"{target}/segments")
        children = children.unionByName(new_documents.select("folder", "id", "summary"))
    if any_gone:
        keys = removed.select(F.col("id").alias("key")).distinct()
        for name in ("documents", "segments"):
            keys.write.parquet(f"{target}/{name}-gone")
    fresh = rollup(
        tree, children, stored["folders"], settings.folder_summaries, settings.vectors, settings.prompts, settings.created(),
        settings.word_budget, settings.summary_words, settings.folder_instructions,
    )
    fresh = materialise(fresh, "folders")
    known = stored["folders"].select("id", "file_path")
    new_folders = materialise(fresh.join(known.select("id"), "id", "left_anti").select(fresh.columns), "folders")
    stale = known.join(fresh.select("file_path", F.col("id").alias("_now")), "file_path").where(F.col("id") != F.col("_now")).select("id")
    if settings.prune:
        stale = stale.unionByName(known.join(fresh.select("file_path"), "file_path", "left_anti").select("id"))
    stale = materialise(stale.select(F.col("id").alias("key")).distinct(), "stale")
    changed_folders, folders_gone = bool(new_folders.head(1)), bool(stale.head(1))
    if changed_folders:
        write_table(new_folders, f"{target}/folders")
    if folders_gone:
        stale.write.parquet(f"{target}/folders-gone")
    parts = {"documents": (any_new, any_gone), "segments": (any_new, any_gone), "folders": (changed_folders, folders_gone)}
    return {name: has for name, has in parts.items() if any(has)}


def index_to_snapshot(
    files: DataFrame,
    root: str,
    path: str,
    stored: dict[str, DataFrame] | None = None,
    settings: Settings | None = None,
) -> str:
    """A run whose tables are written once, as a new snapshot under ``root``; its id.

    The scratch tables of the run are deleted at its end.
    """
    spark = files.sparkSession
    snapshot = new_snapshot_id(spark, path)
    with temporary_scratch(spark):
        tables = run_index(files, stored, settings, f"{root}/{snapshot}")
        write_manifest(spark, f"{root}/{snapshot}", tables, path)
    return snapshot
