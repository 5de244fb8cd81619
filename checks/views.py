"""The given tables seen as a corpus, its index, an older index and its blobs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import (
    document_hash, document_id, extracted_text, folder_hash, folder_id,
)
from shelfmark.functions.text import DOCUMENT_OPENING, NO_DOCUMENT_SUMMARY
from shelfmark.operators import KeySentences, ancestors, chunk_documents, summarise
from shelfmark.runtime import materialise, spread
from shelfmark.sources import corpus_files
from shelfmark.sources.files import accept


@dataclass
class Views:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def files(self) -> DataFrame:
        """Every document as a file ``/corpus/<source>/<lang>/<name>``."""
        return self._files(self.table("documents"))

    @staticmethod
    def _files(docs: DataFrame) -> DataFrame:
        ending = F.element_at(
            F.array(*map(F.lit, (
                ".txt", ".txt", ".txt", ".txt", ".docx", ".pdf", ".pptx", ".xlsx", ".rtf", ".csv",
            ))),
            (F.col("doc_id") % 10 + 1).cast("int"),
        )
        name = F.when(F.col("doc_id") % 101 == 5, "Folder_Contents.xlsx").otherwise(
            F.concat(
                F.when(F.col("doc_id") % 97 == 0, "~$").otherwise(""),
                F.lit("doc_"), F.col("doc_id").cast("string"), ending,
            )
        )
        path = F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/"), name)
        return corpus_files(docs.select("doc_id", "text", "source", "lang"), path, F.col("text")).drop(
            "source", "lang"
        )

    @cached_property
    def accepted(self) -> DataFrame:
        return accept(self.files)

    @cached_property
    def texts(self) -> DataFrame:
        """Accepted files with their clean text, hash and id, over enough partitions."""
        return (
            accept(self._files(spread(self.table("documents"), "doc_id")))
            .withColumn("text", extracted_text(F.col("ext"), F.col("text")))
            .withColumn("hash", document_hash(F.col("path"), F.col("name"), F.col("text")))
            .withColumn("id", document_id(F.col("hash")))
        )

    @cached_property
    def records(self) -> DataFrame:
        """Document records without summaries and vectors; ``doc_id`` leads back to the given tables."""
        return self.texts.select(
            "id", "name", F.col("path").alias("file_path"), "folder", F.col("ext").alias("doc_type"), "hash",
            F.lit(0).cast("long").alias("created_ms"), "doc_id",
        )

    @cached_property
    def documents(self) -> DataFrame:
        """The same with summaries."""
        done = summarise(self.texts, "text", (KeySentences(DOCUMENT_OPENING),), message=NO_DOCUMENT_SUMMARY)
        return done.select(
            "id", "name", F.col("path").alias("file_path"), "folder", F.col("ext").alias("doc_type"), "hash", "summary",
            F.lit(0).cast("long").alias("created_ms"), "doc_id",
        )

    @cached_property
    def index_documents(self) -> DataFrame:
        """The same as a stored table, for what works on an index rather than on texts."""
        return materialise(self.documents, "documents")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")
        )

    @cached_property
    def vector_documents(self) -> DataFrame:
        return self.index_documents.join(self.vectors, "doc_id")

    @cached_property
    def segments(self) -> DataFrame:
        """Segments of all accepted files, with the ``doc_id`` they come from."""
        texts = self.texts.select("id", "doc_id", F.col("ext").alias("doc_type"), "text")
        return chunk_documents(texts).select(
            F.col("segment_id").alias("id"), F.col("id").alias("document_id"), "ord",
            F.col("segment").alias("text"), F.lit(0).cast("long").alias("created_ms"), "doc_id",
        )

    @cached_property
    def vector_segments(self) -> DataFrame:
        return materialise(self.segments.join(self.vectors, "doc_id"), "segments")

    @cached_property
    def queries(self) -> DataFrame:
        """One query vector per topic label: the mean of the label's vectors."""
        parts = self.table("embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
        means = parts.groupBy("label", "i").agg(F.avg("x").alias("x"))
        ordered = F.array_sort(F.collect_list(F.struct("i", F.col("x").cast("float").alias("x"))))
        return means.groupBy(F.col("label").cast("long").alias("query_id")).agg(
            ordered.alias("cells")
        ).select("query_id", F.col("cells.x").alias("vector"))

    @cached_property
    def tree(self) -> DataFrame:
        return ancestors(self.accepted, "/corpus")

    @cached_property
    def plain_folders(self) -> DataFrame:
        """Folder records whose summary is their path and whose vector is that of their
        lowest document; enough for listings and search."""
        under = self.accepted.join(self.vectors, "doc_id").select(
            F.explode(F.array(F.lit("/corpus"), F.regexp_extract("folder", "^/[^/]+/[^/]+", 0), "folder")).alias("path"),
            "doc_id", "vector",
        )
        lowest = under.groupBy("path").agg(F.min_by("vector", "doc_id").alias("vector"))
        content = folder_hash(F.col("path"), F.lit(""))
        folders = self.tree.join(lowest, "path", "left").select(
            folder_id(content).alias("id"), "name", F.col("path").alias("file_path"), "parent", "depth",
            content.alias("hash"), F.concat(F.lit("Folder\n"), "path").alias("summary"), "vector",
            F.lit(0).cast("long").alias("created_ms"),
        )
        return materialise(folders, "folders")

    @cached_property
    def scan(self) -> DataFrame:
        return self.texts.select("path", "hash")

    @cached_property
    def stored(self) -> DataFrame:
        """An older index: labelled documents are stored, those of low quality with older
        content; toxic ones were also stored at a path that is gone."""
        rows = self.texts.select("doc_id", "path", "name", "hash").join(self.table("labels"), "doc_id")
        old = F.when(F.col("quality") == 0, F.concat(F.lit("old-"), "hash")).otherwise(F.col("hash"))
        here = rows.select(F.col("path").alias("file_path"), old.alias("hash"))
        gone = rows.where(F.col("toxic") == 1).select(
            F.concat(F.lit("/corpus/gone/"), "name").alias("file_path"),
            F.concat(F.lit("gone-"), "hash").alias("hash"),
        )
        stored = here.unionByName(gone).select(
            document_id(F.col("hash")).alias("id"), "file_path", "hash"
        )
        return materialise(stored, "stored")

    @cached_property
    def stored_segments(self) -> DataFrame:
        """Segments of the older index: one per turn of a conversation, hung on the stored
        document whose number the conversation has."""
        owners = self.texts.select("doc_id", "path", "hash").join(self.table("labels"), "doc_id").select(
            F.col("doc_id").alias("conv_id"),
            document_id(
                F.when(F.col("quality") == 0, F.concat(F.lit("old-"), "hash")).otherwise(F.col("hash"))
            ).alias("document_id"),
        )
        return self.table("conversations").join(owners, "conv_id").select(
            F.concat_ws(":", F.lit("turn"), F.col("conv_id"), F.col("turn")).alias("id"),
            "document_id", F.col("turn").cast("int").alias("ord"), "text",
        )

    @cached_property
    def blobs(self) -> DataFrame:
        name = F.concat(
            F.lit("snap-"), "event_type",
            F.when(F.col("event_id") % 10 == 0, "").otherwise(
                F.concat(F.lit("/part-"), F.col("event_id").cast("string"))
            ),
        )
        return self.table("events").select(name.alias("name"), F.col("ts").alias("last_modified"))

    @cached_property
    def cells(self) -> DataFrame:
        """One sheet per user: a row per event, four columns, an empty cell for errors."""
        values = F.array(
            F.col("event_type"), F.col("user_id").cast("string"),
            F.nullif("event_type", F.lit("error")), F.col("props"),
        )
        return self.table("events").select(
            F.concat(F.lit("/sheets/user_"), F.col("user_id").cast("string"), F.lit(".xlsx")).alias("path"),
            F.col("event_id").cast("int").alias("row"),
            F.posexplode(values).alias("col", "value"),
        )

    @cached_property
    def children(self) -> DataFrame:
        """What each folder holds: documents, and subfolders with a one-line summary."""
        docs = self.index_documents.select(
            "folder", F.lit(1).alias("kind_ord"), "id", "summary"
        )
        subs = self.plain_folders.where(F.col("parent").isNotNull()).select(
            F.col("parent").alias("folder"), F.lit(0).alias("kind_ord"), "id", "summary"
        )
        return docs.unionByName(subs)
