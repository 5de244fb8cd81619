"""One query per operator, over the whole given tables."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import Views
from shelfmark import functions as C
from shelfmark import operators as O
from shelfmark import sources as S
from shelfmark.functions import paths as P
from shelfmark.runtime import materialise, new_scratch_path, spread
from shelfmark.schema import DOCUMENTS
from shelfmark.sources.tree import normal_root

IGNORE = ("/corpus/src1", "de", "")
BAR = " | "

Query = Callable[[Views], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def joined(array: str | Column) -> Column:
    """An array as one string, so that both engines print it alike."""
    return F.coalesce(F.array_join(array, BAR), F.lit(""))


# --- sources and sinks -----------------------------------------------------------------


def _text_tree(v: Views) -> str:
    """The documents written as a tree with a file for each; a tenth of the names each begin
    with ``_`` and with ``.``, and a document without text is an empty file."""
    root = normal_root(new_scratch_path(v.spark, "corpus"))

    def write(batches):
        for batch in batches:
            # Value by value: only one text of a batch is a Python string at a time.
            for name, source, lang, text in zip(*batch.columns, strict=True):
                name, source, lang, text = name.as_py(), source.as_py(), lang.as_py(), text.as_py()
                folder = f"{root}/{source or 'none'}/{lang or 'none'}"
                os.makedirs(folder, exist_ok=True)
                with open(f"{folder}/{name}", "wb") as file:
                    file.write(text.encode())
        yield from ()

    digit = F.col("doc_id") % 10
    name = F.concat(
        F.when(digit == 0, "_").when(digit == 1, ".").otherwise(""), F.col("doc_id").cast("string"), F.lit(".txt")
    )
    files = spread(v.table("documents").select("doc_id", "source", "lang", "text"))
    files = files.select(name.alias("name"), "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    files.mapInArrow(write, "n int").write.format("noop").mode("overwrite").save()
    return root


def _below(root: str) -> Column:
    return F.substring("path", len(root) + 2, 1 << 20)


@query
def scan_files(v):
    root = _text_tree(v)
    return S.scan_files(v.spark, root).select(_below(root).alias("file"), "name", "ext", F.col("length").alias("n_bytes"))


@query
def read_text_files(v):
    root = _text_tree(v)
    return S.read_text_files(v.spark, root).select(
        _below(root).alias("file"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"), "error"
    )


@query
def render_cells(v):
    return S.render_cells(v.cells)


@query
def export_folder_contents(v):
    out = new_scratch_path(v.spark, "contents")
    S.export_contents(v.index_documents, v.plain_folders, out)
    return v.spark.read.parquet(out).select(
        "folder", "kind_ord", F.col("File").alias("file"), F.col("Summary").alias("summary")
    )


@query
def write_snapshot(v):
    root = new_scratch_path(v.spark, "snapshots")
    tables = {"documents": v.vector_documents.drop("doc_id"), "folders": v.plain_folders}
    name = S.write_snapshot(tables, root, "/corpus")
    counts = [
        v.spark.read.parquet(f"{root}/{name}/{t}").agg(
            F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n_rows")
        )
        for t in tables
    ]
    return counts[0].unionByName(counts[1])


@query
def latest_snapshot(v):
    return S.latest_snapshot(v.blobs).select(
        "snapshot", F.date_format("last_modified", "yyyy-MM-dd HH:mm:ss").alias("last_modified")
    )


@query
def snapshot_times(v):
    return S.snapshot_times(v.blobs).select(
        "snapshot", F.date_format("last_modified", "yyyy-MM-dd HH:mm:ss").alias("last_modified")
    )


@query
def restore_snapshot(v):
    root = new_scratch_path(v.spark, "snapshots")
    indexed = v.vector_documents.drop("doc_id")
    S.write_snapshot({"documents": indexed, "folders": v.plain_folders}, root, "/corpus")
    S.write_snapshot({"documents": indexed.where("doc_type = 'pdf'")}, root, "/other")
    tables = S.restore_snapshot(v.spark, root, path="/corpus")
    fields = ["id", "name", "file_path", "hash", "summary"]
    one = lambda name: tables[name].select(
        F.lit(name).alias("table_name"), *fields,
        F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 4).alias("vector_sum"),
    )
    empty = tables["segments"].select(
        F.lit("segments"), "id", F.lit(""), F.lit(""), F.lit(""), "text", F.lit(0.0)
    )
    return one("documents").unionByName(one("folders")).union(empty)


@query
def reconcile_schema(v):
    grown = S.reconcile(v.table("documents").select("doc_id", "text"), DOCUMENTS)
    missing = [f.name for f in DOCUMENTS.fields]
    return grown.select(
        "doc_id", "text",
        sum((F.col(c).isNull().cast("int") for c in missing), F.lit(0)).alias("n_null"),
    )


@query
def reconcile_types(v):
    """Two stored versions of one table, the older with narrower types and without a nested
    field, read as what is declared now."""
    root = new_scratch_path(v.spark, "versions")
    docs = v.table("documents")
    older = docs.select(
        "doc_id", F.col("n_chars").cast("int").alias("n_chars"), F.struct("lang").alias("about"),
        F.array(F.struct((F.col("doc_id") % 7).cast("smallint").alias("day"))).alias("visits"),
    )
    newer = docs.select(
        (F.col("doc_id") + 1_000_000_000_000).alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"),
        F.struct("lang", "source").alias("about"),
        F.array(F.struct((F.col("doc_id") % 7).cast("long").alias("day"), F.lit("x").alias("by"))).alias("visits"),
    )
    versions = []
    for name, version in (("older", older), ("newer", newer)):
        version.write.parquet(f"{root}/{name}")
        versions.append(S.reconcile(v.spark.read.parquet(f"{root}/{name}"), newer.schema, refuse=True))
    visit = F.col("visits")[0]
    return versions[0].unionByName(versions[1]).select(
        "doc_id", "n_chars", F.col("about.lang").alias("lang"), F.col("about.source").alias("source"),
        visit["day"].alias("day"), visit["by"].alias("by_whom"),
    )


@query
def insert_object(v):
    stored = v.stored.select("id", "file_path", "hash")
    new = v.records.select("id", "file_path", "hash", "name")
    return O.insert(stored, new)


# --- filters and projections -----------------------------------------------------------


@query
def filter_filetypes(v):
    return v.files.where(P.has_file_type(F.col("name"))).select("path", "name")


@query
def filter_avoid_names(v):
    return v.files.where(~F.col("name").isin(*P.AVOID_NAMES)).select("path", "name")


@query
def filter_lock_files(v):
    return v.files.where(~P.is_lock_file(F.col("name"))).select("path", "name")


@query
def filter_ignored_dirs(v):
    return v.files.where(~C.ignored_folder(F.col("folder"), IGNORE)).select("path", "folder")


@query
def doc_type(v):
    return v.files.select("path", C.document_type(F.col("path")).alias("doc_type"))


@query
def folder_name(v):
    return v.tree.select("path", C.base_name(F.col("path")).alias("name"))


@query
def lookup_by_id(v):
    wanted = v.stored.select("id")
    return O.lookup(v.documents, ids=wanted).select("id", "file_path", "summary")


@query
def lookup_by_hash(v):
    wanted = v.stored.select("hash")
    return O.lookup(v.documents, hashes=wanted).select("id", "file_path", "hash", "name", "summary")


@query
def lookup_by_path(v):
    wanted = v.stored.select("file_path")
    return O.lookup(v.documents, paths=wanted).select("id", "file_path", "hash", "name", "summary")


@query
def segments_of_document(v):
    toxic = v.table("labels").where("toxic = 1").select("doc_id")
    owners = v.records.join(toxic, "doc_id", "left_semi")
    return O.segments_of(v.segments, owners).select("id", "document_id")


@query
def nonempty_summaries(v):
    summary = F.when(F.col("doc_type") == "xlsx", "").when(F.col("doc_type") != "pdf", F.col("summary"))
    return O.nonempty_summaries(v.documents.withColumn("summary", summary)).select("id", "summary")


@query
def filter_segment_quality(v):
    return O.keep_substantial(v.segments, "text").select("id", "text")


@query
def drop_rejected_ids(v):
    rejected = F.when(C.is_substantial(F.col("text")), F.col("id"))
    return O.drop_rejected(v.segments.withColumn("id", rejected), "id").select("id", "document_id")


@query
def skip_spreadsheet_segments(v):
    counts = v.segments.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return v.records.join(counts, "id", "left").groupBy("doc_type").agg(
        F.sum(F.coalesce("n", F.lit(0))).alias("n_segments")
    )


@query
def list_documents(v):
    return O.list_documents(v.documents, v.segments).select(
        "id", "name", "file_path", "hash", "summary", "created_ms", joined("segments").alias("segments")
    )


@query
def list_folders(v):
    return O.list_folders(v.plain_folders, v.index_documents).select(
        "id", "name", "file_path", "summary", "created_ms", "page",
        joined("documents").alias("documents"), joined("folders").alias("folders"),
    )


@query
def list_segments(v):
    return O.list_segments(v.segments, v.index_documents)


@query
def list_segments_limited(v):
    return O.list_segments(v.segments, v.index_documents, limit=1000)


@query
def flatten_documents(v):
    return O.flat_documents(O.search_documents(v.queries, v.vector_documents))


@query
def flatten_folders(v):
    return O.flat_folders(O.search_folders(v.queries, v.plain_folders, v.index_documents))


@query
def flatten_segments(v):
    return O.flat_segments(O.search_segments(v.queries, v.vector_segments, v.index_documents))


# --- joins -----------------------------------------------------------------------------


@query
def join_segment_document(v):
    owners = v.records.where(~F.col("doc_type").isin("pdf"))
    return O.segment_documents(v.segments, owners).select("id", "document_id", "document")


@query
def join_folder_documents(v):
    pages = O.child_pages(v.index_documents, "folder", ["name", "summary", "file_path"], "documents")
    return pages.select(
        "folder", "page", joined("documents.name").alias("names"),
        joined("documents.summary").alias("summaries"), joined("documents.file_path").alias("paths"),
    )


@query
def join_folder_subfolders(v):
    below = v.plain_folders.where(F.col("parent").isNotNull())
    pages = O.child_pages(below, "parent", ["name", "file_path"], "folders")
    return v.plain_folders.select("file_path").join(
        pages.withColumnRenamed("parent", "file_path"), "file_path", "left"
    ).select("file_path", joined("folders.name").alias("names"), joined("folders.file_path").alias("paths"))


@query
def link_document_segments(v):
    linked = O.linked_documents(v.records.select("id", "name"), v.segments)
    return linked.select("id", "name", joined("segments").alias("segments"))


@query
def unchanged_documents(v):
    return O.unchanged_documents(v.scan, v.stored).select("path", "hash", "id")


@query
def changed_or_new_documents(v):
    return O.changed_or_new(v.scan, v.stored).select("path", "hash")


@query
def stale_documents(v):
    return O.stale_rows(O.changed_or_new(v.scan, v.stored), v.stored).select("id", "file_path", "hash")


def _stale(v: Views) -> DataFrame:
    return O.stale_rows(O.changed_or_new(v.scan, v.stored), v.stored)


@query
def cascade_delete(v):
    documents, segments = O.cascade_delete(v.stored, v.stored_segments, _stale(v))
    kept = segments.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_segments"))
    return documents.join(kept.withColumnRenamed("document_id", "id"), "id", "left").select(
        "id", "file_path", F.coalesce("n_segments", F.lit(0)).alias("n_segments")
    )


@query
def cascade_delete_segments(v):
    _, segments = O.cascade_delete(v.stored, v.stored_segments, _stale(v))
    return segments.select("id", "document_id", "ord", "text")


def _fresh_folders(v: Views) -> DataFrame:
    return O.rollup(v.tree, v.index_documents, now_ms=F.lit(0).cast("long"))


def _older_folders(fresh: DataFrame) -> DataFrame:
    """The folder table of an older run: other content below ``de``, no record of ``es``
    folders, and one folder that is gone per source."""
    hash_ = F.when(F.col("name") == "de", F.concat(F.lit("old-"), "hash")).otherwise(F.col("hash"))
    here = fresh.where(F.col("name") != "es").withColumn("hash", hash_)
    gone = fresh.where(F.col("depth") == 2).withColumns(
        {"file_path": F.concat("file_path", F.lit("/gone")), "hash": F.concat(F.lit("gone-"), "hash")}
    )
    return here.unionByName(gone).withColumn("id", C.folder_id(F.col("hash")))


@query
def stale_folders(v):
    fresh = _fresh_folders(v)
    return O.stale_folders(fresh, _older_folders(fresh)).select("id", "file_path", "hash")


@query
def query_corpus_pairs(v):
    """Every query vector against every corpus vector, batch by batch: the way taken for
    more queries than are broadcast."""
    corpus = v.vectors.select(F.col("doc_id").cast("string").alias("id"), "vector")
    return O.nearest(v.queries, corpus, k=15, max_queries=4)


# --- aggregations ----------------------------------------------------------------------


@query
def count_items(v):
    return O.count_items(v.accepted, "/corpus")


@query
def folder_sum_text(v):
    return O.summary_text_parts(v.children)


@query
def folder_children(v):
    return O.with_children(v.plain_folders, v.index_documents)


@query
def collect_doc_ids(v):
    return O.folder_document_ids(v.index_documents).select("folder", "page", joined("ids").alias("ids"))


@query
def folder_rollup(v):
    return _fresh_folders(v).select("id", "name", "file_path", "parent", "depth", "hash", "summary")


@query
def index_counts(v):
    return O.index_counts(O.classify(v.scan, v.stored))


@query
def classify_scan(v):
    return O.classify(v.scan, v.stored)


# --- ordered operators -----------------------------------------------------------------


def _units(v: Views) -> DataFrame:
    return v.table("documents").select(
        F.col("doc_id").cast("string").alias("path"), F.posexplode(C.split_lines(F.col("text")))
    ).toDF("path", "ord", "text")


@query
def drop_repeat_lines(v):
    return O.drop_repeat_units(_units(v))


@query
def join_broken_lines(v):
    return v.table("documents").select("doc_id", C.join_broken_lines(F.col("text")).alias("text"))


@query
def repair_extracted_text(v):
    return v.table("documents").select("doc_id", C.repair_text(F.col("text")).alias("text"))


@query
def extracted_texts(v):
    return v.texts.select("path", "text")


@query
def chunk_text(v):
    docs = spread(v.table("documents").select("doc_id", "text"), "doc_id")
    return O.chunk_text(docs)


@query
def document_segments(v):
    return v.segments.select("id", "document_id", "ord", "text")


@query
def chunk_conversations(v):
    """The same cut over another text source."""
    turns = spread(v.table("conversations"), "conv_id")
    return O.chunk_text(turns.select("conv_id", "turn", "text"))


@query
def topk_per_query(v):
    corpus = v.vectors.select(F.col("doc_id").cast("string").alias("id"), "vector")
    return O.nearest(v.queries, corpus, k=10)


# --- search ----------------------------------------------------------------------------


@query
def search_docs(v):
    return O.search_documents(v.queries, v.vector_documents)


@query
def search_folders(v):
    return O.search_folders(v.queries, v.plain_folders, v.index_documents).select(
        "query_id", "rank", "distance", "id", "name", "file_path", "summary", "page",
        joined("documents.name").alias("documents"), joined("documents.file_path").alias("document_paths"),
        joined("folders.name").alias("folders"),
    )


@query
def search_segments(v):
    return O.search_segments(v.queries, v.vector_segments, v.index_documents)


@query
def search_context(v):
    return O.search_context(v.queries, v.vector_segments, v.index_documents, word_budget=500)


@query
def search_answers(v):
    """The context of each query with an answer; the provider tells how long its prompt is."""

    @dataclass(frozen=True)
    class Length:
        def column(self, text: Column) -> Column:
            return F.concat(F.lit("A prompt of "), F.length(text).cast("string"))

    asked = v.queries.withColumn("question", F.concat(F.lit("What is topic "), "query_id", F.lit("?")))
    without = v.spark.range(1).select(
        F.lit(-1).cast("long").alias("query_id"), F.lit(None).cast("array<float>").alias("vector"),
        F.lit("No vector?").alias("question"),
    )
    asked = asked.unionByName(without)
    return O.search_context(
        asked, v.vector_segments, v.index_documents, word_budget=500, provider=Length()
    ).select("query_id", "n_segments", "answer")


@query
def search_ann(v):
    corpus = v.vectors.select(F.col("doc_id").cast("string").alias("id"), "vector")
    return O.nearest(v.queries, corpus, k=10, exact=False)


@query
def search_ann_stored(v):
    from shelfmark.operators.ann import nearest_stored, write_buckets

    path = new_scratch_path(v.spark, "buckets")
    write_buckets(v.vectors.select(F.col("doc_id").cast("string").alias("id"), "vector"), path)
    return nearest_stored(v.queries, path, k=10)


@query
def search_cells(v):
    """How well the inverted file finds: the first segment of every fiftieth document asks for its
    ten nearest among all segments, by words. Distances are those of the exact search."""
    vectors = materialise(O.embed(v.segments, "text").select("id", "doc_id", "ord", "vector"), "vectors")
    asked = vectors.where("doc_id % 50 = 0 AND ord = 0").select(F.col("doc_id").alias("query_id"), "vector")
    path = new_scratch_path(v.spark, "cells")
    O.write_cells(vectors, path)
    near = materialise(O.nearest(asked, vectors, k=10, cells=path, probes=16), "near")
    exact = materialise(O.nearest(asked, vectors, k=10, within=near), "exact")
    found = O.recall(exact, near)
    summed = exact.agg(F.round(F.sum("distance"), 3).alias("exact_distances"))
    return found.agg(F.count(F.lit(1)).alias("n_queries"), (F.sum("n_found") / F.sum("n") >= 0.9).alias("recall_reached")).join(
        summed, F.lit(True)
    )


@query
def search_texts(v):
    """Texts as queries over documents embedded by the default provider, as a user asks."""
    asked = O.embed(v.table("benchmark").withColumnRenamed("item_id", "query_id"), "text")
    documents = materialise(O.embed(v.documents, "summary"), "embedded")
    return O.search_documents(asked, documents).drop("created_ms")


@query
def limit_rows(v):
    return O.limit_rows(_units(v), 5000, "path", "ord")


@query
def sort_summaries(v):
    documents = v.index_documents.select("folder", F.lit(1).alias("kind_ord"), "id", "summary")
    return O.summary_text_parts(documents).select("folder", "part", "text")


# --- set operations --------------------------------------------------------------------


@query
def upsert_documents(v):
    new = O.lookup(
        v.records.select("id", "file_path", "hash"),
        hashes=O.changed_or_new(v.scan, v.stored),
    )
    return O.upsert(v.stored, new)


@query
def upsert_documents_pruned(v):
    new = O.lookup(
        v.records.select("id", "file_path", "hash"),
        hashes=O.changed_or_new(v.scan, v.stored),
    )
    return O.upsert(v.stored, new, v.scan)


@query
def upsert_folders(v):
    fresh = _fresh_folders(v)
    return O.upsert_folders(_older_folders(fresh), fresh).select("id", "file_path", "hash", "summary")


# --- scalar functions ------------------------------------------------------------------


@query
def document_hash(v):
    return v.accepted.select(
        "path", C.document_hash(F.col("path"), F.col("name"), F.col("text")).alias("hash")
    )


@query
def folder_hash(v):
    marks = O.content_marks(v.index_documents, "folder")
    return marks.select("folder", C.folder_hash(F.col("folder"), F.col("mark")).alias("hash"))


@query
def truncate_tokens(v):
    cut = C.truncate_words(F.col("text"))
    return v.table("documents").select("doc_id", cut.alias("cut")).select(
        "doc_id", F.col("cut.text").alias("text"), F.col("cut.truncated").alias("truncated")
    )


@query
def build_prompt(v):
    cut = C.truncate_words(F.col("text"), 400)
    rows = v.texts.select("path", "ext", cut.alias("cut"))
    return rows.select(
        "path",
        C.document_prompt(F.col("ext"), F.col("cut.text"), F.col("cut.truncated")).alias("prompt"),
    )


@query
def build_folder_prompt(v):
    texts = O.beginning_texts(v.index_documents, "folder")
    return texts.select("folder", C.folder_prompt(C.truncate_words(F.col("text"))["text"]).alias("prompt"))


@query
def summary_or_default(v):
    from shelfmark.functions.text import NO_DOCUMENT_SUMMARY

    failed = F.when(F.length("text") > 200, F.col("text"))
    return v.table("conversations").select(
        "conv_id", "turn", C.summary_or_default(failed, NO_DOCUMENT_SUMMARY).alias("summary")
    )


@query
def embedding_input(v):
    summary = F.when(F.col("doc_type") == "xlsx", "").when(F.col("doc_type") != "pdf", F.col("summary"))
    return v.documents.select("id", C.embedding_input(summary, F.col("name")).alias("text"))


@query
def json_flag(v):
    """The verdict as a model would return it; some answers lack it, some are no JSON."""
    answer = (
        F.when(F.col("event_type") == "error", "no verdict")
        .when(F.col("event_type") == "view", F.col("props"))
        .otherwise(F.format_string('{"meaningful": %s}', (F.col("value") > 10).cast("string")))
    )
    return v.table("events").select("event_id", C.json_flag(answer).alias("meaningful"))


@query
def json_number(v):
    """The same reader on the numbers in ``props``: any but 0 counts as true."""
    return v.table("events").select("event_id", C.json_flag(F.col("props"), "k").alias("flag"))


@query
def snapshot_id(v):
    return v.table("pages").select(
        "page_id",
        C.snapshot_name(F.col("url"), F.lit("2024-05-06").cast("date"), F.col("page_id").cast("string")).alias("id"),
    )


@query
def split_lines(v):
    return _units(v)


@query
def break_to_html(v):
    return v.table("documents").select("doc_id", C.break_to_html(F.col("text")).alias("html"))


@query
def cosine_distance(v):
    """Each stored vector against the mean of its label."""
    vectors = v.table("embeddings").withColumn("query_id", F.col("label").cast("long"))
    return vectors.join(v.queries, "query_id").select(
        "vec_id", F.round(C.cosine_distance(F.col("embedding"), F.col("vector")), 6).alias("distance")
    )


# --- enrichment ------------------------------------------------------------------------


@query
def embed(v):
    docs = spread(v.table("documents").select("doc_id", "text"), "doc_id")
    return O.embed(docs, "text").select("doc_id", "vector")


@query
def summarise(v):
    done = O.summarise(v.table("documents"), "text", message="no summary")
    return done.select("doc_id", "summary")


@dataclass(frozen=True)
class ShortTexts:
    """Answers with the text itself where it is short."""

    limit: int

    def column(self, text: Column) -> Column:
        return F.when(F.length(text) <= self.limit, text)


@query
def fallback_chain(v):
    first = O.LeadSummary("Lines: ", 5)

    @dataclass(frozen=True)
    class OneLine:
        def column(self, text: Column) -> Column:
            return F.when(~F.contains(text, F.lit("\n")), first.column(text))

    turns = v.table("conversations")
    done = O.fallback(turns, "text", [ShortTexts(120), OneLine()], "answer", "no answer")
    return done.select("conv_id", "turn", "answer")


@query
def classify_segments(v):
    def load():
        return lambda texts: [any(end in t for end in ".!?") for t in texts]

    return O.classify_segments(v.segments, O.BatchModel(load, "boolean"), "text").select("id", "meaningful")


# --- a whole run -----------------------------------------------------------------------


@query
def run_index(v):
    """A first index run and its documents, as a user of the package would run it."""
    from shelfmark.plans import Settings
    from shelfmark.plans import run_index as run

    tables = run(v.accepted, settings=Settings(root="/corpus", now_ms=F.lit(0).cast("long")))
    return tables["documents"].select("id", "name", "file_path", "folder", "doc_type", "hash", "summary")


@query
def run_index_models(v):
    """A run with a chat model, an embedding model and a segment check, all of them Python."""
    from shelfmark.plans import Settings
    from shelfmark.plans import run_index as run

    def chat():
        return lambda texts: [f"Of {len(t)} characters" for t in texts]

    def vectors():
        return lambda texts: [[float(len(t)), float(sum(c == "e" for c in t))] for t in texts]

    def check():
        return lambda texts: [len(t) % 3 != 0 for t in texts]

    model = O.BatchModel(chat)
    tables = run(v.accepted, settings=Settings(
        root="/corpus", now_ms=F.lit(0).cast("long"), document_summaries=(model,), folder_summaries=(model,),
        vectors=O.BatchModel(vectors, "array<float>"), check_segments=True, segment_check=O.BatchModel(check, "boolean"),
    ))
    segments = tables["segments"].groupBy(F.col("document_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_segments"), F.sum(F.get("vector", F.lit(0))).alias("n_chars")
    )
    return tables["documents"].join(segments, "id", "left").select(
        "id", "file_path", "summary", F.get("vector", F.lit(0)).cast("double").alias("v0"),
        F.get("vector", F.lit(1)).cast("double").alias("v1"),
        F.coalesce("n_segments", F.lit(0)).alias("n_segments"), F.coalesce("n_chars", F.lit(0.0)).alias("n_chars"),
    )


@query
def refresh_index(v):
    """A run over an older state, then one over all files as they are: labelled documents
    were there, those of low quality with other text."""
    from shelfmark.plans import Settings
    from shelfmark.plans import run_index as run

    settings = Settings(root="/corpus", now_ms=F.lit(0).cast("long"))
    older = v.accepted.join(v.table("labels"), "doc_id").withColumn(
        "text", F.when(F.col("quality") == 0, F.concat(F.lit("Older.\n"), "text")).otherwise(F.col("text"))
    ).select(v.accepted.columns)
    tables = run(v.accepted, run(older, settings=settings), settings)
    counts = tables["segments"].groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return tables["documents"].join(counts, "id", "left").select(
        "id", "name", "file_path", "hash", "summary", F.coalesce("n", F.lit(0)).alias("n_segments")
    )


@query
def refresh_snapshot(v):
    """A snapshot of an older state, refreshed by a layer of what changed since, and restored."""
    from shelfmark.plans import Settings, index_to_snapshot
    from shelfmark.plans import refresh_snapshot as refresh

    settings, root = Settings(root="/corpus", now_ms=F.lit(0).cast("long"), prune=True), new_scratch_path(v.spark, "snapshots")
    # Every fifth file had other text, every seventh was not there, and one in eleven has gone since.
    older = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Older.\n"), "text")).otherwise(F.col("text"))
    moved = F.when(F.col("doc_id") % 11 == 0, F.concat("folder", F.lit("/old"))).otherwise(F.col("folder"))
    files = v.accepted.where("doc_id % 7 <> 0").withColumns({"text": older, "folder": moved}).withColumn(
        "path", F.concat("folder", F.lit("/"), "name")
    )
    first = index_to_snapshot(files.select(v.accepted.columns), root, "/corpus", settings=settings)
    tables = S.restore_snapshot(v.spark, root, refresh(v.accepted, root, "/corpus", settings))
    assert first != S.newest_snapshot(v.spark, root)
    counts = tables["segments"].groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    folders = tables["folders"].select("id", "name", "file_path", "hash", "summary", F.lit(None).cast("long").alias("n_segments"))
    return tables["documents"].join(counts, "id", "left").select(
        "id", "name", "file_path", "hash", "summary", F.coalesce("n", F.lit(0)).alias("n_segments")
    ).unionByName(folders)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: fn(Views(spark, sf_dir))

    return {name: bind(fn) for name, fn in REGISTRY.items()}
