"""The folder tree: ancestors, and summaries rolled up from the leaves to the root.

A folder's text is the sorted summaries of its subfolders, joined, then those of its
documents, joined. Two forms of it:

* :func:`summary_text_parts` gives the whole text of any folder, in ordered parts, however
  many children it has.
* :func:`rollup` needs its content hash, made from an order-free digest over all summaries, and
  its first words up to the word budget, as input for the summary. Summaries have a word each
  at least, so as many summaries as the budget has words hold that beginning. Both rules are
  the same for a folder of any size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.functions.paths import ancestor_paths, base_name, parent_path
from shelfmark.functions.text import (
    FOLDER_INSTRUCTIONS, FOLDER_OPENING, NO_FOLDER_SUMMARY, SUMMARY_SEPARATOR, WORD_BUDGET, embedding_input, folder_hash, folder_id,
    folder_prompt, truncate_words,
)
from shelfmark.operators.enrich import SUMMARY_WORDS, KeySentences, Provider, embed, summarise
from shelfmark.operators.grouping import hot_keys, number_rows
from shelfmark.runtime import materialise, small
from shelfmark.schema import FOLDERS, VECTOR

PART_SIZE = 1000
EMPTY_FOLDER = f"{FOLDER_OPENING}is empty"


def ancestors(files: DataFrame, root: str = "") -> DataFrame:
    """(path, name, parent, depth) of every folder at or below ``root`` that holds a file.

    ``depth`` counts from the root, which has 1 and no parent.
    """
    top = root.rstrip("/")
    paths = files.select("folder").distinct().select(
        F.explode(ancestor_paths(F.col("folder"))).alias("path")
    )
    if top:
        paths = paths.where((F.col("path") == top) | F.col("path").startswith(f"{top}/"))
    above_root = top.count("/")
    depth = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit(""))) - above_root + (
        1 if top else 0
    )
    parent = parent_path(F.col("path"))
    return paths.distinct().select(
        "path",
        base_name(F.col("path")).alias("name"),
        F.when(parent != top.rpartition("/")[0], parent).alias("parent"),
        depth.cast("int").alias("depth"),
    )


def count_items(files: DataFrame, root: str = "") -> DataFrame:
    """(n_files, n_folders): accepted files, and folders below the root."""
    n_files = files.agg(F.count(F.lit(1)).alias("n_files"))
    below = ancestors(files, root).where(F.col("parent").isNotNull())
    n_folders = below.agg(F.count(F.lit(1)).alias("n_folders"))
    return n_files.withColumn("_one", F.lit(1)).join(n_folders.withColumn("_one", F.lit(1)), "_one").drop("_one")


def with_children(folders: DataFrame, documents: DataFrame) -> DataFrame:
    """(path, n_documents, n_folders) of folders that hold at least one of either."""
    in_docs = documents.groupBy(F.col("folder").alias("path")).agg(F.count(F.lit(1)).alias("n_documents"))
    in_folders = (
        folders.where(F.col("parent").isNotNull())
        .groupBy(F.col("parent").alias("path"))
        .agg(F.count(F.lit(1)).alias("n_folders"))
    )
    counts = in_docs.join(in_folders, "path", "full").na.fill(0)
    return counts.where(F.col("n_documents") + F.col("n_folders") > 0)


def nonempty_summaries(records: DataFrame) -> DataFrame:
    return records.where(F.coalesce(F.col("summary"), F.lit("")) != "")


# --- whole text, in parts --------------------------------------------------------------


def summary_text_parts(children: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """(folder, kind_ord, part, text) from children (folder, kind_ord, id, summary).

    Parts in (kind_ord, part) order, put together, are the folder's whole text. Subfolders
    have ``kind_ord`` 0 and come first. No separator stands between the two kinds.
    """
    numbered = number_rows(
        nonempty_summaries(children).select("folder", "kind_ord", "summary", "id"),
        ["folder", "kind_ord"],
        ["summary", "id"],
    )
    ending = F.when(F.col("rn") < F.col("n"), SUMMARY_SEPARATOR).otherwise("")
    pieces = F.array_sort(F.collect_list(F.struct("rn", F.concat("summary", ending).alias("text"))))
    return (
        numbered.withColumn("part", F.floor((F.col("rn") - 1) / part_size).cast("long"))
        .groupBy("folder", "kind_ord", "part")
        .agg(pieces.alias("pieces"))
        .select("folder", "kind_ord", "part", F.array_join(F.col("pieces.text"), "").alias("text"))
    )


# --- digest and beginning, per folder ---------------------------------------------------

# Hex digits in each of the four lanes that a SHA-256 digest is summed in.
_LANE = 15


def content_marks(children: DataFrame, key: str) -> DataFrame:
    """(key, mark): a digest over all non-empty summaries of each key, whatever their order.

    Sums of digest lanes, so it is combined where the summaries are read.
    """
    digest = F.sha2("summary", 256)
    lanes = [
        F.sum(F.conv(F.substring(digest, 1 + _LANE * i, _LANE), 16, 10).cast("decimal(38,0)")).alias(f"_lane{i}")
        for i in range(4)
    ]
    sums = nonempty_summaries(children).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *lanes)
    return sums.select(key, F.concat_ws(":", "_n", *[F.col(f"_lane{i}") for i in range(4)]).alias("mark"))


def beginning_texts(
    children: DataFrame, key: str, n_words: int = WORD_BUDGET, hot: DataFrame | None | str = "count"
) -> DataFrame:
    """(key, text): the first ``n_words`` words, at least, of the sorted summaries of each key.

    Of a key with more summaries than that only the first ``n_words`` in order, and one more for
    the separator after them, are collected; ``hot`` are those keys where the caller has counted already.
    """
    rows = children.where(F.trim(F.coalesce("summary", F.lit(""))) != "").select(key, "id", "summary")
    text = F.array_join(F.array_sort(F.collect_list("summary")), SUMMARY_SEPARATOR).alias("text")
    if isinstance(hot, str):
        hot = hot_keys(rows, key, n_words)
    if hot is None:
        return rows.groupBy(key).agg(text)
    few = rows.join(hot, key, "left_anti").groupBy(key).agg(text)
    many = number_rows(rows.join(hot.select(key), key, "left_semi"), [key], ["summary", "id"])
    return few.unionByName(many.where(F.col("rn") <= n_words + 1).groupBy(key).agg(text))


def rollup(
    folders: DataFrame,
    documents: DataFrame,
    stored: DataFrame | None = None,
    providers: Sequence[Provider] = (KeySentences(FOLDER_OPENING),),
    vectors: Provider | None = None,
    prompts: bool = False,
    now_ms: Column | None = None,
    word_budget: int = WORD_BUDGET,
    summary_words: int = SUMMARY_WORDS,
    instructions: str = FOLDER_INSTRUCTIONS,
) -> DataFrame:
    """Folder records, leaves first: each level is summarised from the level below it.

    ``folders`` is (path, name, parent, depth), ``documents`` has (folder, id, summary).
    There is one pass per level of the tree, over that level's folders only; documents are
    grouped once, before. With ``stored``, each level reads the summaries of documents once more, for
    its folders whose hash is new; the digests of all are sums, combined where they are read. Every level is written to the shared folder, so the lineage stays
    one level deep. A folder whose hash is in ``stored`` keeps the stored record, and no
    provider is called for it. Providers get the first ``word_budget`` words of a folder's
    text or, with ``prompts``, ``instructions`` and these.
    """
    now_ms = F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms

    def marks(children: DataFrame, key: str, name: str) -> DataFrame:
        return content_marks(children, key).select(F.col(key).alias("path"), F.col("mark").alias(name))

    def texts(children: DataFrame, key: str, name: str, hot="count") -> DataFrame:
        return beginning_texts(children, key, word_budget, hot).select(F.col(key).alias("path"), F.col("text").alias(name))

    base = folders.join(marks(documents, "folder", "_dm"), "path", "left")
    if stored is None:
        base = base.join(texts(documents, "folder", "_dt"), "path", "left")
    base = materialise(base, "folders")
    deepest = base.agg(F.max("depth")).first()[0] or 0
    crowded = hot_keys(base.where(F.col("parent").isNotNull()), "parent", word_budget) if stored is None else None

    levels: list[DataFrame] = []
    below: DataFrame | None = None
    for depth in range(deepest, 0, -1):
        level = base.where(F.col("depth") == depth)
        if below is None:
            level = level.withColumn("_fm", F.lit(""))
        else:
            level = level.join(marks(below, "parent", "_fm"), "path", "left")
        level = level.na.fill("", ["_fm", "_dm"]).withColumn("hash", folder_hash(F.col("path"), F.concat_ws("|", "_fm", "_dm")))
        known = None if stored is None else stored.where(F.col("depth") == depth)
        if known is None:
            under = None if below is None else texts(below, "parent", "_ft", crowded)
        else:
            # Texts only of the folders that are not stored as they are.
            level = materialise(level, "level")
            asked = small(materialise(level.join(known.select("hash"), "hash", "left_anti").select("path"), "asked"))
            of_asked = lambda df, key: df.join(asked.withColumnRenamed("path", key), key, "left_semi")  # noqa: B023, E731
            level = level.join(texts(of_asked(documents, "folder"), "folder", "_dt"), "path", "left")
            under = None if below is None else texts(of_asked(below, "parent"), "parent", "_ft")
        level = level.withColumn("_ft", F.lit("")) if under is None else level.join(under, "path", "left")
        level = level.na.fill("", ["_ft", "_dt"])
        level = level.withColumns({
            "_text": truncate_words(F.concat("_ft", "_dt"), word_budget)["text"],
        }).drop("_ft", "_fm", "_dt", "_dm")
        below = materialise(_summarised(level, known, providers, instructions if prompts else None, now_ms, summary_words), f"level{depth}")
        levels.append(below)
    if not levels:
        return folders.sparkSession.createDataFrame([], FOLDERS)
    return _with_vectors(reduce(DataFrame.unionByName, levels), vectors)


def _summarised(level, stored, providers, instructions, now_ms, summary_words) -> DataFrame:
    """Records of one level; a summary is asked for only where the hash is not stored yet.

    New records have no vector so far. A provider gets null, and skips it, for known folders.
    """
    fields = ("id", "summary", "vector", "created_ms")
    if stored is None:
        level = level.withColumns({"_id": F.lit(None).cast("string"), "_summary": F.lit(None).cast("string"),
                                   "_vector": F.lit(None).cast(VECTOR), "_created_ms": F.lit(None).cast("long")})
    else:
        known = stored.select("hash", *[F.col(c).alias(f"_{c}") for c in fields]).dropDuplicates(["hash"])
        level = level.join(known, "hash", "left")
    text = F.col("_text") if instructions is None else folder_prompt(F.col("_text"), instructions)
    level = level.withColumn("_asked", F.when(F.col("_id").isNull(), text))
    done = summarise(level, "_asked", providers, max_words=summary_words)
    missing = F.when(F.trim("_text") == "", EMPTY_FOLDER).otherwise(NO_FOLDER_SUMMARY)
    fresh = F.col("_id").isNull()
    return done.select(
        F.coalesce("_id", folder_id(F.col("hash"))).alias("id"), "name", F.col("path").alias("file_path"), "parent",
        "depth", "hash", F.when(fresh, F.coalesce("summary", missing)).otherwise(F.col("_summary")).alias("summary"),
        F.col("_vector").alias("vector"), F.when(fresh, now_ms).otherwise(F.col("_created_ms")).alias("created_ms"),
    )


def _with_vectors(records: DataFrame, vectors: Provider | None) -> DataFrame:
    """Vectors for the records that have none: summaries of all levels in one pass."""
    bare = records.where(F.col("vector").isNull()).withColumn(
        "_embed", embedding_input(F.col("summary"), F.col("name"))
    )
    done = embed(bare.drop("vector"), "_embed", vectors).select(records.columns)
    return records.where(F.col("vector").isNotNull()).unionByName(done)


def stale_folders(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored folders whose path has another hash now. Their documents are not touched."""
    now = fresh.select("file_path", F.col("hash").alias("_now"))
    return stored.join(now, "file_path").where(F.col("hash") != F.col("_now")).select(stored.columns)


def upsert_folders(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored folders that the run did not visit, and all visited ones as they are now."""
    unvisited = stored.join(fresh.select("file_path"), "file_path", "left_anti")
    return unvisited.select(fresh.columns).unionByName(fresh)
