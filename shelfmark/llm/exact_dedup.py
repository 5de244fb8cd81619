"""Exact duplicates by sorting contents: equal texts become neighbours and are compared in full.

The texts are dealt by value ranges between sampled splitters and sorted externally, so equal
texts end up next to each other in one partition. A splitter is the beginning of a text and a
hash of it, so the sample that Spark draws stays small and texts that only begin alike are
still dealt apart; within a run of equal texts the first row
in identifier order stays. A text with so many copies that its run would fill more than a part
of one task (``HOT_SHARE``) is not sorted at all: its copies are grouped where they are read
(one row per text and map task crosses the network) and the result is joined back by digest.
DataFrame functions only.

Cases: a null text equals the empty text. A null identifier is smaller than any other. Rows
that repeat identifier and text count in ``group_size``, and exactly one of them is kept. Very
long texts are compared whole; their copies are hot by their characters. An empty table gives an empty table. Other columns are passed through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.common import fresh
from shelfmark.runtime import materialise, small

# Characters of a text in a splitter.
HEAD_CHARS = 24
# A text is hot if its copies hold this share of the rows or the characters of one of the sort's
# tasks, or more.
HOT_SHARE = 0.25
# Below these no text is hot: so short a run costs nothing.
HOT_LEAST = 500
HOT_LEAST_CHARS = 16 << 20
# Hot texts are broadcast up to this many, and else joined.
MAX_HOT = 200_000
# Rows of a hot text that tie for staying are numbered in so many slices first.
TIE_SLICES = 64


def _hot_digests(contents: DataFrame, content: str, n_tasks: int) -> DataFrame | None:
    """64-bit digests of the texts with too many copies for one task, as a stored table.

    Counts over sixteen bytes a row, combined on the map side. At most ``2 * n_tasks / HOT_SHARE``
    digests can pass the thresholds.
    """
    size = F.length(content).cast("long")
    total, chars = contents.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    least = max(HOT_LEAST, int(total / n_tasks * HOT_SHARE))
    least_chars = max(HOT_LEAST_CHARS, int(chars / n_tasks * HOT_SHARE))
    if total <= least and chars <= least_chars:
        return None
    counts = contents.groupBy(F.xxhash64(content).alias("hot")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("chars"))
    hot = counts.where((F.col("n") > least) | ((F.col("n") > 1) & (F.col("chars") > least_chars)))
    hot = materialise(hot.select("hot"), "hot")
    return small(hot, MAX_HOT) if hot.head(1) else None


def mark_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "smallest",
    normalise=lambda text: text,
) -> DataFrame:
    """``docs`` with a column ``dedup`` struct<keep_id, group_size, kept, text_sha256>.

    ``keep`` says which identifier of equal texts stays, ``smallest`` or ``largest``;
    ``normalise`` maps the text column to what is compared. If ``docs`` has a column ``dedup``
    the new one is ``_dedup``.
    """
    out, was_null, content, hot, first, head, mark, tie, nth = fresh(
        docs, "dedup", "was_null", "content", "hot", "first", "head", "mark", "tie", "nth"
    )
    spark = docs.sparkSession
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted: Column = F.col(id_col).desc_nulls_last() if keep == "largest" else F.col(id_col).asc_nulls_first()

    # An unchanged text is not carried twice: it is sorted in place, its nulls are remembered.
    as_is = normalise(F.col(text_col))
    plain = str(as_is) == str(F.col(text_col))
    if plain:
        content = text_col
        work = docs.withColumn(was_null, F.col(text_col).isNull()).withColumn(
            text_col, F.coalesce(F.col(text_col), F.lit(""))
        )
    else:
        work = docs.withColumn(content, F.coalesce(normalise(F.coalesce(F.col(text_col), F.lit(""))), F.lit("")))

    sha = F.sha2(F.col(content), 256)
    hot_table = _hot_digests(work.select(content), content, n_tasks)
    rest = work
    if hot_table is not None:
        hot_table = hot_table.withColumnRenamed("hot", hot)
        flag = F.xxhash64(content) == F.col(hot)
        rest = work.join(hot_table, flag, "left_anti")

    # The range partitioning satisfies the window: one shuffle, one external sort by content.
    run = W.partitionBy(head, mark, content)
    order = run.orderBy(wanted)
    everything = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    headed = rest.withColumns({head: F.substring(content, 1, HEAD_CHARS), mark: F.xxhash64(content)})
    sorted_rows = headed.repartitionByRange(n_tasks, head, mark).select(
        *work.columns,
        F.struct(
            F.first(id_col).over(everything).alias("keep_id"),
            F.count(F.lit(1)).over(everything).alias("group_size"),
            (F.row_number().over(order) == 1).alias("kept"),
            sha.alias("text_sha256"),
        ).alias(out),
    )
    marked = sorted_rows
    if hot_table is not None:
        copies = work.join(hot_table, flag, "left_semi")
        totals = copies.groupBy(F.col(content).alias("content")).agg(
            # Nulls are the smallest identifiers: they stay if the smallest is wanted.
            F.when(F.lit(keep == "smallest") & (F.count(id_col) < F.count(F.lit(1))), F.lit(None))
            .otherwise(F.min(id_col) if keep == "smallest" else F.max(id_col)).alias("keep_id"),
            F.count(F.lit(1)).alias("group_size"),
        ).select(F.sha2("content", 256).alias("text_sha256"), "keep_id", "group_size")
        totals = small(materialise(totals.select(F.struct("*").alias(first)), "totals"), MAX_HOT)
        joined = copies.join(totals, sha == F.col(f"{first}.text_sha256"))
        is_best = F.col(id_col).eqNullSafe(F.col(f"{first}.keep_id"))
        # Only rows with the best identifier are numbered: one per text, unless rows repeat.
        def pack(rows: DataFrame, kept: Column) -> DataFrame:
            return rows.select(*work.columns, F.struct(
                F.col(f"{first}.keep_id").alias("keep_id"), F.col(f"{first}.group_size").alias("group_size"),
                kept.alias("kept"), F.col(f"{first}.text_sha256").alias("text_sha256"),
            ).alias(out))
        # Ties are numbered in slices, then the first rows of the slices among themselves.
        tied = joined.where(is_best).withColumn(tie, F.pmod(F.monotonically_increasing_id(), F.lit(TIE_SLICES)))
        slices = W.partitionBy(f"{first}.text_sha256", tie).orderBy(F.lit(1))
        tied = tied.withColumn(nth, F.row_number().over(slices))
        group = F.when(F.col(nth) == 1, F.lit(-1)).otherwise(F.col(tie))
        among = W.partitionBy(f"{first}.text_sha256", group).orderBy(nth, tie)
        one = (F.col(nth) == 1) & (F.row_number().over(among) == 1)
        marked = marked.unionByName(pack(joined.where(~is_best), F.lit(False))).unionByName(pack(tied, one))
    if plain:
        marked = marked.withColumn(text_col, F.when(~F.col(was_null), F.col(text_col)))
    return marked.select(*docs.columns, out)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text another row keeps; same columns."""
    marked = mark_duplicates(docs, id_col, text_col, **options)
    out = marked.columns[-1]
    return marked.where(F.col(f"{out}.kept")).select(*docs.columns)
