"""Collecting the rows of a group without ever holding an unbounded group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.runtime import bounded_rows, materialise

PAGE_SIZE = 4096
HOT_KEY_LIMIT = 10_000


def hot_keys(df: DataFrame, key: str, threshold: int) -> DataFrame | None:
    """(key, n) of the keys with more than ``threshold`` rows, or None if there are none.

    Runs one counting job over the key column. Up to ``HOT_KEY_LIMIT`` hot keys come back
    as a broadcast table; more than that stay a distributed one, for Spark to join by size.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > threshold)
    rows = bounded_rows(counts, HOT_KEY_LIMIT)
    if rows is None:
        return counts
    if not rows:
        return None
    return F.broadcast(df.sparkSession.createDataFrame(rows, counts.schema))


def page_of(ident: Column, n: Column, page_size: int = PAGE_SIZE) -> Column:
    """The page of a child among ``n``: empty if all fit on one page, else the first hex
    digits of its digest, as many as bring pages down to ``page_size`` on average."""
    digits = F.length(F.hex(F.floor(n / page_size).cast("long")))
    return F.when(n > page_size, F.substring(ident, F.lit(1), digits)).otherwise("")


def child_pages(
    children: DataFrame, key: str, fields: Sequence[str], out: str, page_size: int = PAGE_SIZE
) -> DataFrame:
    """(key, page, out array<struct<id, fields>>): the children of each key, by id.

    ``children`` has an ``id`` that is a hex digest, so its leading digits split a key of
    any size evenly. A key with up to ``page_size`` children has the one page ``''``.
    """
    narrow = children.select(key, "id", *fields)
    hot = hot_keys(narrow, key, page_size)
    if hot is None:
        paged = narrow.withColumn("page", F.lit(""))
    else:
        paged = narrow.join(hot, key, "left").withColumn(
            "page", F.coalesce(page_of(F.col("id"), F.col("n"), page_size), F.lit(""))
        )
    items = F.array_sort(F.collect_list(F.struct("id", *fields)))
    return paged.groupBy(key, "page").agg(items.alias(out))


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``rn``, the 1-based place of a row in its group, and ``n``, the group size.

    A range sort on (group, order) spreads even one giant group over all tasks; the places
    come from the row position within a partition and the sizes of the partitions before
    it. ``order`` should be unique in a group, or equal rows cannot be spread.
    """
    keys = [*group, *order]
    placed = materialise(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id()),
        "numbered",
    )
    pieces = placed.groupBy(*group, "_part").agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_size")
    )
    # One row per group and partition: a group has at most as many as there are partitions.
    # Stored, so that its size decides how it is joined and the rows mostly stay in place.
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = pieces.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_part").alias("_p"),
        "_first",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.sum("_size").over(W.partitionBy(*group)).alias("n"),
    )
    offsets = materialise(offsets, "offsets")
    same = placed["_part"] == offsets["_p"]
    for i, g in enumerate(group):
        same = same & placed[g].eqNullSafe(offsets[f"_g{i}"])
    return placed.join(offsets, same).select(
        *df.columns,
        (F.col("_pos") - F.col("_first") + F.col("_before") + 1).alias("rn"),
        "n",
    )
