"""Mixing sources to target weights with hash-threshold histograms.

Sizes are summed by source and leading hash bits; from the running sums comes the bucket in
which a source's budget ends. Only that bucket is summed again by the next bits, and what is
left of it, a few rows a source, by full hash. A document is taken once per full pass over its
source, and once more if its hash is at most the source's threshold: a filter, no sort. Budgets
are nested: a smaller budget takes a subset.

Cases: a null or empty text has size 0 and belongs to its source; its row stays, with 0 words
taken. A null source is a source of its own, last. Equal rows have equal hashes and are taken
together. A source without words gets target 0. An empty table gives an empty table. Columns
other than identifier, text and source are ignored by ``mix_sources`` and kept by
``take_mixture``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.common import WORD, fresh, keyed, text_of
from shelfmark.operators.grouping import number_rows
from shelfmark.runtime import materialise, small

# Bits of the hash, and of a bucket at each of the two histogram levels.
HASH_BITS, LEVEL_BITS = 60, 12
MAX_PASSES = 2
WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # the mixture's size as a fraction of all sizes


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def document_hash60(ident: Column, text: Column) -> Column:
    """60 bits of an md5 over identifier and text."""
    joined = F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit("\x1f"), text)
    return F.conv(F.substring(F.md5(joined), 1, HASH_BITS // 4), 16, 10).cast("long")


def _targets(sources: DataFrame, weights: tuple[int, ...], share: tuple[int, int]) -> DataFrame:
    """(key, source_size, target): budgets by weight, none above ``MAX_PASSES`` sizes.

    Filling up: with level L a source gets min(cap, L * weight). Sources whose cap binds are
    fixed and the rest is shared again, until no more cap binds. Each step is one small sum;
    nothing but two numbers comes to the driver.
    """
    cycle = F.element_at(F.array(*map(F.lit, weights)), (((F.col("rn") - 1) % len(weights)) + 1).cast("int"))
    ranked = number_rows(sources.withColumn("all", F.lit(0)), ["all"], ["key"]).select(
        "key", "source_size", cycle.cast("double").alias("weight"),
        (F.col("source_size") * MAX_PASSES).cast("double").alias("cap"),
    )
    ranked = materialise(ranked, "mix-sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget, level = total * share[0] / share[1], 0.0
    while True:
        binds = F.col("cap") <= F.col("weight") * F.lit(level)
        capped, free = ranked.agg(
            F.coalesce(F.sum(F.when(binds, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~binds, F.col("weight"))), F.lit(0.0)),
        ).first()
        raised = (budget - capped) / free if free else level
        if raised <= level:
            break
        level = raised
    # Products in this order are the same doubles in any engine.
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level))
    return ranked.select("key", "source_size", target.alias("target"))


def _crossing(sums: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The first bucket of each key in which the running size passes what is still wanted.

    ``sums`` has key, ``at``, size and want; gives key, ``at`` and want less what lies before.
    """
    run = W.partitionBy(*keys).orderBy(at)
    upto = F.sum("size").over(run.rowsBetween(W.unboundedPreceding, 0))
    return (
        sums.withColumn("upto", upto)
        .where(F.col("upto") > F.col("want"))
        .withColumn("nth", F.row_number().over(run))
        .where(F.col("nth") == 1)
        .select(*keys, at, (F.col("want") - F.col("upto") + F.col("size")).alias("want"))
    )


def thresholds(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE) -> DataFrame:
    """(key, source_size, target, passes, threshold) of every source.

    ``sized`` has key, hash and size, and is read several times: pass a stored table.
    Documents with a hash up to ``threshold`` are taken once more than ``passes`` times. The
    document at the border is taken if that brings the source nearer to its target.
    """
    sources = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    goals = _targets(materialise(sources, "mix-totals"), weights, share)
    goals = goals.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = materialise(goals.withColumn("want", F.col("target") - F.col("passes") * F.col("source_size")), "mix-goals")

    first, second = HASH_BITS - LEVEL_BITS, HASH_BITS - 2 * LEVEL_BITS
    level1 = sized.groupBy("key", F.shiftright("hash", first).alias("b1")).agg(F.sum("size").alias("size"))
    goal = small(goals.select("key", "want"))
    border1 = materialise(_crossing(level1.join(goal, "key"), ["key"], "b1"), "mix-border")
    inside = sized.withColumn("b1", F.shiftright("hash", first)).join(small(border1), ["key", "b1"])
    level2 = inside.groupBy("key", F.shiftright("hash", second).alias("b2"), "want").agg(F.sum("size").alias("size"))
    border2 = materialise(_crossing(level2, ["key"], "b2"), "mix-border")
    inside = sized.withColumn("b2", F.shiftright("hash", second)).join(small(border2), ["key", "b2"])
    exact = inside.groupBy("key", "b2", "hash", "want").agg(F.sum("size").alias("size"))
    run = W.partitionBy("key").orderBy("hash").rowsBetween(W.unboundedPreceding, 0)
    edge = exact.withColumn("upto", F.sum("size").over(run))
    # Taken while the middle of a document's words lies within the budget.
    edge = edge.groupBy("key", "b2").agg(
        F.max(F.when(2 * F.col("upto") - F.col("size") <= 2 * F.col("want"), F.col("hash"))).alias("last")
    ).select("key", F.coalesce("last", F.shiftleft("b2", second) - 1).alias("threshold"))
    top = F.lit((1 << HASH_BITS) - 1)
    return goals.join(edge, "key", "left").select(
        "key", "source_size", "target", "passes",
        F.when(F.col("want") <= 0, F.lit(-1).cast("long")).otherwise(F.coalesce("threshold", top)).alias("threshold"),
    )


def _copies() -> Column:
    return F.col("passes") + (F.col("hash") <= F.col("threshold")).cast("long")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
    weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken (= size * copies)."""
    text = text_of(text_col)
    sized = materialise(docs.select(
        F.col(id_col).alias("doc_id"), keyed(F.col(source_col)).alias("key"),
        document_hash60(F.col(id_col), text).alias("hash"), word_count(text).alias("size"),
    ), "mix-sizes")
    table = small(materialise(thresholds(sized, weights, share), "mix-thresholds"))
    return sized.join(table, "key").withColumn("copies", _copies()).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def take_mixture(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
    weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE,
) -> DataFrame:
    """``docs`` as the mixture takes them: rows not taken go, rows taken twice appear twice."""
    text = text_of(text_col)
    key, hash_, table, copy = fresh(docs, "mix_key", "mix_hash", "mix", "copy")
    sized = materialise(docs.select(
        keyed(F.col(source_col)).alias("key"), document_hash60(F.col(id_col), text).alias("hash"),
        word_count(text).alias("size"),
    ), "mix-sizes")
    limits = thresholds(sized, weights, share).select(F.struct("*").alias(table))
    limits = small(materialise(limits, "mix-thresholds"))
    keyed_docs = docs.withColumns({key: keyed(F.col(source_col)), hash_: document_hash60(F.col(id_col), text)})
    copies = F.col(f"{table}.passes") + (F.col(hash_) <= F.col(f"{table}.threshold")).cast("long")
    return keyed_docs.join(limits, F.col(key) == F.col(f"{table}.key")).withColumn(
        copy, F.explode(F.array_repeat(F.lit(1), copies.cast("int")))
    ).select(*docs.columns)
