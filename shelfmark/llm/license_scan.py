"""License scan by ordered signature rules. DataFrame functions only.

A text becomes lower-case words with single blanks. A rule is tried where its keyword occurs;
its matches are found by marking them in the text and splitting at the marks, so that word
offsets come from running sums. A detection inside one of an equal or stronger class is
suppressed: after sorting by start, one running maximum of ends per class decides that.

Cases: null and empty texts have no words and no detections. Rows that repeat identifier and
text get the same result once per row. Null identifiers are values like any other. An empty
table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.common import text_of
from shelfmark.llm.license_rules import BASE, HINT, Rule, all_rules, spaced

# Trust in the strongest surviving detection, by class.
CLASS_SCORES = (1.0, 0.95, 0.9, 0.8, 0.7, 0.4)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text: Column) -> Column:
    """The words of a text, lower-case for A-Z, with one blank between them."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.trim(F.regexp_replace(lower, SEPARATORS, " "))


def cues_of(rule: Rule) -> tuple[str, ...]:
    """The words that gate the keyword test, of which a text needs one: the rule's own, or the
    longest of the keyword."""
    return rule.cues or (max(rule.keyword.split(), key=len),)


def _rule_array(rules: list[Rule]) -> Column:
    return F.array(*[
        F.struct(
            F.lit(i).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.label).alias("label"),
            F.array(*map(F.lit, cues_of(r))).alias("cues"), F.lit(r.keyword).alias("keyword"),
            F.lit(spaced(r.pattern)).alias("pattern"),
        )
        for i, r in enumerate(rules)
    ])


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """Every rule match: (doc_id, digest, n_words, copies, rule, kind, label, start_word,
    end_word, suppressed); documents without a match have one row with a null rule.

    ``digest`` is a hash of the words; ``copies`` is the number of equal rows.
    """
    rules = all_rules() if rules is None else rules
    table = _rule_array(rules)
    cues = F.array(*map(F.lit, sorted({c for r in rules for c in cues_of(r)})))
    words = docs.select(F.col(id_col).alias("doc_id"), plain_words(text_of(text_col)).alias("words"))
    gated = words.withColumn("list", F.split("words", " ")).select(
        "doc_id", "words",
        F.when(F.col("words") == "", 0).otherwise(F.size("list")).cast("long").alias("n_words"),
        F.array_intersect("list", cues).alias("cues"),
    )
    tried = gated.select(
        "doc_id", "words", "n_words", F.xxhash64("words").alias("digest"),
        F.explode_outer(F.when(F.size("cues") > 0, F.filter(
            table, lambda r: F.arrays_overlap("cues", r["cues"]) & F.contains(F.col("words"), r["keyword"])
        ))).alias("r"),
    )
    padded = F.concat(F.lit(" "), F.replace("words", F.lit(" "), F.lit("  ")), F.lit(" "))
    marked = F.when(
        F.col("r").isNotNull(),
        F.split(F.regexp_replace(padded, F.col("r.pattern"), F.lit("\x01$0\x02")), "\x01"),
    )
    pieces = tried.select(
        "doc_id", "digest", "n_words", "r.rule", "r.kind", "r.label", F.posexplode_outer(marked).alias("place", "piece")
    )
    counted = pieces.groupBy("doc_id", "digest", "n_words", "rule", "kind", "label", "place", (
        _blanks(F.col("piece")) / 2).cast("long").alias("size"),
        F.when(F.col("place") > 0, (_blanks(F.substring_index("piece", "\x02", 1)) / 2).cast("long")).alias("length"),
    ).agg(F.count(F.lit(1)).alias("copies"))

    document = ["doc_id", "digest"]
    # Both windows and the later grouping by document use this one partitioning.
    near = counted.repartition(*document)
    before = W.partitionBy(*document, "rule").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    placed = near.withColumn("start_word", F.sum("size").over(before))
    hit = F.col("place") > 0
    placed = placed.select(
        *document, "n_words", "copies",
        *[F.when(hit, F.col(c)).alias(c) for c in ("rule", "kind", "label", "start_word")],
        F.when(hit, F.col("start_word") + F.col("length")).alias("end_word"),
    )
    order = W.partitionBy(*document).orderBy(
        F.col("start_word").asc_nulls_last(), F.col("end_word").desc_nulls_last(), "kind", "rule"
    ).rowsBetween(W.unboundedPreceding, -1)
    reach = F.coalesce(*[
        F.when(F.col("kind") == k, F.max(F.when(F.col("kind") <= k, F.col("end_word"))).over(order))
        for k in range(HINT + 1)
    ])
    return placed.withColumn("suppressed", F.coalesce(reach >= F.col("end_word"), F.lit(False)))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, n_found (detections that survive)."""
    rules = all_rules() if rules is None else rules
    found = detections(docs, id_col, text_col, rules)
    is_base, stays = F.col("kind") == BASE, ~F.col("suppressed") & F.col("rule").isNotNull()
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    score = F.element_at(F.array(*map(F.lit, CLASS_SCORES)), F.col("kind") + 1)
    per_document = found.groupBy("doc_id", "digest", "n_words").agg(
        F.count_if(is_base).alias("n_base"),
        F.min(F.when(is_base, F.col("start_word"))).alias("first_word"),
        F.max(F.when(is_base, F.col("start_word"))).alias("last_word"),
        listed(F.when(is_base, F.col("label"))).alias("base_labels"),
        listed(F.when(is_base | stays, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(stays, score)), F.lit(0.0)).alias("score"),
        F.count_if(stays).alias("n_found"),
        F.max("copies").alias("copies"),
    )
    # Equal rows were counted together; give each its row again.
    return per_document.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_found"
    )
