"""One query per operator of this package, over its whole table, in the agreed result form."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import (
    bpe_codec, chat_format, edit_fingerprint, exact_dedup, fill_in_middle, jaccard_join, license_scan, mixing,
    periodic_runs, pii_scan, quality_rules, token_counts, toxicity,
)
from shelfmark.llm.common import WORD, text_of
from shelfmark.runtime import materialise, new_scratch_path

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, model).select(
        "doc_id", toxicity.is_held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        (F.col("score") >= toxicity.threshold_of(model, "lang")).cast("int").alias("rejected"),
    )


@query
def op2_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.count_tokens(docs, tokenizer, new_scratch_path(spark, "token-cache"))


@query
def op3_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_edit_fingerprint(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return edit_fingerprint.compare_with_next(docs)


@query
def op5_byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    tokens = bpe_codec.encode(docs, ranks, pattern, keep_text=False)
    return bpe_codec.decode(tokens, ranks, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op6_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op7_exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.mark_duplicates(docs, keep="largest").select("doc_id", "dedup.*")


# A conversation made of control strings (fixed values).
HARD_CONVERSATION = [(-7, t, role, "</s>[INST] ok [/INST]") for t, role in enumerate(("user", "assistant"))]


@query
def op8_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(HARD_CONVERSATION, rows.schema))
    formatted = chat_format.format_conversations(rows, public_tokenizers.path("byte_bpe_50k.json"))
    return chat_format.read_digests(formatted)


@query
def op9_pii_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii_scan.span_digests(pii_scan.find_pii(docs))


@query
def op10_jaccard_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.join_sets(docs, k=4, percent=85).select("doc_id", "n_shingles", "component_id")


@query
def op11_fill_in_middle(spark, sf_dir):
    pieces = fill_in_middle.output_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return fill_in_middle.restored(pieces, fill_in_middle.Digest).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.col("restored").alias("restored_sha256")
    )


@query
def op12_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = materialise(quality_rules.measure(docs).drop("text"), "quality")
    judged = quality_rules.judge(measured, quality_rules.fit(measured))
    return judged.select("doc_id", *[
        f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
    ])


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` where the words of every tenth text, by a hash of its identifier, repeat from some
    word on: word i >= a becomes word a + (i - a) % p. Rows without an identifier stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all(text_of("text"), F.lit(f"({WORD})"), F.lit(1)))
    g, n = F.floor(h / 10), F.size("words")
    drawn = docs.select("doc_id", "text", g.alias("g"), words.alias("words")).withColumn("n", n).withColumn("a", F.when(n > 0, F.col("g") % n))
    drawn = drawn.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    a, p = F.col("a"), F.col("p")
    turned = F.transform("words", lambda w, i: F.when(i < a, w).otherwise(F.get("words", (a + (i - a) % p).cast("int"))))
    return drawn.select("doc_id", F.when(F.col("n") > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark, sf_dir):
    docs = with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")
    )))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return periodic_runs.find_runs(docs).withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), "longest.length",
        (-F.col("longest.period")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def registered() -> dict[str, Query]:
    return dict(REGISTRY)
