"""Text repair, words, prompts and rules against hand-made cases and plain-Python twins."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from shelfmark import functions as C
from shelfmark.operators import chunk_text, drop_repeat_units


def apply(spark, column, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    return [r["out"] for r in rows.select("i", column(F.col("text")).alias("out")).orderBy("i").collect()]


def repair_twin(text):
    lines = []
    for line in text.split("\n"):
        if lines and line[:1].islower():
            lines[-1] += line
        else:
            lines.append(line)
    return "\n".join(x for i, x in enumerate(lines) if i == 0 or x != lines[i - 1])


HAND_MADE = {
    "Ab\ncd\nEf": "Abcd\nEf",
    "ab\nCd": "ab\nCd",
    "Ab\n\ncd": "Ab\ncd",
    "A\nb\nc": "Abc",
    "A\nA\nB\nA": "A\nB\nA",
    "A\nb\nAb": "Ab",
    "A\n\n\nB": "A\n\nB",
    "A\n1b": "A\n1b",
    "": "",
    "\nab": "ab",
    "A\nªb\nº": "Aªbº",
    "😀\n😀\nx": "😀\n😀x",
}


def test_repair_hand_made(spark):
    assert apply(spark, C.repair_text, HAND_MADE) == list(HAND_MADE.values())


def test_repair_random(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aAéÉ1 \n\n") for _ in range(rng.randrange(40))) for _ in range(400)]
    assert apply(spark, C.repair_text, texts) == [repair_twin(t) for t in texts]


def test_long_run_of_equal_lines(spark):
    assert apply(spark, C.repair_text, ["X\n" * 50_000]) == ["X\n"]


def test_drop_repeat_units_over_blocks(spark):
    rng = random.Random(3)
    lines = [rng.choice("ABC") for _ in range(500)]
    units = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "path string, ord int, text string")
    want = [(i, x) for i, x in enumerate(lines) if i == 0 or x != lines[i - 1]]
    for block in (1, 7, 500, 10_000):
        got = drop_repeat_units(units, block).orderBy("ord").collect()
        assert [(r["ord"], r["text"]) for r in got] == want


def test_words(spark):
    texts = ["  a b\tc \n d ", "", " ", "one", None, "a  b"]
    assert apply(spark, lambda t: C.first_words(t, 2), texts) == ["a b", "", "", "one", None, "a b"]
    assert apply(spark, lambda t: C.count_words(t), texts[:4]) == [4, 0, 0, 1]
    assert apply(spark, lambda t: C.truncate_words(t, 2)["text"], texts[:4]) == ["a b", "", " ", "one"]
    assert apply(spark, lambda t: C.truncate_words(t, 4)["truncated"], texts[:2]) == [False, False]
    assert apply(spark, lambda t: C.lead_summary(t, "This document ", 3), texts[:4]) == [
        "This document a b c", None, None, "This document one",
    ]


def test_hashes(spark):
    row = spark.range(1).select(
        C.document_hash(F.lit("/a/é.txt"), F.lit("é.txt"), F.lit("Text\n")).alias("d"),
        C.folder_hash(F.lit("/a"), F.lit("x###\ny")).alias("f"),
    ).first()
    assert row["d"] == hashlib.sha256("/a/é.txt+é.txt+Text\n".encode()).hexdigest()
    assert row["f"] == hashlib.sha256("/a+x###\ny".encode()).hexdigest()


def test_prompt_variants(spark):
    prompts = apply(
        spark, lambda t: C.document_prompt(F.lit("pdf"), t, F.length(t) > 3), ["abc", "abcd"]
    )
    assert all(p.endswith(f"\n\n{t}") for p, t in zip(prompts, ["abc", "abcd"]))
    assert "excerpt" in prompts[1] and "excerpt" not in prompts[0]
    assert all("this pdf file" in p and "This document" in p for p in prompts)
    assert apply(spark, lambda t: C.document_prompt(F.lit("x"), t, F.lit(True), "A %s!"), ["abc", None]) == [
        "A x!\n\nWhat follows is an excerpt from the start of a longer text.\n\nabc", None,
    ]


def test_json_flag(spark):
    answers = ['{"meaningful": false}', '{"meaningful": true}', "{}", "nope", None, '{"meaningful": "x"}']
    assert apply(spark, C.json_flag, answers) == [False, True, True, True, True, True]


def test_substantial(spark):
    texts = [
        "This is a plain sentence about nothing.", "https://a.example/b?c=1", "  www.example.com ",
        "*** ### $$$ a", "Page 3", "Yes.", None, "12 500 km of road were built in 1999",
    ]
    assert apply(spark, C.is_substantial, texts) == [True, False, False, False, False, True, True, True]


def test_snapshot_name(spark):
    name = spark.range(1).select(
        C.snapshot_name(F.lit("/my docs/Ab"), F.lit("2024-05-06").cast("date"), F.lit("u-1")).alias("n")
    ).first()["n"]
    assert name == "my_docsb_10_391_92_6_2024-05-06-u-1"


@pytest.mark.parametrize(
    "lengths, chunks",
    [
        ([451], [451]), ([224, 224], [450]), ([224, 225], [224, 225]),
        ([400, 29, 100], [431, 131]), ([400, 30, 100], [432, 132]), ([400, 31, 100], [433, 100]), ([], []),
    ],
)
def test_chunk_lengths(spark, lengths, chunks):
    text = "\n".join("x" * n for n in lengths)
    docs = spark.createDataFrame([("d", text)], "id string, text string")
    got = chunk_text(docs).orderBy("ord").collect()
    assert [len(r["chunk"]) for r in got] == chunks
    assert [r["ord"] for r in got] == list(range(len(chunks)))


def test_chunks_lose_no_sentence(spark):
    rng = random.Random(9)
    texts = [
        " ".join("".join(rng.choice("abé😀") for _ in range(rng.randrange(1, 200))) + rng.choice(".!?") for _ in range(n))
        for n in (0, 1, 5, 60)
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, None)], "id int, text string")
    rows = chunk_text(docs).collect()
    assert {r["id"] for r in rows} == {1, 2, 3}
    for i, text in enumerate(texts):
        chunks = [r["chunk"] for r in sorted(rows, key=lambda r: r["ord"]) if r["id"] == i]
        parts = [p for c in chunks for p in c.split("\n\n")]
        seen = [p for j, p in enumerate(parts) if p not in parts[:j]]
        assert set(seen) == set(s for s in text.split(" ") if s)
        assert all(len(c) <= 450 for c in chunks)


def test_sentence_rule_is_the_same_in_both_places(spark, small_tables):
    """With no room to pack, each segment is one sentence of the column function."""
    docs = spark.read.parquet(f"{small_tables}/documents.parquet").select("doc_id", "text")
    packed = chunk_text(docs, size=1, overlap=0).select("doc_id", "chunk")
    split = docs.select("doc_id", F.explode(C.sentences(F.col("text"))).alias("chunk"))
    split = split.withColumn("chunk", F.regexp_replace("chunk", r"^\s+|\s+$", "")).where("chunk <> ''")
    assert packed.exceptAll(split).count() == 0 and split.exceptAll(packed).count() == 0
