"""What a Python worker holds and does at once: figures that must not grow with the input."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from shelfmark.functions.text import SENTENCE_GAP, sentences
from shelfmark.operators import KeySentences, cells, chunk_text, chunking, hashed_vectors, key_sentences
from shelfmark.operators import search as search_module
from shelfmark.sources import tree


def test_a_summary_makes_no_row_of_a_word(spark):
    texts = spark.range(10).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.lit("One. Two words.").alias("text"))
    plan = key_sentences.kept_units(texts, "id", "text", 100, 40)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan
    assert plan.count("sequence(") == 1  # units are made once


def test_a_summary_is_made_where_the_text_lies(spark):
    """Texts are not moved, sorted or joined, and read once."""
    texts = spark.range(10).select("id", F.concat_ws(" ", F.lit("One. Two words."), "id").alias("text"))
    plan = KeySentences("S: ").table(texts, "text", "s")._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Exchange", "Join", "Sort", "Aggregate"))
    assert plan.count("Range (") == 1


def test_sentence_gaps_are_those_of_the_plain_rule(spark):
    rnd = random.Random(11)
    texts = ["".join(rnd.choices("aé.!? \t\r\n\f\u2028", k=rnd.randint(0, 40))) for _ in range(3000)]
    want = [[p for p in re.split(r"(?<=[.!?])[ \t\r\n]+|\n+", t) if p] for t in texts]
    assert [[p for p in re.split(SENTENCE_GAP, t) if p] for t in texts] == want
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    assert [r["s"] for r in df.select(sentences(F.col("text")).alias("s")).collect()] == want


def test_a_summary_does_not_hang_on_the_share_counted_at_once(spark, monkeypatch):
    rnd = random.Random(8)
    texts = [". ".join(" ".join(rnd.choices(["river", "bridge", "stone", "of", "x"], k=rnd.randint(1, 60))) for _ in range(rnd.randint(0, 30))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate([*texts, "", None])), "id int, text string").coalesce(1)
    found = []
    for share in (1, 50, 1 << 40):
        monkeypatch.setattr(key_sentences, "TERMS_AT_ONCE", share)
        found.append(sorted(map(tuple, KeySentences("S: ").table(df, "text", "s").collect()), key=lambda r: r[0]))
    assert found[0] == found[1] == found[2] and len(found[0]) == 62


def test_a_word_is_hashed_once_a_batch(spark):
    plan = hashed_vectors(spark.range(3).select(F.lit("a b").alias("text")), "text")._jdf.queryExecution().executedPlan().toString()
    assert "md5" not in plan
    rows = spark.createDataFrame([("a b a",), ("",), (None,)], "text string").coalesce(1)
    got = [r["vector"] for r in hashed_vectors(rows, "text").collect()]
    assert sorted(x for x in got[0] if x) == [np.float32(1 / 5**0.5), np.float32(2 / 5**0.5)] and not any(got[1]) and not any(got[2])
    assert {len(v) for v in got} == {256}


def test_texts_are_cut_in_shares_of_a_batch(spark, monkeypatch):
    df = spark.createDataFrame([(0, "x")], "id int, text string")
    taken = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, fn, schema: taken.append(fn) or self)
    chunk_text(df)
    text = "A sentence of some words. " * 4000
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(100), pa.int32()), "text": [text] * 99 + [None]})
    made = list(taken[0](iter([batch.slice(0, 0), batch])))
    assert max(part.get_total_buffer_size() for part in made) < 3 * chunking.BYTES_AT_ONCE
    ids = [i for part in made for i in part.column(0).to_pylist()]
    assert ids == sorted(ids) and set(ids) == set(range(99))
    assert sum(part.num_rows for part in made) == 99 * made[0].column(0).to_pylist().count(0)


def test_files_are_read_in_small_batches(tmp_path):
    paths = []
    for i in range(40):
        paths.append(str(tmp_path / f"{i}.txt"))
        (tmp_path / f"{i}.txt").write_bytes(b"x" * 500_000)
    listed = pa.RecordBatch.from_pydict({"path": paths, "length": [500_000] * 40})
    made = list(tree._read(iter([listed])))
    assert sum(part.num_rows for part in made) == 40
    assert max(part.get_total_buffer_size() for part in made) < 6 << 20


def test_rows_beyond_the_border_get_no_double_precision():
    """Of later blocks only rows that may be among the k best are compared exactly; hits are the same."""
    rng = np.random.default_rng(5)
    matrix, _, keeper = search_module._kernel()
    as_rows = lambda a: matrix(pa.array(a.tolist(), pa.list_(pa.float32())))
    asked, rows = as_rows(rng.normal(size=(20, 32))), as_rows(rng.normal(size=(4000, 32)))
    rows[1000:2000] = rows[1000]
    ids = np.array([f"{i:05d}" for i in range(4000)], dtype=object)
    keep, _, plain = keeper(20, 5)
    _, keep_near, near = keeper(20, 5)
    for start in range(0, 4000, 500):
        part, names = rows[start : start + 500], ids[start : start + 500]
        keep(np.arange(20), np.round(1.0 - asked @ part.T, 6), names)
        keep_near(np.arange(20), asked, part, asked.astype(np.float32), part.astype(np.float32), names, 6)
    assert [b.to_pylist() for b in near(list(range(20)))] == [b.to_pylist() for b in plain(list(range(20)))]


def test_one_cell_is_chosen_without_a_sort_of_all(spark, monkeypatch):
    df = spark.createDataFrame([(0, "x")], "id int, text string")
    taken = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, fn, schema: taken.append(fn) or self)
    centres = np.array([[1, 0], [0, 1], [1, 0], [0, 1]], np.float32)
    cells._nearest_centres(df, centres, 1, "vector array<float>")
    monkeypatch.setattr(np, "argsort", None)
    batch = pa.RecordBatch.from_pydict({"vector": pa.array([[2, 1], [1, 2], [1, 1], [0, 0]], pa.list_(pa.float32()))})
    assert [c for b in taken[0](iter([batch])) for c in b.column(1).to_pylist()] == [[0], [1], [0], [0]]
