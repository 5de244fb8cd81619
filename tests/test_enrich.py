"""Providers: batches, failures, fall-backs, and each distinct text asked once."""

from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators import BatchModel, LeadSummary, classify_segments, embed, fallback, summarise


@pytest.fixture()
def texts(spark):
    rows = [(1, "a b"), (2, None), (3, "boom"), (4, "c"), (5, "a b")]
    return spark.createDataFrame(rows, "id int, text string").repartition(5, "id")


def results(df, column):
    return {r["id"]: r[column] for r in df.collect()}


def log_of(tmp_path):
    lines = []
    for path in tmp_path.glob("*.log"):
        lines += path.read_text().splitlines()
    return sorted(lines)


def logging_model(tmp_path, answer):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        def model(batch):
            with open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}.log", "a") as log:
                log.writelines(f"{t}\n" for t in batch)
            return [answer(t) for t in batch]

        return model

    return load


def test_model_skips_null_and_survives_failure(texts, tmp_path):
    def answer(text):
        if text == "boom":
            raise ValueError(text)
        return text.upper()

    model = BatchModel(logging_model(tmp_path, answer))
    got = results(fallback(texts, "text", [model, LeadSummary("L: ", 1)], "out", "none"), "out")
    assert got == {1: "A B", 2: "none", 3: "L: boom", 4: "C", 5: "A B"}
    assert "None" not in log_of(tmp_path)


def test_second_provider_sees_open_rows_only(texts, tmp_path):
    @dataclass(frozen=True)
    class Short:
        def column(self, text):
            return F.when(F.length(text) == 1, text)

    second = BatchModel(logging_model(tmp_path, lambda t: f"second {t}"))
    got = results(fallback(texts, "text", [Short(), second], "out"), "out")
    assert got == {1: "second a b", 2: None, 3: "second boom", 4: "c", 5: "second a b"}
    assert set(log_of(tmp_path)) == {"a b", "boom"}


def test_each_distinct_text_is_embedded_once(texts, tmp_path):
    model = BatchModel(logging_model(tmp_path, lambda t: [float(len(t))]), T.ArrayType(T.FloatType()))
    got = results(embed(texts, "text", model), "vector")
    assert got == {1: [3.0], 2: None, 3: [4.0], 4: [1.0], 5: [3.0]}
    assert log_of(tmp_path) == ["a b", "boom", "c"]


def test_default_vectors(texts):
    got = results(embed(texts, "text"), "vector")
    assert got[1] == got[5] and len(got[1]) == 256
    assert sum(x * x for x in got[1]) == pytest.approx(1.0, abs=1e-6)
    assert set(got[2]) == {0.0}


def test_summary_length(texts):
    long = texts.withColumn("text", F.repeat(F.lit("w "), 400))
    model = BatchModel(lambda: lambda batch: list(batch))
    got = results(summarise(long, "text", [model], max_words=250), "summary")
    assert all(len(s.split()) == 250 for s in got.values())
    assert results(summarise(texts, "text", message="none"), "summary")[2] == "none"


def test_verdict_defaults_to_meaningful(texts):
    def load():
        def judge(batch):
            if "boom" in batch:
                raise ValueError
            return [t != "c" for t in batch]

        return judge

    got = results(classify_segments(texts, BatchModel(load, "boolean"), "text"), "meaningful")
    assert got == {1: True, 2: True, 3: True, 4: False, 5: True}
