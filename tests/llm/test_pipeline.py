"""The corpus pipeline, stage by stage, on awkward rows and on the smallest tables."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from test_operators import SCHEMA, toxic_texts

STAGES = dict(corpus_pipeline.STAGES)


def test_stages_take_any_rows(spark, tmp_path):
    labels = spark.createDataFrame([(i, 0, y) for i, *_, y in toxic_texts(50, random.Random(1))], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = [
        (1, "one text", "en", "a"), (1, "one text", "en", "a"), (2, "one text", "en", None), (3, None, None, None),
        (None, None, "xx", "b"), (None, "one text", "en", "b"), (4, "", "de", "b"), (5, "many words " * 20_000, "fr", "a"),
    ]
    docs = spark.createDataFrame([(*r, 0, "d", "i", "s") for r in rows], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, str(tmp_path))
            if name != "byte_bpe":
                assert out.columns == docs.columns, name
            assert (out.count() > 0) == (table is docs), name


def test_decisions_take_effect(spark, small_tables):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet")
    total = docs.count()
    exact = STAGES["exact_dedup"](spark, docs, small_tables).cache()
    assert exact.count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count() <= total
    near = STAGES["near_dedup"](spark, exact, small_tables)
    assert near.count() <= exact.count()
    assert near.join(exact, "doc_id", "left_anti").count() == 0


def test_run(spark, small_tables):
    out = corpus_pipeline.run(spark, small_tables)
    assert out.columns == ["doc_id", "source", "ids", "n_tokens", "round_trip"]
    assert out.count() > 0 and out.where("NOT round_trip").count() == 0
    ids = spark.read.parquet(f"{small_tables}/documents.parquet").select("doc_id")
    assert out.join(ids, "doc_id", "left_anti").count() == 0
