"""What a Python worker of the near dedup and the pipeline holds at once."""

import random
import tracemalloc

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import bpe_codec, common, jaccard_join, shingles

K, PERCENT = 5, 80


def steps(spark, monkeypatch):
    """What the near dedup does with a batch: sizes and digests, signatures, whole sets."""
    df, made = spark.createDataFrame([(0, "x")], "doc_id long, text string"), []
    monkeypatch.setattr(jaccard_join, "map_batches", lambda rows, schema, make: made.append(make) or rows)
    jaccard_join._documents(df, "doc_id", "text", K)
    jaccard_join._signature_rows(df, "text", K, PERCENT, {})
    jaccard_join._tokens(df, K)
    return made


def batch_of(texts):
    return pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "h": range(len(texts)), "content": texts})


def parts(step, batch):
    out = step(batch)
    return [out] if isinstance(out, dict) else out


def some_texts(n, words, seed=5):
    rnd = random.Random(seed)
    return [" ".join(f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(0, 2 * words))) for _ in range(n)]


def test_a_batch_is_worked_in_shares(spark, monkeypatch):
    batch = batch_of(some_texts(1000, 600))
    for make in steps(spark, monkeypatch):
        for _ in parts(make(), batch.slice(0, 50)):  # tables that a worker keeps
            pass
        tracemalloc.start()
        for _ in parts(make(), batch):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 24_000_000


def test_results_do_not_hang_on_the_shares(spark, monkeypatch):
    texts = ["", "one", "two  words", *some_texts(150, 40), *some_texts(3, 4000, seed=6)]
    texts += texts[:20]
    found = []
    for texts_at_once, n_bytes, n_tokens in ((1, 1, 1), (7, 500, 300), (1 << 30, 1 << 20, 1 << 30)):
        monkeypatch.setattr(jaccard_join, "TEXTS_AT_ONCE", texts_at_once)
        monkeypatch.setattr(shingles, "BATCH_BYTES", n_bytes)
        monkeypatch.setattr(jaccard_join, "BATCH_TOKENS", n_tokens)
        rows = []
        for make in steps(spark, monkeypatch):
            columns = [{c: v.to_pylist() if isinstance(v, pa.Array) else list(v) for c, v in p.items()} for p in parts(make(), batch_of(texts))]
            rows.append(sorted((r for c in columns for r in zip(*c.values())), key=repr))
        found.append(rows)
    assert found[0] == found[1] == found[2]
    assert len(found[0][0]) == len(found[0][2]) == len(texts)


def test_bytes_are_encoded_and_decoded_by_one_worker_a_task(spark):
    docs = spark.createDataFrame([(1, "a", "some text"), (1, "a", "some text"), (None, None, None), (2, "b", "many words " * 20_000)], "doc_id long, source string, text string")
    out = dict(corpus_pipeline.STAGES)["byte_bpe"](spark, docs, "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    assert out.count() == 4 and out.where("NOT round_trip").count() == 0
    assert out.where(F.size("ids") != F.col("n_tokens")).count() == 0


RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def codec_steps(spark, monkeypatch):
    """What byte_bpe does with a batch of texts, of chunks and of id lists."""
    df, made = spark.createDataFrame([(0, "x", "x", 0, 0, "x", [1])], "doc_id long, digest string, content string, k int, start int, part string, ids array<int>"), {}
    for name, plan in {
        "encode": lambda: bpe_codec._encode_whole(df, "content", "out", RANKS, PATTERN, ["doc_id"]),
        "chunks": lambda: bpe_codec._chunks(df, 300_000, 1_000),
        "borders": lambda: bpe_codec._borders(df, 30_000, 1_000, PATTERN),
        "decode": lambda: bpe_codec.decode(df.select("doc_id", "ids"), RANKS, PATTERN),
    }.items():
        monkeypatch.setattr(bpe_codec, "map_batches", lambda rows, schema, make, name=name: made.setdefault(name, make) and rows)
        plan()
    return made


@pytest.mark.parametrize("name", ["encode", "chunks", "borders", "decode"])
def test_the_codec_works_a_batch_in_shares(spark, monkeypatch, name):
    text = " ".join(f"w{i % 977}" for i in range(6_000))
    whole = pa.RecordBatch.from_pydict({"digest": ["d"], "content": [text * 400]})
    of_lists = pa.RecordBatch.from_pydict({"doc_id": range(200), "ids": pa.array([list(range(300, 10_300))] * 200, pa.list_(pa.int32()))})
    of_texts = pa.RecordBatch.from_pydict({"doc_id": range(200), "digest": ["d"] * 200, "content": [text] * 200, "k": [0] * 200, "start": [0] * 200, "part": [text] * 200})
    batch = {"chunks": whole, "decode": of_lists}.get(name, of_texts)
    step = codec_steps(spark, monkeypatch)[name]()
    for _ in parts(step, batch.slice(0, 1) if name != "chunks" else batch.slice(0, 0)):
        pass
    tracemalloc.start()
    for _ in parts(step, batch):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16_000_000


def test_codec_results_do_not_hang_on_the_shares(spark, monkeypatch):
    texts = ["", None, "one", "é " * 70, "many words " * 400, "x" * 5000, "", "ab \U0001F600" * 900]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    found = []
    for n_bytes, n_ids in ((1, 1), (700, 50), (1 << 30, 1 << 30)):
        monkeypatch.setattr(bpe_codec, "SHARE_BYTES", n_bytes)
        monkeypatch.setattr(bpe_codec, "SHARE_IDS", n_ids)
        out = bpe_codec.decode(bpe_codec.encode(df, RANKS, PATTERN, chunk=300, overlap=60), RANKS, PATTERN)
        found.append(sorted(out.collect()))
    assert found[0] == found[1] == found[2]
    codec = bpe_codec.encoding(RANKS, PATTERN)
    assert [r["ids"] for r in found[0]] == [codec.encode_ordinary(t or "") for t in texts]
    assert [bytes(r["decoded"]).decode() for r in found[0]] == [t or "" for t in texts]


def test_arrow_batches_are_limited_by_bytes(spark):
    df = spark.range(0, 40, 1, 1).selectExpr("repeat('x', 1000000 + cast(id as int)) as text")
    sizes = common.map_batches(df, "n long, rows long", lambda: lambda batch: {"n": [batch.nbytes], "rows": [batch.num_rows]}).collect()
    assert sum(r["rows"] for r in sizes) == 40
    assert max(r["n"] for r in sizes) <= 12_000_000
