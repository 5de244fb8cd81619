"""Periodic runs against a scan of all lags."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from test_operators import empty, odd  # noqa: F401

from shelfmark.llm import periodic_runs, queries

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def all_lags(words):
    """(start, length, period) of every run, lag by lag; of a stretch the smallest period."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            start = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(6, 4 * q):
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def words_with_runs(rnd):
    """Words of few or many kinds, with stretches that repeat blocks, also blocks that repeat themselves."""
    n, kinds = rnd.choice([0, 1, 5, 6, 7, 20, 60, 150, 500]), rnd.choice([1, 2, 3, 10, 1000])
    words = [rnd.randrange(kinds) for _ in range(n)]
    for _ in range(rnd.choice([0, 1, 2, 4]) if n > 7 else 0):
        begin, p = rnd.randrange(n), rnd.randrange(1, n // 4 + 1)
        end = min(n, begin + int(p * rnd.uniform(2, 9)))
        block = [rnd.randrange(rnd.choice([1, 2, 5, 500])) for _ in range(p)]
        if rnd.random() < 0.3:
            block = (block[: max(1, p // 3)] * 3) + block[:1] * rnd.randrange(2)
        words[begin:end] = [block[i % len(block)] for i in range(end - begin)]
    return words


@pytest.mark.parametrize("short", [8, 1, 3])
def test_runs_against_all_lags(short, monkeypatch):
    monkeypatch.setattr(periodic_runs, "SHORT", short)
    rnd, some = random.Random(short), 0
    for _ in range(80):
        texts = [words_with_runs(rnd) for _ in range(rnd.choice([1, 3, 12]))]
        found = periodic_runs.runs_of([np.array(t, np.int64) for t in texts])
        for words, runs in zip(texts, found):
            assert list(map(tuple, runs.tolist())) == all_lags(words)
            some += len(runs)
    assert some > 100


def test_fibonacci_words():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    for words in (b, b[::-1], [w for x in b for w in (x, 2)], b * 5):
        assert list(map(tuple, periodic_runs.runs_of([np.array(words, np.int64)])[0].tolist())) == all_lags(words)


def test_every_period_and_place():
    """A run of exactly four periods is found wherever it lies among other words."""
    for q in (*range(7, 70), 127, 128, 129, 255, 256, 300):
        for before in (0, 3, 50):
            words = [*range(10_000, 10_000 + before), *(list(range(q)) * 4), *range(20_000, 20_000 + 100)]
            assert periodic_runs.runs_of([np.array(words, np.int64)])[0].tolist() == [[before, 4 * q, q]]


def test_wrong_hashes_are_refuted(monkeypatch):
    words = [*range(100), *(list(range(200, 220)) * 5), *range(300, 400)]
    agree = periodic_runs.PrefixHashes.agreeing
    monkeypatch.setattr(periodic_runs.PrefixHashes, "agreeing", lambda self, a, b, forward: agree(self, a, b, forward) + 1)
    assert periodic_runs.runs_of([np.array(words, np.int64)])[0].tolist() == [[100, 100, 20]]


def test_collapse():
    words = "x a b a b a b a b y z z z z z z w".split()
    runs = periodic_runs.runs_of([np.unique(words, return_inverse=True)[1]])[0]
    assert runs.tolist() == [[1, 8, 2], [10, 6, 1]]
    assert periodic_runs.collapse(words, runs) == "x a b y z w"


def test_table(spark, odd, empty):
    rows = periodic_runs.find_runs(odd).collect()
    assert len(rows) == odd.count() and periodic_runs.find_runs(empty).count() == 0
    texts = {(r["doc_id"], " ".join(words_of(r["text"] or ""))) for r in odd.collect()}
    for r in rows:
        if r["doc_id"] in (5, 6):
            assert r["n_words"] == 9008 and r["runs"][0].asDict() == {"start": 0, "length": 9000, "period": 1}
            assert r["collapsed"] == "word Mail a.b@c.example or call +1 (555) 123-4567 now"
        else:
            assert r["runs"] == [] and (r["doc_id"], r["collapsed"]) in texts


def test_very_long_text(spark):
    rnd = random.Random(5)
    head, block = [f"w{rnd.randrange(10**6)}" for _ in range(300_000)], [f"v{i}" for i in range(20_011)]
    text = " ".join(head + block * 5 + ["end"])
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    rows = periodic_runs.find_runs(df).collect()
    assert len(rows) == 2
    for r in rows:
        assert [tuple(x) for x in r["runs"]] == [(300_000, 100_055, 20_011)]
        assert r["collapsed"] == " ".join(head + block + ["end"])


def words_of(text):
    return re.findall("[^ \t\n\x0b\x0c\r]+", text)


def plain_version(doc_id, text):
    words = words_of(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = all_lags(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    start, length, period = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    return (
        doc_id, len(runs), start, length, period, 1000 * length // period if runs else None,
        sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_query_against_all_lags(spark, small_tables, tmp_path):
    rnd = random.Random(8)
    docs = [tuple(r) for r in spark.read.parquet(f"{small_tables}/documents.parquet").select("doc_id", "text").collect()]
    docs = [r for r in docs if len(r[1] or "") < 8000]
    docs += [(10_000 + i, " ".join(map(str, words_with_runs(rnd)))) for i in range(200)]
    docs += [(None, "a b " * 9), (None, None), (30, ""), (31, " \n\t "), (32, "é é " * 8), (32, "é é " * 8)]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs) > 20
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.REGISTRY["op13_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[-1], r[-2]))
    assert order([tuple(r) for r in got.collect()]) == order([plain_version(*r) for r in docs])
