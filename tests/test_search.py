"""Nearest-vector search against brute force."""

import numpy as np
import pytest

from shelfmark.operators import nearest, search_context, search_documents, search_segments
from shelfmark.operators.ann import nearest_in_buckets


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    corpus = rng.normal(size=(3000, 24)).astype(np.float32)
    corpus[500:1500] = corpus[500]  # a third of all vectors are copies
    corpus[7] = 0
    queries = np.vstack([rng.normal(size=(9, 24)), corpus[500:501]]).astype(np.float32)
    c = spark.createDataFrame([(f"{i:05d}", v.tolist()) for i, v in enumerate(corpus)], "id string, vector array<float>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, vector array<float>")
    return corpus, queries, c.repartition(6), q


def unit(a):
    a = a.astype(np.float64)
    n = np.linalg.norm(a, axis=1, keepdims=True)
    return np.divide(a, n, out=np.zeros_like(a), where=n > 0)


def brute(corpus, queries, k):
    d = np.round(1 - unit(queries) @ unit(corpus).T, 6)
    return {
        (q, r): (f"{i:05d}", row[i])
        for q, row in enumerate(d)
        for r, i in enumerate(sorted(range(len(row)), key=lambda i: (row[i], i))[:k], 1)
    }


def hits(df):
    return {(r["query_id"], r["rank"]): (r["id"], r["distance"]) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for key in want:
        assert got[key][0] == want[key][0]
        assert got[key][1] == pytest.approx(want[key][1], abs=1e-9)


@pytest.mark.parametrize("k", [1, 20, 4000])
def test_exact(data, k):
    corpus, queries, c, q = data
    same(hits(nearest(q, c, k)), brute(corpus, queries, k))


def test_batches_give_the_same(data):
    corpus, queries, c, q = data
    same(hits(nearest(q, c, 20, max_queries=4)), brute(corpus, queries, 20))
    some = hits(nearest(q, c, 20, exact=False))
    same(hits(nearest(q, c, 20, exact=False, max_queries=4)), some)


def test_empty_sides(data):
    _, _, c, q = data
    assert nearest(q.limit(0), c).count() == 0
    assert nearest(q, c.limit(0)).count() == 0


def test_buckets(data):
    """Distances are exact, and most of the true neighbours are found."""
    corpus, queries, c, q = data
    want = brute(corpus, queries, 10)
    d = np.round(1 - unit(queries) @ unit(corpus).T, 6)
    got = hits(nearest(q, c, 10, exact=False, tables=8, bucket_length=0.5))
    for (query, _), (ident, distance) in got.items():
        assert distance == pytest.approx(d[query][int(ident)], abs=1e-9)
    found = {(query, ident) for (query, _), (ident, _) in got.items()}
    true = {(query, ident) for (query, _), (ident, _) in want.items()}
    assert len(found & true) / len(true) > 0.9
    counts = nearest_in_buckets(
        [(r["query_id"], r["vector"]) for r in q.collect()], c, 10, 6, tables=1, bucket_length=0.1, counts=True
    ).collect()
    assert all(0 <= r["n_compared"] < 3000 for r in counts)


def test_stored_buckets_give_the_same(spark, data, tmp_path, monkeypatch):
    from shelfmark.operators import ann
    from shelfmark.operators.ann import nearest_stored, write_buckets

    _, _, c, q = data
    write_buckets(c, str(tmp_path), tables=4, bucket_length=0.5)
    same(
        hits(nearest_stored(q, str(tmp_path), 10)),
        hits(nearest(q, c, 10, exact=False, tables=4, bucket_length=0.5)),
    )
    some = hits(nearest_stored(q, str(tmp_path), 10))
    monkeypatch.setattr(ann, "MAX_QUERIES", 3)
    same(hits(nearest_stored(q, str(tmp_path), 10)), some)
    monkeypatch.undo()
    plan = nearest_stored(q.limit(1), str(tmp_path), 10)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(bucket" in plan or "bucket IN" in plan


def test_records_and_context(spark):
    docs = spark.createDataFrame(
        [("d1", "one.txt", "/one.txt", "S\n1", [1.0, 0.0], 5), ("d2", "two.txt", "/two.txt", "S2", [0.0, 1.0], 6)],
        "id string, name string, file_path string, summary string, vector array<float>, created_ms long",
    )
    segments = spark.createDataFrame(
        [("s1", "d1", "a b", [1.0, 0.1], 1), ("s2", "gone", "c d", [1.0, 0.2], 1), ("s3", "d2", "e f", [0.0, 1.0], 1)],
        "id string, document_id string, text string, vector array<float>, created_ms long",
    )
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    first = search_documents(q, docs).orderBy("rank").collect()
    assert [(r["id"], r["distance"]) for r in first] == [("d1", 0.0), ("d2", 1.0)]
    found = search_segments(q, segments, docs).orderBy("rank").collect()
    assert [(r["id"], r["document"]) for r in found] == [("s1", "one.txt"), ("s2", ""), ("s3", "two.txt")]
    row = search_context(q, segments, docs, word_budget=3).first()
    assert (row["n_segments"], row["context"]) == (2, "a b\n\nc d")
    row = search_context(q, segments.limit(0), docs).first()
    assert (row["n_segments"], row["context"]) == (0, None)


def test_a_text_finds_itself(spark):
    from pyspark.sql import functions as F

    from shelfmark.operators import embed

    texts = spark.createDataFrame(
        [(1, "harbour budget for spring"), (2, "cats sleep long"), (3, "a budget"), (4, "")], "query_id long, text string"
    )
    vectors = embed(texts, "text")
    corpus = vectors.select(F.col("query_id").cast("string").alias("id"), "vector")
    got = hits(nearest(vectors, corpus, 2))
    assert [got[(i, 1)] for i in (1, 2, 3)] == [("1", 0.0), ("2", 0.0), ("3", 0.0)]
    assert got[(1, 2)][0] == "3" and got[(4, 1)] == ("1", 1.0)
    table = {r["id"]: np.array(r["vector"], dtype=np.float64) for r in corpus.collect()}
    assert got[(3, 2)] == ("1", pytest.approx(round(1 - float(table["1"] @ table["3"]), 6), abs=1e-6))


# --- inverted file -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """20,000 vectors around 40 directions, of which one has a third of all, stored by cell."""
    from shelfmark.operators import write_cells

    rng = np.random.default_rng(5)
    around = rng.normal(size=(40, 24))
    label = np.where(rng.random(20_000) < 1 / 3, 0, rng.integers(1, 40, 20_000))
    corpus = (around[label] + 0.5 * rng.normal(size=(20_000, 24))).astype(np.float32)
    corpus[7] = 0
    queries = corpus[:: 20_000 // 50] + 0.05
    table = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(corpus)], "id string, vector array<float>").repartition(8)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, vector array<float>")
    path = str(tmp_path_factory.mktemp("cells"))
    write_cells(table, path, n_cells=60, sample_rows=4000)
    return corpus, queries, table, asked, path


def test_cells_find_with_few_comparisons(clustered):
    from shelfmark.operators import compared, recall

    corpus, queries, table, asked, path = clustered
    exact, found = nearest(asked, table, 10), nearest(asked, table, 10, cells=path, probes=5)
    report = recall(exact, found).collect()
    assert len(report) == 50 and sum(r["n_found"] for r in report) >= 0.9 * sum(r["n"] for r in report)
    d = np.round(1 - unit(queries) @ unit(corpus).T, 6)
    for (query, _), (ident, distance) in hits(found).items():
        assert distance == pytest.approx(d[query][int(ident)], abs=2e-6)
    share = np.mean([r["n_compared"] for r in compared(asked, path, 5).collect()]) / len(corpus)
    assert share <= 0.3
    assert np.mean([r["n_compared"] for r in compared(asked, path, 1).collect()]) / len(corpus) < share


def test_all_cells_are_the_exact_search(clustered, monkeypatch):
    _, _, table, asked, path = clustered
    want = hits(nearest(asked, table, 10))
    same(hits(nearest(asked, table, 10, cells=path, probes=60)), want)
    same(hits(nearest(asked, table, 10, cells=path, probes=60, max_queries=9)), want)
    assert nearest(asked.limit(0), table, 10, cells=path).count() == 0


def test_only_asked_cells_are_read(clustered):
    _, _, table, asked, path = clustered
    plan = nearest(asked.limit(1), table, 10, cells=path, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


def test_cells_of_odd_corpora(spark, tmp_path):
    from shelfmark.operators import nearest_in_cells, write_cells

    schema = "id long, vector array<float>"
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    for i, rows in enumerate(([], [(1, [0.0, 0.0])], [(1, [1.0, 1.0]), (2, None), (1, [1.0, 1.0])])):
        write_cells(spark.createDataFrame(rows, schema), str(tmp_path / str(i)))
        found = nearest_in_cells(asked, str(tmp_path / str(i))).collect()
        assert len(found) == sum(v is not None for _, v in rows)


def test_ten_thousand_queries_pass_the_corpus_once(spark, data):
    corpus, _, c, _ = data
    rng = np.random.default_rng(3)
    many = rng.normal(size=(10_000, corpus.shape[1]))
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(many)], "query_id long, vector array<float>")
    found = nearest(asked, c, 3)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    some = {key: hit for key, hit in hits(found).items() if key[0] % 100 == 0}
    want = {(q * 100, r): h for (q, r), h in brute(corpus, many[::100].astype(np.float32), 3).items()}
    same(some, want)


def test_repeated_queries_end(spark, data):
    _, _, c, q = data
    again = q.limit(1).crossJoin(spark.range(40)).drop("id")
    assert nearest(again, c, 2, max_queries=3).count() == 2


# --- known hits and cell centres -----------------------------------------------------------


def test_known_hits_bound_the_exact_search(clustered, spark):
    """The same hits as without them; a task keeps only what is as near as the k-th known one."""
    from shelfmark.operators import search

    corpus, queries, table, asked, path = clustered
    want, known = hits(nearest(asked, table, 10)), nearest(asked, table, 10, cells=path, probes=2).cache()
    same(hits(nearest(asked, table, 10, within=known)), want)
    same(hits(nearest(asked, table, 10, within=known, max_queries=9)), want)
    twice = asked.unionByName(asked.limit(5))
    again = nearest(twice, table, 10, cells=path, probes=2)
    same(hits(nearest(twice, table, 10, within=again)), hits(nearest(twice, table, 10)))
    # Of some queries nothing is known, of others fewer hits than wanted.
    some = known.where("query_id > 5 AND NOT (query_id = 7 AND rank > 4)")
    same(hits(nearest(asked, table, 10, within=some)), want)
    few, wide = asked.toArrow(), table.repartition(40)
    far = max(r["distance"] for r in known.where("rank = 10").collect())
    assert search._broadcast_scores(few, wide, 10, 6, known).count() < 3 * 50 * 10 < search._broadcast_scores(few, wide, 10, 6).count()
    assert max(r["distance"] for r in search._broadcast_scores(few, wide, 10, 6, known).collect()) <= far + 1e-6


def test_centres_are_found_in_tasks(clustered, spark, monkeypatch):
    """A centre near each of 40 directions, one of which has a third of the vectors; the driver gets neither
    points nor more than one sum per cell."""
    from shelfmark.operators import cells

    corpus, _, table, _, _ = clustered
    got, to_arrow = [], type(table).toArrow
    monkeypatch.setattr(type(table), "toArrow", lambda self: got.append(to_arrow(self)) or got[-1])
    centres = cells.find_centres(table, 60)
    assert len(centres) == 60 and np.allclose(np.linalg.norm(centres, axis=1), 1, atol=1e-6)
    assert max(t.num_rows for t in got) <= 4 * 60
    near = unit(np.random.default_rng(5).normal(size=(40, 24))) @ centres.T
    assert (near.max(axis=1) > 0.9).mean() >= 0.9
    copies = spark.createDataFrame([(str(i), [1.0, float(i % 7 == 0) * i]) for i in range(3000)], "id string, vector array<float>")
    found = cells.find_centres(copies, 20)
    assert 2 <= len(found) <= 20 and (found @ unit(np.array([1.0, 0.0])[None]).T).max() > 0.9999
    assert len(cells.find_centres(copies.where("id in ('1', '2')"), 20)) == 1


def test_nearest_centre_in_single_precision_is_the_first_of_the_nearest(spark):
    from shelfmark.operators import cells

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(50, 16)).astype(np.float32)
    centres[30:40] = centres[5] * 2
    rows = np.vstack([rng.normal(size=(300, 16)), centres[3:4] + centres[9:10], np.zeros((1, 16)), centres[35:36]]).astype(np.float32)
    df = spark.createDataFrame([(v.tolist(),) for v in rows], "vector array<float>").coalesce(1)
    got = [r["cells"][0] for r in cells._nearest_centres(df, centres, 1, "vector array<float>").collect()]
    assert got == np.round(unit(rows) @ unit(centres).T, 9).argmax(axis=1).tolist()
