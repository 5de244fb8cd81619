"""Collections over hot groups, with the limits set low so that every path is taken."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import beginning_texts, child_pages, content_marks, hot_keys, number_rows, summary_text_parts


@pytest.fixture(scope="module")
def children(spark):
    """One folder has a third of all rows, another only copies of one summary."""
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        folder = "/hot" if i % 3 == 0 else "/copies" if i % 5 == 0 else f"/f{rng.randrange(40)}"
        summary = "same" if folder == "/copies" else rng.choice(["", None, f"s{rng.randrange(10**6)}é"])
        if folder == "/hot":
            summary = f"h{rng.randrange(500)}"
        rows.append((folder, rng.randrange(2), hashlib.sha256(str(i).encode()).hexdigest(), summary))
    return rows, spark.createDataFrame(
        rows, "folder string, kind_ord int, id string, summary string"
    ).repartition(7)


def test_number_rows(spark, children):
    rows, df = children
    got = number_rows(df, ["folder"], ["summary", "id"]).collect()
    want = {}
    for folder in {r[0] for r in rows}:
        group = sorted((r[3] is not None, r[3] or "", r[2]) for r in rows if r[0] == folder)
        want.update({g[2]: (n, len(group)) for n, g in enumerate(group, 1)})
    assert {r["id"]: (r["rn"], r["n"]) for r in got} == want


def test_hot_keys(spark, children):
    rows, df = children
    assert {r["folder"] for r in hot_keys(df, "folder", 300).collect()} == {"/hot", "/copies"}
    assert hot_keys(df, "folder", 5000) is None


def test_hot_keys_beyond_the_broadcast_limit(spark, children, monkeypatch):
    from shelfmark.operators import grouping

    monkeypatch.setattr(grouping, "HOT_KEY_LIMIT", 1)
    rows, df = children
    pages = child_pages(df, "folder", ["summary"], "items", page_size=100)
    assert sum(len(r["items"]) for r in pages.collect()) == len(rows)


@pytest.mark.parametrize("page_size", [10, 4096])
def test_child_pages_are_whole(spark, children, page_size):
    rows, df = children
    pages = child_pages(df, "folder", ["summary"], "items", page_size).collect()
    got = defaultdict(list)
    for r in pages:
        got[r["folder"]] += [i["id"] for i in r["items"]]
        assert all(i["id"].startswith(r["page"]) for i in r["items"])
    want = defaultdict(list)
    for r in rows:
        want[r[0]].append(r[2])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    if page_size == 4096:
        assert {r["page"] for r in pages} == {""}
    else:
        assert max(len(r["items"]) for r in pages) < 60


def text_of(rows):
    return "###\n".join(sorted(r[3] for r in rows if r[3]))


def test_text_parts_are_the_whole_text(spark, children):
    rows, df = children
    parts = defaultdict(list)
    for r in summary_text_parts(df, part_size=50).collect():
        parts[r["folder"]].append((r["kind_ord"], r["part"], r["text"]))
    for folder in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == folder]
        want = text_of([r for r in mine if r[1] == 0]) + text_of([r for r in mine if r[1] == 1])
        assert "".join(p[2] for p in sorted(parts[folder])) == want


@pytest.mark.parametrize("n_words", [300, 100_000])
def test_beginning_texts(spark, children, n_words):
    rows, df = children
    got = {r["folder"]: r["text"] for r in beginning_texts(df, "folder", n_words).collect()}
    for folder in {r[0] for r in rows}:
        whole = text_of([r for r in rows if r[0] == folder])
        assert got.get(folder, "").split()[:n_words] == whole.split()[:n_words]


def test_mark_sees_every_summary_and_no_order(spark, children):
    rows, df = children

    def mark(frame):
        return {r["folder"]: r["mark"] for r in content_marks(frame, "folder").collect()}["/hot"]

    before = mark(df)
    assert mark(df.repartition(3, "summary")) == before
    last = max((r[3], r[2]) for r in rows if r[0] == "/hot")[1]
    assert mark(df.withColumn("summary", F.when(F.col("id") == last, "zz").otherwise(F.col("summary")))) != before
    assert mark(df.where(F.col("id") != last)) != before
    # A child without a summary changes nothing, whatever the size of the folder.
    empty = spark.createDataFrame([("/hot", 1, "none", "")], df.select("folder", "kind_ord", "id", "summary").schema)
    assert mark(df.select("folder", "kind_ord", "id", "summary").unionByName(empty)) == before
