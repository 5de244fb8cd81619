"""Whole runs: first run, re-run, changes, removals, and the folder tree against a twin."""

import hashlib
import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_key_sentences import plain_summary

from shelfmark.operators import BatchModel, ancestors, classify, count_items, index_counts, rollup, stale_folders
from shelfmark.plans import Settings, run_index
from shelfmark.sources import corpus_files

TREE = {
    "/r/a/one.txt": "Alpha beta. Gamma.", "/r/a/two.docx": "X\nX\nY", "/r/a/b/c/deep.pdf": "Li\nne one.\nEnd.",
    "/r/a/b/c/copy.txt": "Alpha beta. Gamma.", "/r/z/sheet.xlsx": "1 2 \n", "/r/top.rtf": "",
}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def files(spark, tree):
    rows = spark.createDataFrame(list(tree.items()), "p string, t string")
    return corpus_files(rows, F.col("p"), F.col("t")).drop("p", "t")


def settings(**more):
    return Settings(root="/r", now_ms=F.lit(1).cast("long"), **more)


def rows(df):
    return {r["file_path"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def first(spark):
    return run_index(files(spark, TREE), settings=settings())


def mark(summaries):
    lanes = [sum(int(sha(s)[15 * i : 15 * i + 15], 16) for s in summaries) for i in range(4)]
    return ":".join(map(str, [len(summaries), *lanes])) if summaries else ""


def folder_twin(summaries):
    """path -> (hash, summary) by walking the tree bottom up."""
    paths = {"/r"}
    for path in summaries:
        parts = path.split("/")[1:-1]
        paths |= {"/" + "/".join(parts[: i + 1]) for i in range(len(parts))}
    done = {}
    for path in sorted(paths, key=lambda p: -p.count("/")):
        subs = sorted(done[p][1] for p in done if p.rpartition("/")[0] == path)
        docs = sorted(s for p, s in summaries.items() if p.rpartition("/")[0] == path and s)
        text = "###\n".join(subs) + "###\n".join(docs)
        done[path] = (sha(f"{path}+{mark(subs)}|{mark(docs)}"), plain_summary(text, "This folder ") if text.strip() else "This folder is empty")
    return done


def test_documents(first):
    got = rows(first["documents"])
    assert set(got) == set(TREE)
    assert got["/r/a/two.docx"]["hash"] == sha("/r/a/two.docx+two.docx+X\nY")
    assert got["/r/a/b/c/deep.pdf"]["hash"] == sha("/r/a/b/c/deep.pdf+deep.pdf+Line one.\nEnd.")
    assert got["/r/a/one.txt"]["summary"] == "This document Alpha beta. Gamma."
    assert got["/r/top.rtf"]["summary"] == "There was an error retrieving a summary for this document"
    assert all(len(r["vector"]) == 256 for r in got.values())


def test_segments(first):
    owners = {r["id"]: p for p, r in rows(first["documents"]).items()}
    got = defaultdict(list)
    for r in first["segments"].orderBy("ord").collect():
        got[owners[r["document_id"]]].append(r["text"])
    assert got == {
        "/r/a/one.txt": ["Alpha beta.\n\nGamma."], "/r/a/b/c/copy.txt": ["Alpha beta.\n\nGamma."],
        "/r/a/two.docx": ["X\n\nY"], "/r/a/b/c/deep.pdf": ["Line one.\n\nEnd."],
    }


def test_folders(first):
    summaries = {p: r["summary"] for p, r in rows(first["documents"]).items()}
    twin = folder_twin(summaries)
    got = rows(first["folders"])
    assert {p: (r["hash"], r["summary"]) for p, r in got.items()} == twin
    assert (got["/r"]["depth"], got["/r"]["parent"]) == (1, None)
    assert (got["/r/a/b/c"]["depth"], got["/r/a/b/c"]["parent"], got["/r/a/b/c"]["name"]) == (4, "/r/a/b", "c")


def test_folder_hash_does_not_hang_on_order(spark, first):
    shuffled = rollup(ancestors(files(spark, TREE), "/r"), first["documents"].repartition(5))
    assert {p: r["hash"] for p, r in rows(shuffled).items()} == {
        p: r["hash"] for p, r in rows(first["folders"]).items()
    }


def test_count_items(spark):
    row = count_items(files(spark, TREE), "/r").first()
    assert (row["n_files"], row["n_folders"]) == (6, 4)


def contents(tables):
    return {name: {tuple(map(str, r)) for r in df.drop("created_ms").collect()} for name, df in tables.items()}


def test_second_run_changes_nothing(spark, first):
    again = run_index(files(spark, TREE), first, settings())
    assert contents(again) == contents(first)


def test_one_change(spark, first):
    changed = {**TREE, "/r/a/b/c/deep.pdf": "New words here."}
    scan = files(spark, changed).withColumn("hash", F.sha2(F.col("text"), 256))
    after = run_index(files(spark, changed), first, settings())
    before_docs, docs = rows(first["documents"]), rows(after["documents"])
    assert {p for p in docs if docs[p] != before_docs[p]} == {"/r/a/b/c/deep.pdf"}
    gone = before_docs["/r/a/b/c/deep.pdf"]["id"]
    assert after["segments"].where(F.col("document_id") == gone).count() == 0
    assert after["segments"].count() == first["segments"].count()
    before, now = rows(first["folders"]), rows(after["folders"])
    assert {p for p in now if now[p]["hash"] != before[p]["hash"]} == {"/r", "/r/a", "/r/a/b", "/r/a/b/c"}
    stale = stale_folders(after["folders"], first["folders"]).collect()
    assert {r["file_path"] for r in stale} == {"/r", "/r/a", "/r/a/b", "/r/a/b/c"}
    assert scan.count() == 6


@pytest.mark.parametrize("few", [100, 1])
def test_changed_texts_are_picked_without_moving_others(spark, few):
    from shelfmark.plans.index import _rows_at

    texts = spark.range(500).selectExpr("concat('/r/', id) path", "concat('text ', id) text")
    paths = texts.where("path like '%7'").select("path")
    picked = _rows_at(texts, paths, few)
    assert {r["path"] for r in picked.collect()} == {r["path"] for r in paths.collect()}
    if few == 1:
        # The filter by slots is a broadcast below the exchange of the exact join.
        plan = picked._jdf.queryExecution().explainString(picked.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        assert "BroadcastHashJoin" in plan


def test_gone_files_stay_unless_pruned(spark, first):
    fewer = {p: t for p, t in TREE.items() if not p.startswith("/r/z")}
    kept = run_index(files(spark, fewer), first, settings())
    assert "/r/z/sheet.xlsx" in rows(kept["documents"]) and "/r/z" in rows(kept["folders"])
    pruned = run_index(files(spark, fewer), first, settings(prune=True))
    assert set(rows(pruned["documents"])) == set(fewer) and "/r/z" not in rows(pruned["folders"])
    assert pruned["folders"].where("file_path = '/r'").first()["hash"] == kept["folders"].where("file_path = '/r'").first()["hash"]


def test_models_are_not_asked_again(spark, first):
    def load():
        def model(batch):
            raise AssertionError("asked")

        return model

    strict = BatchModel(load, raise_errors=True)
    again = run_index(
        files(spark, TREE), first,
        settings(document_summaries=[strict], folder_summaries=[strict]),
    )
    assert contents(again) == contents(first)


def test_all_models_together_each_asked_once(spark, tmp_path):
    """Random answers: kept, never asked for twice, no vector lost."""
    log = str(tmp_path)

    def model(name, answer):
        def load():
            import os
            import uuid

            def ask(batch):
                for _ in batch:
                    open(os.path.join(log, f"{name}-{uuid.uuid4().hex}"), "w").close()
                return [answer() for _ in batch]

            return ask

        return load

    def words():
        import uuid

        return f"Summary {uuid.uuid4().hex}"

    def numbers():
        import random

        return [random.random(), 1.0]

    def verdict():
        import random

        return random.random() < 0.7

    chat = BatchModel(model("chat", words))
    more = dict(
        document_summaries=(chat,), folder_summaries=(chat,), vectors=BatchModel(model("vector", numbers), "array<float>"),
        check_segments=True, segment_check=BatchModel(model("check", verdict), "boolean"), chunk_size=40,
    )
    tree = {**TREE, "/r/a/long.txt": "A full sentence that is fine. " * 20}
    tables = run_index(files(spark, tree), settings=settings(**more))
    asked = lambda: {k: sum(p.name.startswith(k) for p in tmp_path.iterdir()) for k in ("chat", "check", "vector")}
    assert all(t.where("vector is null").count() == 0 for t in tables.values())
    n_docs, n_folders, kept = (tables[t].count() for t in ("documents", "folders", "segments"))
    first = asked()
    cut = run_index(files(spark, tree), settings=settings(chunk_size=40))["segments"].count()
    texts = tables["segments"].select("text").distinct().count()
    assert first == {"chat": n_docs + n_folders, "check": cut, "vector": n_docs + n_folders + texts}
    assert 0 < kept < cut
    again = run_index(files(spark, tree), tables, settings(**more))
    assert contents(again) == contents(tables) and asked() == first


def test_prompts_reach_the_model(spark):
    echo = BatchModel(lambda: lambda batch: [t.splitlines()[-1] for t in batch])
    tables = run_index(
        files(spark, TREE), settings=settings(prompts=True, document_summaries=[echo], folder_summaries=[echo])
    )
    docs = rows(tables["documents"])
    assert docs["/r/a/one.txt"]["summary"] == "Alpha beta. Gamma."


def test_segment_check(spark):
    tree = {"/r/x.txt": "Page 3\n\n" + "A full sentence that is fine. " * 20}
    everything = run_index(files(spark, tree), settings=settings(chunk_size=40))["segments"]
    judge = BatchModel(lambda: lambda batch: ["Page" not in t for t in batch], "boolean")
    checked = run_index(
        files(spark, tree), settings=settings(chunk_size=40, check_segments=True, segment_check=judge)
    )["segments"]
    assert everything.count() == checked.count() + 1


def test_status(spark):
    scan = spark.createDataFrame([("/a", "1"), ("/b", "2"), ("/c", "3")], "path string, hash string")
    stored = spark.createDataFrame(
        [("i", "/a", "1"), ("j", "/b", "old"), ("k", "/b", "older"), ("l", "/gone", "9")],
        "id string, file_path string, hash string",
    )
    got = {r["path"]: r["status"] for r in classify(scan, stored).collect()}
    assert got == {"/a": "unchanged", "/b": "replaced", "/c": "new"}
    assert {r["status"]: r["n"] for r in index_counts(classify(scan, stored)).collect()} == {
        "unchanged": 1, "replaced": 1, "new": 1,
    }


def test_files_to_snapshot_and_back(spark, tmp_path):
    """The way the README shows, on a real folder."""
    from shelfmark import index_to_snapshot, read_text_files, restore_snapshot, search_documents
    from shelfmark.operators import embed

    root = tmp_path / "corpus"
    for name, text in {"a/one.txt": "Harbour budget.", "a/b/two.txt": "Cats sleep.", "bad.txt": None}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"\xff" if text is None else text.encode())
    store = str(tmp_path / "snapshots")

    def run(stored=None):
        texts = read_text_files(spark, str(root)).where("error is null").drop("error")
        name = index_to_snapshot(texts, store, str(root), stored, Settings(root=str(root)))
        return restore_snapshot(spark, store, name)

    from shelfmark.runtime import scratch_dir

    scratch = lambda: set(os.listdir(scratch_dir(spark).removeprefix("file:")))
    before = scratch()
    run()
    assert scratch() == before
    (root / "a/b/two.txt").write_text("Dogs bark.")
    tables = run(restore_snapshot(spark, store))
    latest = restore_snapshot(spark, store)
    assert contents(latest) == contents(tables)
    assert {r["summary"] for r in latest["documents"].collect()} == {
        "This document Harbour budget.", "This document Dogs bark.",
    }
    assert {r["text"] for r in latest["segments"].collect()} == {"Harbour budget.", "Dogs bark."}
    assert latest["folders"].count() == 3
    asked = spark.createDataFrame([(1, "budget of the harbour")], "query_id long, text string")
    first = search_documents(embed(asked, "text"), latest["documents"], k=1).first()
    assert first["name"] == "one.txt"
