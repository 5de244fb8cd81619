"""Listing, reading, sheets, snapshots, schema growth and exports, on real folders."""

import datetime as dt
import os
from decimal import Decimal

import pyarrow.fs as pafs
import pytest
from pyspark.sql import types as T
from shelfmark.schema import DOCUMENTS
from shelfmark.sources import (
    blobs_under, export_contents, latest_snapshot, read_text_files, reconcile, reconcile_tables, render_cells,
    restore_snapshot, scan_files, schema_changes, schema_difference, sheet_texts, write_snapshot,
)
from shelfmark.sources.tree import list_tree, read_contents, store_entries


@pytest.fixture()
def tree(tmp_path):
    files = {
        "a.txt": b"one", "sub/b c+d%20e.txt": "é\r\nzwei\rdrei".encode(), "sub/~$lock.docx": b"",
        "sub/Folder_Contents.xlsx": b"", "sub/deep/x.PDF": b"", "sub/deep/y.pdf": b"%PDF",
        "skip/z.txt": b"z", "bad.txt": b"\xff\xfe\x00", "empty.txt": b"", "note.md": b"m",
    }
    for name, content in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return str(tmp_path)


def test_scan(spark, tree):
    rows = scan_files(spark, tree, ignore=["skip", ""]).collect()
    assert {r["path"].removeprefix(tree) for r in rows} == {
        "/a.txt", "/sub/b c+d%20e.txt", "/sub/deep/y.pdf", "/bad.txt", "/empty.txt",
    }
    row = next(r for r in rows if r["name"] == "y.pdf")
    assert (row["ext"], row["folder"], row["length"]) == ("pdf", f"{tree}/sub/deep", 4)


def test_scan_opens_no_file(spark, tree):
    plan = scan_files(spark, tree)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_ignored_prefix(spark, tree):
    rows = scan_files(spark, tree, ignore=[f"{tree}/sub"]).collect()
    assert {r["name"] for r in rows} == {"a.txt", "z.txt", "bad.txt", "empty.txt"}


def test_read(spark, tree):
    rows = {r["name"]: r for r in read_text_files(spark, tree).collect()}
    assert rows["b c+d%20e.txt"]["text"] == "é\nzwei\ndrei"
    assert rows["empty.txt"]["text"] == "" and rows["empty.txt"]["error"] is None
    assert rows["bad.txt"]["text"] is None and rows["bad.txt"]["error"]


def test_every_file_of_a_tree(spark, tmp_path):
    want = {}
    for i in range(40):
        folder = tmp_path / "/".join(f"{'_.'[i % 2]}d{d}" for d in range(i % 7)) / f"f{i}"
        folder.mkdir(parents=True)
        for name in ("_a.txt", ".b.txt", "c.txt"):
            want[str(folder / name)] = f"{i}{name}" * (i % 3)
            (folder / name).write_bytes(want[str(folder / name)].encode())
    (tmp_path / "round").symlink_to(tmp_path)
    (tmp_path / "link.txt").symlink_to(folder / "c.txt")
    (tmp_path / "dangling.txt").symlink_to(tmp_path / "nowhere")
    os.mkdir(os.fsencode(str(tmp_path)) + b"/\xff")
    with open(os.fsencode(str(tmp_path)) + b"/\xff/x.txt", "wb") as file:
        file.write(b"x")
    want[str(tmp_path / "link.txt")] = want[str(folder / "c.txt")]
    walked = {str(tmp_path / "\ufffd" / "x.txt")}
    for folders_a_task in (1, 3, 1000):
        rows = list_tree(spark, f"file://{tmp_path}/", folders_a_task=folders_a_task).collect()
        assert sorted(r["path"] for r in rows) == sorted([*want, *walked])
        assert all(r["length"] == len(want[r["path"]]) for r in rows if r["path"] in want)
    read = {r["path"]: r for r in read_text_files(spark, str(tmp_path)).collect()}
    assert {p: read[p]["text"] for p in want} == want
    assert all(read[p]["text"] is None and "not readable" in read[p]["error"] for p in walked)
    ignored = list_tree(spark, str(tmp_path), ignore=["_d0"], folders_a_task=1).collect()
    assert {r["path"] for r in ignored} == {p for p in [*want, *walked] if "/_d0/" not in p}


def test_empty_and_missing_trees(spark, tmp_path):
    assert scan_files(spark, str(tmp_path)).count() == 0
    assert read_text_files(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="FileNotFoundError"):
        scan_files(spark, str(tmp_path / "none"))


def test_files_that_go_away_or_are_too_large(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a")
    files = spark.createDataFrame(
        [(str(tmp_path / "a.txt"), 1), (str(tmp_path / "gone.txt"), 5), (str(tmp_path / "huge.txt"), 1 << 40)],
        "path string, length long",
    )
    rows = {r["path"][len(str(tmp_path)) + 1:]: r for r in read_contents(files).collect()}
    assert bytes(rows["a.txt"]["content"]) == b"a" and rows["a.txt"]["error"] is None
    assert rows["gone.txt"]["content"] is None and "not readable" in rows["gone.txt"]["error"]
    assert rows["huge.txt"]["content"] is None and "more than a value" in rows["huge.txt"]["error"]


def test_store_listing_has_whole_uris(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "_a.txt").write_text("abc")
    found = {e[0]: e[1:3] for e in store_entries(pafs.LocalFileSystem(), "s3://", str(tmp_path))}
    inside = str(tmp_path).lstrip("/")
    assert found == {f"s3://{inside}/sub": (True, 0), f"s3://{inside}/_a.txt": (False, 3)}


def test_sheets(spark):
    cells = spark.createDataFrame(
        [("s", r, c, None if (r + c) % 3 == 0 else f"{r}/{c}") for r in range(25) for c in range(3)],
        "path string, row int, col int, value string",
    ).repartition(4)
    want = [
        "".join(("None" if (r + c) % 3 == 0 else f"{r}/{c}") + " " for c in range(3)) + "\n" for r in range(25)
    ]
    assert sheet_texts(cells).first()["text"] == "".join(want)
    parts = sorted((r["part"], r["text"]) for r in render_cells(cells, block_rows=10).collect())
    assert parts == [(0, "".join(want[:10])), (1, "".join(want[10:20])), (2, "".join(want[20:]))]


@pytest.fixture()
def documents(spark):
    rows = [(f"id{i}", f"n{i}.txt", f"/r/f{i % 2}/n{i}.txt", f"/r/f{i % 2}", "txt", f"h{i}", f"s{i}", [float(i)], i) for i in range(6)]
    return spark.createDataFrame(rows, DOCUMENTS)


def test_snapshot_round_trip(spark, documents, tmp_path):
    root = str(tmp_path)
    first = write_snapshot({"documents": documents.limit(2)}, root, "/r one")
    second = write_snapshot({"documents": documents}, root, "/r two")
    assert first.startswith("r_one_10_391_92_6_") and first != second
    newest = restore_snapshot(spark, root)["documents"]
    assert newest.exceptAll(documents).count() == 0 and newest.count() == 6
    assert restore_snapshot(spark, root, first)["documents"].count() == 2


def test_half_written_snapshot_is_not_restored(spark, documents, tmp_path):
    root = str(tmp_path)
    write_snapshot({"documents": documents}, root, "/r")
    documents.limit(1).write.parquet(f"{root}/zz_broken/documents")
    assert latest_snapshot(blobs_under(spark, root)).first()["snapshot"] == "zz_broken"
    assert restore_snapshot(spark, root)["documents"].count() == 6
    with pytest.raises(LookupError):
        restore_snapshot(spark, f"{root}/zz_broken")


def test_latest_needs_a_folder(spark):
    at = lambda day: dt.datetime(2024, 1, day)
    blobs = spark.createDataFrame(
        [("a/1", at(1)), ("a/2", at(5)), ("b/1", at(4)), ("loose", at(9))], "name string, last_modified timestamp"
    )
    assert latest_snapshot(blobs).first()["snapshot"] == "a"


def test_schema_growth(spark):
    old = spark.createDataFrame([("x", 1)], "id string, extra int")
    grown = reconcile(old, DOCUMENTS)
    assert grown.columns[:2] == ["id", "extra"] and set(DOCUMENTS.names) <= set(grown.columns)
    assert grown.schema["vector"].dataType == DOCUMENTS["vector"].dataType
    missing = schema_difference(spark, {"documents": DOCUMENTS}, {"documents": old.schema})
    assert {r["property"] for r in missing.collect()} == set(DOCUMENTS.names) - {"id"}


def test_typed_growth(spark):
    old = spark.sql("""
        select 1 as a, cast(2 as bigint) as b, named_struct('x', 3, 'gone', 'g') as s, array(named_struct('y', 4)) as l,
          map('k', 5) as m, cast(1.5 as decimal(3, 1)) as d, null as v, date'2024-01-02' as t, cast(0.1 as float) as f
        union all select null, null, null, null, null, null, null, null, null""")
    declared = T._parse_datatype_string("""
        a bigint, b double, s struct<n: string, x: bigint>, l array<struct<y: double, z: int>>, m map<string, bigint>,
        d decimal(10, 3), v string, t timestamp_ntz, f double, new int""")
    grown = reconcile(old, declared)
    assert grown.schema.simpleString() == (
        "struct<a:bigint,b:bigint,s:struct<x:bigint,gone:string,n:string>,l:array<struct<y:double,z:int>>,"
        "m:map<string,bigint>,d:decimal(10,3),v:string,t:timestamp_ntz,f:double,new:int>"
    )
    full, empty = sorted(grown.collect(), key=lambda r: r["a"] is None)
    assert (full["a"], full["b"], full["s"].asDict()) == (1, 2, {"x": 3, "gone": "g", "n": None})
    assert (full["l"][0].asDict(), full["m"], full["d"]) == ({"y": 4.0, "z": None}, {"k": 5}, Decimal("1.500"))
    assert (full["t"], full["v"], full["new"]) == (dt.datetime(2024, 1, 2), None, None) and abs(full["f"] - 0.1) < 1e-7
    assert all(value is None for value in empty)
    with pytest.raises(TypeError, match="b: bigint to double"):
        reconcile(old, declared, refuse=True)
    found = {
        r["property"]: r["change"]
        for r in schema_changes(spark, {"t": declared, "u": declared}, {"t": old.schema}).where("table = 't'").collect()
    }
    assert found == {
        "a": "widened", "b": "refused", "s.n": "added", "s.x": "widened", "l.element.y": "widened", "l.element.z": "added",
        "m.value": "widened", "d": "widened", "v": "widened", "t": "widened", "f": "widened", "new": "added",
    }
    tables = reconcile_tables(spark, {"t": old, "other": old}, {"t": declared, "u": declared})
    assert tables["u"].count() == 0 and tables["u"].schema == declared
    assert tables["other"].schema == old.schema and tables["t"].schema == grown.schema


@pytest.mark.parametrize(("stored", "declared", "widens"), [
    ("int", "tinyint", False), ("int", "float", False), ("smallint", "float", True), ("bigint", "decimal(19,0)", True),
    ("bigint", "decimal(20,2)", False), ("decimal(5,2)", "decimal(5,3)", False), ("string", "int", False),
    ("int", "string", False), ("double", "float", False), ("timestamp", "date", False),
    ("array<int>", "int", False), ("struct<a: int>", "array<int>", False),
])
def test_widening_rules(spark, stored, declared, widens):
    df = spark.createDataFrame([], f"x {stored}")
    kind = T._parse_datatype_string(f"x {declared}")
    assert reconcile(df, kind).schema["x"].dataType == (kind if widens else df.schema)["x"].dataType
    if not widens:
        with pytest.raises(TypeError, match="x: "):
            reconcile(df, kind, refuse=True)


def test_export_replaces_the_older_one(spark, documents, tmp_path):
    folders = spark.createDataFrame(
        [("/r", None, "r", "top"), ("/r/f0", "/r", "f0", "zero"), ("/r/f1", "/r", "f1", "one"), ("/r/e", "/r", "e", "empty")],
        "file_path string, parent string, name string, summary string",
    )
    for per_folder in (False, True, False):
        out = f"{tmp_path}/out_{per_folder}"
        export_contents(documents, folders, out, per_folder)
        rows = spark.read.parquet(out).select("folder", "kind_ord", "File", "Summary").collect()
        assert len(rows) == 9
        assert {r["File"] for r in rows if r["folder"] == "/r"} == {"f0", "f1", "e"}
        assert {r["kind_ord"] for r in rows if r["folder"] == "/r/f0"} == {0}
        assert "/r/e" not in {r["folder"] for r in rows}


def test_restore_by_path_and_missing_tables(spark, documents, tmp_path):
    root = str(tmp_path)
    one, two = documents.where("id = id"), documents.limit(1)
    write_snapshot({"documents": one}, root, "/Data A")
    write_snapshot({"documents": two}, root, "/data a")
    restored = restore_snapshot(spark, root, path="/Data A")
    assert restored["documents"].count() == one.count() != 1
    assert restored["folders"].count() == 0 and "hash" in restored["segments"].columns or "text" in restored["segments"].columns
    with pytest.raises(LookupError):
        restore_snapshot(spark, root, path="/none")
    with pytest.raises(LookupError):
        restore_snapshot(spark, f"{root}/empty")


def test_small_and_large_listings_are_the_same(spark, tmp_path, monkeypatch):
    """A listing of few files leaves nothing in the shared folder; a larger one stays there."""
    import os

    from shelfmark.runtime import scratch_dir
    from shelfmark.sources import tree

    (tmp_path / "a").mkdir()
    for name in ("one.txt", "a/_two", "a/.three"):
        (tmp_path / name).write_bytes(b"x" * len(name))
    kept = lambda: len(os.listdir(scratch_dir(spark).removeprefix("file:")))
    before, got = kept(), []
    for limit in (3, 2):
        monkeypatch.setattr(tree, "LOCAL_FILES", limit)
        got.append(sorted(map(tuple, list_tree(spark, str(tmp_path)).collect())))
        assert kept() == before + (limit == 2)
    assert got[0] == got[1] and [r[1] for r in got[0]] == [8, 6, 7]
    (tmp_path / "none").mkdir()
    assert list_tree(spark, str(tmp_path / "none")).count() == 0
