"""Refreshed snapshots: what they restore to, and what they write."""

import pytest
from pyspark.sql import functions as F

from shelfmark.plans import Settings, index_to_snapshot, refresh_snapshot, run_index
from shelfmark.plans.index import _path_filter, _rows_at
from shelfmark.runtime import materialise
from shelfmark.sources import corpus_files, newest_snapshot, restore_snapshot
from shelfmark.sources.snapshots import layers_of


def files(spark, tree):
    rows = spark.createDataFrame(list(tree.items()), "p string, t string")
    return corpus_files(rows, F.col("p"), F.col("t")).drop("p", "t")


def contents(tables):
    return {name: sorted(tuple(map(str, r)) for r in df.drop("created_ms").collect()) for name, df in tables.items()}


TREE = {f"/r/{a}/{b}/f{i}.txt": f"Text {i} of {a} and {b}. It says {i * 7}." for a in "yz" for b in "pq" for i in range(3)}
STEPS = [
    {"/r/y/p/f0.txt": "Another text."},  # changed
    {"/r/y/q/f1.txt": None, "/r/z/p/f2.txt": None, "/r/z/p/f0.txt": None, "/r/z/p/f1.txt": None},  # gone, a whole folder too
    {"/r/y/q/f1.txt": "Text 1 of y and q. It says 7.", "/r/new/deep/er/a.txt": "A new place."},  # back again, and new
    {"/r/y/p/f0.txt": TREE["/r/y/p/f0.txt"]},  # as it was at first
]


@pytest.mark.parametrize("prune, max_layers", [(True, 16), (False, 16), (True, 3)])
def test_refreshed_is_what_a_run_gives(spark, tmp_path, prune, max_layers):
    root, tree = str(tmp_path), dict(TREE)
    settings = Settings(root="/r", now_ms=F.lit(1).cast("long"), prune=prune)
    refresh_snapshot(files(spark, tree), root, "/r", settings)
    stored = restore_snapshot(spark, root, path="/r")
    for step in STEPS[: len(STEPS) if max_layers > 3 else 2]:
        tree = {p: t for p, t in (tree | step).items() if t is not None}
        want = run_index(files(spark, tree), stored, settings)
        name = refresh_snapshot(files(spark, tree), root, "/r", settings, max_layers)
        assert name == newest_snapshot(spark, root, "/r")
        got = restore_snapshot(spark, root, name)
        assert contents(got) == contents(want)
        assert 1 + max(layer[2] for layer in layers_of(spark, root, name)) <= max_layers
        stored = {n: materialise(df) for n, df in want.items()}
    # Nothing changes: no new snapshot, also where files that are gone stay.
    assert refresh_snapshot(files(spark, tree), root, "/r", settings, 99) == name
    if prune:
        assert contents(stored) == contents(run_index(files(spark, tree), settings=settings))


def test_a_layer_is_as_large_as_the_change(spark, tmp_path):
    root = str(tmp_path)
    tree = {f"/r/{i % 40}/f{i}.txt": " ".join(f"w{(i * k) % 9973}." for k in range(1, 120)) for i in range(2000)}
    settings = Settings(root="/r", now_ms=F.lit(1).cast("long"))
    first = index_to_snapshot(files(spark, tree), root, "/r", settings=settings)
    changed = tree | {f"/r/7/f{i}.txt": f"Short now {i}." for i in range(7, 807, 40)}
    second = refresh_snapshot(files(spark, changed), root, "/r", settings)
    assert second != first
    n = lambda snapshot, name: spark.read.parquet(f"{root}/{snapshot}/{name}").count()
    assert (n(first, "documents"), n(second, "documents"), n(second, "documents-gone")) == (2000, 20, 20)
    assert n(second, "segments") <= 20 < 0.02 * n(first, "segments")
    layers = [x for x in layers_of(spark, root, second) if x[0] == "documents"]
    assert [x[3].split("/")[0] for x in layers] == [first, second]
    tables = restore_snapshot(spark, root, second)
    assert tables["documents"].count() == 2000
    # Only the folder of the change and those above it are written.
    assert n(second, "folders") == n(second, "folders-gone") == 2


def test_path_filter(spark):
    texts = spark.range(20_000).select(F.concat(F.lit("/r/"), "id").alias("path"), F.col("id").cast("string").alias("text"))
    paths = materialise(texts.where("id % 40 = 3").select("path"))
    found = _rows_at(texts, paths, few_paths=10)
    assert sorted(r["path"] for r in found.collect()) == sorted(r["path"] for r in paths.collect())
    bits, n_bits = _path_filter(paths, 500)
    assert n_bits == 32_768
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan
    # The filter lets few others pass.
    near = found._jdf.queryExecution().analyzed().toString()
    assert "bitmap" in near
    passed = texts.join(bits, F.bitmap_bucket_number(F.pmod(F.xxhash64("path"), F.lit(n_bits))) == F.col("_bucket")).count()
    assert passed >= paths.count()


def test_snapshots_from_before_layers(spark, tmp_path):
    from shelfmark.sources import write_snapshot

    tables = run_index(files(spark, TREE), settings=Settings(root="/r", now_ms=F.lit(1).cast("long")))
    name = write_snapshot(tables, str(tmp_path), "/r")
    manifest = f"{tmp_path}/{name}/manifest"
    old = spark.createDataFrame([(t, "/r") for t in tables], "table string, path string").collect()
    spark.createDataFrame(old, "table string, path string").write.mode("overwrite").parquet(manifest)
    assert contents(restore_snapshot(spark, str(tmp_path), name)) == contents(tables)
