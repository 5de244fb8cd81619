"""Approximate nearest neighbours by an inverted file: vectors stored by the cell they lie in.

:func:`write_cells` finds cell centres by k-means on a bounded sample, puts every vector into the
cell of its nearest centre and stores the vectors in one folder per cell. A query is compared,
exactly, with the vectors of its ``probes`` nearest cells; the folders of other cells are not
read. What is skipped depends on the data: vectors that lie evenly in all directions have
neighbours in many cells. :func:`compared` tells how much a search reads, :func:`recall` how much
it finds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.search import DEFAULT_K, DIGITS, MAX_QUERIES, _HITS, _in_batches, _kernel, _vectors, top_k
from shelfmark.runtime import materialise

# Rows that centres are found on, at most about; bytes of all centres, which are broadcast.
SAMPLE_ROWS = 200_000
CENTRE_BYTES = 64 << 20
STEPS = 8
# Products of numbers that the driver makes, at most about, to reduce the starts to centres.
REDUCE_PRODUCTS = 1 << 40
PROBES = 8


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _unit_rows(vectors: pa.ChunkedArray) -> np.ndarray:
    """A column of few vectors at unit length, in single precision."""
    return _kernel()[0](vectors).astype(np.float32)


def find_centres(corpus: DataFrame, n_cells: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> np.ndarray:
    """Unit vectors, one per cell; by default as many as the root of the number of rows, and no
    more than ``CENTRE_BYTES``. Found on all rows or, by a hash of the id, on about ``sample_rows``.

    k-means by cosine: starts drawn in two rounds (k-means||), then ``STEPS`` steps. Points stay in
    their tasks, which multiply blocks of them with all centres and send one sum per cell."""
    n = corpus.count()
    first = corpus.select(F.size("vector")).first()
    if first is None:
        return np.zeros((0, 0), np.float32)
    n_cells = min(n_cells or math.isqrt(n), max(1, CENTRE_BYTES // (4 * max(first[0], 1))), n)
    chosen = corpus
    if n > sample_rows:
        chosen = chosen.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))
    chosen = chosen.where(F.exists("vector", lambda x: x != 0)).select("vector", F.xxhash64("id", "vector", F.lit(seed)).alias("_at"))
    points = materialise(chosen.repartition(2 * corpus.sparkSession.sparkContext.defaultParallelism), "points")
    centres = _starts(points, max(n_cells, 2), seed)
    if not len(centres):
        return np.zeros((1, first[0]), np.float32)
    for _ in range(STEPS):
        centres = _step(points, centres)
    return centres


def _starts(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """At most ``k`` unit vectors far from each other, of about 4 ``k`` points: each round draws 2 ``k``,
    the sooner the farther a point is from those drawn before."""
    drawn = _unit_rows(points.orderBy("_at", "vector").limit(1).select("vector").toArrow().column(0))
    for i in range(1, 3) if len(drawn) else ():
        apart = materialise(_apart(points, drawn), "apart")
        total = apart.agg(F.sum("apart")).first()[0]
        draw = F.pmod(F.xxhash64("_at", F.lit(seed + i)), F.lit(1 << 30)) / (1 << 30)
        new = apart.where(draw * total < 2 * k * F.col("apart")).select("vector").distinct().toArrow()
        # In an order of their own, so that a run is repeated.
        drawn = np.concatenate([drawn, np.unique(_unit_rows(new.column(0)), axis=0)]) if new.num_rows else drawn
    if len(drawn) <= k:
        return drawn
    sizes = _nearest_centres(points.select("vector"), drawn, 1, "vector array<float>").groupBy(F.get("cells", F.lit(0)).alias("i")).count()
    weight = np.zeros(len(drawn))
    for row in sizes.collect():
        weight[row["i"]] = row["count"]
    return _reduced(drawn, weight, k, seed)


def _reduced(points: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` centres of few weighted unit vectors, on the driver: k-means++, then as many steps, up to 30,
    as change something and ``REDUCE_PRODUCTS`` allows."""
    draw = np.random.default_rng(seed)
    apart, taken = np.ones(len(points)), []
    while len(taken) < k:
        chance = weight * apart
        some = min(max(1, k // 2048), k - len(taken), np.count_nonzero(chance))
        if not some:
            break
        new = draw.choice(len(points), some, replace=False, p=chance / chance.sum())
        taken.extend(new)
        # What rounding leaves of the distance of a point to itself is none.
        near = 1.0 - (points @ points[new].T).max(axis=1)
        apart = np.minimum(apart, np.where(near > 1e-6, near, 0))
        apart[new] = 0
    centres, cells = points[taken], None
    for _ in range(max(1, min(30, REDUCE_PRODUCTS // (points.size * k)))):
        before, cells = cells, np.concatenate([(points[i : i + 1024] @ centres.T).argmax(axis=1) for i in range(0, len(points), 1024)])
        if before is not None and (before == cells).all():
            break
        order = np.argsort(cells, kind="stable")
        there, starts = np.unique(cells[order], return_index=True)
        centres[there] = _unit(np.add.reduceat((points * weight[:, None])[order], starts)).astype(np.float32)
    return centres


def _apart(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """``points`` with ``apart``, the distance from the nearest of ``centres``."""
    matrix, _, _ = _kernel()
    shared = points.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            far = []
            for start in range(0, batch.num_rows, 1024):
                rows = matrix(batch.column(0).slice(start, 1024)).astype(np.float32)
                far.append(np.maximum(1.0 - (rows @ shared.value.T).max(axis=1).astype(np.float64), 0.0))
            if far:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(far))], names=["vector", "_at", "apart"])

    return points.mapInArrow(run, "vector array<float>, _at long, apart double")


def _step(points: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The mean direction of the points nearest to each centre; a centre that is nearest to none stays."""
    matrix, _, _ = _kernel()
    shared = points.sparkSession.sparkContext.broadcast(centres)

    def batch_of(cells: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        import numpy as np
        import pyarrow as pa

        order = np.argsort(cells, kind="stable")
        there, starts = np.unique(cells[order], return_index=True)
        total = np.add.reduceat(rows[order], starts)
        offsets = np.arange(0, total.size + 1, total.shape[1], dtype=np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(there.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(total.ravel()))], names=["cell", "total"]
        )

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            if not batch.num_rows:
                continue
            rows, cells = matrix(batch.column(0)), []
            for start in range(0, len(rows), 1024):
                cells.append((rows[start : start + 1024].astype(np.float32) @ shared.value.T).argmax(axis=1))
            yield batch_of(np.concatenate(cells), rows)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        parts = [(b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)) for b in batches if b.num_rows]
        if parts:
            yield batch_of(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

    form = "cell int, total array<double>"
    found = points.select("vector").mapInArrow(sums, form).repartition("cell").mapInArrow(added, form).toArrow()
    moved = centres.copy()
    if found.num_rows:
        moved[found.column("cell").to_numpy()] = _unit_rows(found.column("total"))
    return moved


def _nearest_centres(df: DataFrame, centres: np.ndarray, n: int, columns: str) -> DataFrame:
    """``columns`` of ``df``, of which one is ``vector``, and the ``n`` nearest cells of the vector."""
    matrix, _, _ = _kernel()
    shared = df.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        raw = shared.value.astype(np.float64)
        norms = np.linalg.norm(raw, axis=1, keepdims=True)
        unit = np.divide(raw, norms, out=np.zeros_like(raw), where=norms > 0)
        unit32 = unit.astype(np.float32)
        # Twice the error of a product in single precision, and of the rounding.
        slack = 2 * ((unit.shape[1] + 4) * 2.0**-23 + 1e-9)

        def first(rows: np.ndarray) -> np.ndarray:
            """The first of the nearest cells. Single precision tells which may be it; few rows have more than one."""
            scores = rows.astype(np.float32) @ unit32.T
            cells = scores.argmax(axis=1)
            close = scores >= scores[np.arange(len(rows)), cells][:, None] - np.float32(slack)
            for i in np.flatnonzero(np.count_nonzero(close, axis=1) > 1):
                places = np.flatnonzero(close[i])
                cells[i] = places[np.round(unit[places] @ rows[i], 9).argmax()]
            return cells[:, None]

        for batch in batches:
            if not batch.num_rows:
                continue
            found = []
            rows = matrix(batch.column(batch.schema.get_field_index("vector")))
            for start in range(0, len(rows), 1024):
                part = rows[start : start + 1024]
                best = first(part) if n == 1 else np.argsort(-np.round(part @ unit.T, 9), axis=1, kind="stable")[:, :n]
                found.append(best.astype(np.int32))
            cells = np.concatenate(found)
            offsets = np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells.ravel()))],
                names=[*batch.schema.names, "cells"],
            )

    return df.mapInArrow(run, f"{columns}, cells array<int>")


def write_cells(corpus: DataFrame, path: str, n_cells: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> None:
    """Store the vectors of ``corpus`` (id, vector) by cell under ``path``, with centres and sizes.

    Ranges of (cell, hash of the id) are written, so a cell that holds a third of all vectors is
    spread over many files, and small cells share a task.
    """
    spark = corpus.sparkSession
    rows = _vectors(corpus, "id", "vector").withColumn("id", F.col("id").cast("string"))
    centres = find_centres(rows, n_cells, sample_rows, seed)
    table = [(i, c.tolist()) for i, c in enumerate(centres)]
    spark.createDataFrame(table, "cell int, vector array<float>").write.parquet(f"{path}/centres")
    placed = _nearest_centres(rows, centres, 1, "id string, vector array<float>") if len(centres) else rows.withColumn("cells", F.array(F.lit(0)))
    keyed = placed.select("id", "vector", F.get("cells", F.lit(0)).alias("cell"), F.xxhash64("id").alias("_at"))
    keyed.repartitionByRange("cell", "_at").sortWithinPartitions("cell").drop("_at").write.partitionBy("cell").parquet(f"{path}/vectors")
    _stored(spark, path).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{path}/sizes")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, vector array<float>, cell int").parquet(f"{path}/vectors")


def _asked(queries: DataFrame, path: str, probes: int) -> DataFrame:
    """(query_id, vector, cells)."""
    spark = queries.sparkSession
    centres = spark.read.parquet(f"{path}/centres").orderBy("cell").toArrow().column("vector").to_pylist()
    rows = _vectors(queries, "query_id", "vector").withColumn("query_id", F.col("query_id").cast("long"))
    if not centres:
        return rows.withColumn("cells", F.array().cast("array<int>"))
    return _nearest_centres(rows, np.array(centres, np.float32), probes, "query_id long, vector array<float>")


def nearest_in_cells(
    queries: DataFrame, path: str, k: int = DEFAULT_K, probes: int = PROBES, digits: int = DIGITS, max_queries: int = MAX_QUERIES
) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest vectors in the ``probes`` cells nearest to
    each query, by exact cosine distance. Fewer than k only if these cells hold fewer.

    The cells asked for are a filter on the partition column of the stored vectors. More queries
    than are broadcast go in batches.
    """
    spark = queries.sparkSession
    few = _asked(queries, path, probes).limit(max_queries + 1).toArrow()
    if few.num_rows > max_queries:
        return _in_batches(queries, max_queries, k, lambda part: nearest_in_cells(part, path, k, probes, digits, max_queries))
    if not few.num_rows:
        return spark.createDataFrame([], f"{_HITS}, rank int")
    probed = few.column("cells").combine_chunks()
    cells, asker = probed.flatten().to_numpy(), np.repeat(np.arange(few.num_rows, dtype=np.int32), probed.value_lengths().to_numpy())
    order = np.argsort(cells, kind="stable")
    wanted, starts = np.unique(cells[order], return_index=True)
    by_cell = dict(zip(wanted.tolist(), np.split(asker[order], starts[1:])))
    vectors = few.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(few.num_rows, -1)
    shared = spark.sparkContext.broadcast((few.column("query_id").to_pylist(), vectors, by_cell))
    matrix, _, keeper = _kernel()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        names, raw, askers = shared.value
        keep, _, rows_of = keeper(len(names), k)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, cells = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            rows = matrix(batch.column(1))
            for cell in np.unique(cells):
                inside = np.flatnonzero(cells == cell)
                ids_there, there = ids[inside], rows[inside]
                asking = askers[int(cell)]
                for start in range(0, len(asking), 256):
                    part = asking[start : start + 256]
                    keep(part, np.round(1.0 - matrix(raw[part]) @ there.T, digits), ids_there)
        yield from rows_of(names)

    near = _stored(spark, path).where(F.col("cell").isin(sorted(by_cell)))
    return top_k(near.select("id", "vector", "cell").mapInArrow(scan, _HITS), k)


def compared(queries: DataFrame, path: str, probes: int = PROBES) -> DataFrame:
    """(query_id, n_compared): vectors that a search compares each query with."""
    sizes = queries.sparkSession.read.parquet(f"{path}/sizes")
    cells = _asked(queries, path, probes).select("query_id", F.explode("cells").alias("cell"))
    return cells.join(F.broadcast(sizes), "cell", "left").groupBy("query_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_compared"))


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, n, n_found): exact hits of each query, and how many of them were found. A found
    vector at the distance of the last exact hit stands for one that ties with it."""
    farthest = exact.groupBy("query_id").agg(F.max("distance").alias("_far"), F.count(F.lit(1)).alias("n"))
    good = found.join(farthest, "query_id").where(F.col("distance") <= F.col("_far"))
    counts = good.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_found"))
    return farthest.join(counts, "query_id", "left").select("query_id", "n", F.least("n", F.coalesce("n_found", F.lit(0))).alias("n_found"))
