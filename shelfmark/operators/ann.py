"""Approximate nearest neighbours: compare only vectors that share a hash bucket.

Two ways to use it. :func:`nearest_in_buckets` hashes the corpus while it reads it.
:func:`write_buckets` stores the vectors once per hash table, clustered by bucket, and
:func:`nearest_stored` then reads the row groups of the queries' buckets only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH, BucketedRandomProjectionLSHModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.vectors import l2_norm
from shelfmark.operators.search import (
    _HITS, DEFAULT_K, DIGITS, MAX_QUERIES, _in_batches, _kernel, _vectors, nearest, top_k,
)
from shelfmark.runtime import bounded_rows

# Bucket numbers of one hash table lie within half of this on either side of zero.
TABLE_STEP = 1 << 40


def _unit(df: DataFrame) -> DataFrame:
    scaled = df.withColumn("_norm", l2_norm(F.col("vector")))
    unit = F.transform("vector", lambda x: x / F.when(F.col("_norm") > 0, F.col("_norm")).otherwise(1.0))
    return scaled.withColumn("_unit", array_to_vector(unit)).drop("_norm")


def bucket_model(
    corpus: DataFrame, tables: int = 5, bucket_length: float = 0.5, seed: int = 11
) -> BucketedRandomProjectionLSHModel:
    """Random projections for the dimension of ``corpus``; its rows do not matter otherwise."""
    lsh = BucketedRandomProjectionLSH(
        inputCol="_unit", outputCol="_hashes", numHashTables=tables, bucketLength=bucket_length, seed=seed
    )
    return lsh.fit(_unit(corpus))


def with_buckets(df: DataFrame, model: BucketedRandomProjectionLSHModel) -> DataFrame:
    """``df`` with ``buckets array<long>``: the bucket in each hash table, tables apart."""
    hashed = model.transform(_unit(df))
    buckets = F.transform(
        "_hashes", lambda h, i: i.cast("long") * TABLE_STEP + vector_to_array(h)[0].cast("long")
    )
    return hashed.withColumn("buckets", buckets).drop("_unit", "_hashes")


def _compared(
    asked: list, hashed: DataFrame, k: int, digits: int, counts: bool = False
) -> DataFrame:
    """(query_id, id, distance) of the k nearest candidates in each partition, or with
    ``counts`` (query_id, n_compared). ``asked`` rows are (query_id, vector, buckets); a
    corpus row is a candidate if one of its ``buckets`` is the query's."""
    shared = hashed.sparkSession.sparkContext.broadcast((
        [r["query_id"] for r in asked],
        np.array([r["vector"] for r in asked], dtype=np.float64),
        np.array([r["buckets"] for r in asked], dtype=np.int64),
    ))
    matrix, best, _ = _kernel()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        names, raw, asked_buckets = shared.value
        norms = np.linalg.norm(raw, axis=1, keepdims=True)
        unit = np.divide(raw, norms, out=np.zeros_like(raw), where=norms > 0)
        compared = np.zeros(len(names), dtype=np.int64)
        kept_ids = [np.array([], dtype=object) for _ in names]
        kept = [np.array([], dtype=np.float64) for _ in names]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            vectors = matrix(batch.column(1))
            buckets = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            for q in range(len(names)):
                rows = np.flatnonzero(np.isin(buckets, asked_buckets[q]).any(axis=1))
                compared[q] += len(rows)
                if counts or not len(rows):
                    continue
                distances = np.round(1.0 - vectors[rows] @ unit[q], digits) + 0.0
                all_ids = np.concatenate([kept_ids[q], ids[rows]])
                all_d = np.concatenate([kept[q], distances])
                # A vector stored under several hash tables comes several times.
                once = np.unique(all_ids.astype(str), return_index=True)[1]
                near = once[best(all_d[once], all_ids[once], k)]
                kept_ids[q], kept[q] = all_ids[near], all_d[near]
        if counts:
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(compared, pa.int64())],
                names=["query_id", "n_compared"],
            )
            return
        for q, name in enumerate(names):
            if len(kept[q]):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(kept[q]), pa.int64()),
                        pa.array(kept_ids[q].tolist(), pa.string()),
                        pa.array(kept[q], pa.float64()),
                    ],
                    names=["query_id", "id", "distance"],
                )

    rows = hashed.select("id", "vector", "buckets")
    if counts:
        seen = rows.mapInArrow(scan, "query_id long, n_compared long")
        return seen.groupBy("query_id").agg(F.sum("n_compared").alias("n_compared"))
    return rows.mapInArrow(scan, _HITS)


def _asked(spark: SparkSession, queries: list, model: BucketedRandomProjectionLSHModel) -> list:
    rows = [(int(q[0]), [float(x) for x in q[1]]) for q in queries]
    return with_buckets(spark.createDataFrame(rows, "query_id long, vector array<float>"), model).collect()


def nearest_in_buckets(
    queries: list,
    corpus: DataFrame,
    k: int,
    digits: int,
    tables: int = 5,
    bucket_length: float = 0.5,
    seed: int = 11,
    counts: bool = False,
) -> DataFrame:
    """The k nearest by exact distance among the corpus vectors that share at least one
    bucket with the query. ``queries`` is a bounded list of (query_id, vector).

    With ``counts`` the result is (query_id, n_compared), how many vectors were candidates.
    """
    model = bucket_model(corpus, tables, bucket_length, seed)
    asked = _asked(corpus.sparkSession, queries, model)
    found = _compared(asked, with_buckets(corpus, model), k, digits, counts)
    return found if counts else top_k(found, k)


def write_buckets(corpus: DataFrame, path: str, **lsh) -> None:
    """Store (id, vector) once per hash table under ``path``, clustered by bucket, with the
    projections. A large bucket is spread over several files by id."""
    model = bucket_model(corpus, **lsh)
    model.save(f"{path}/model")
    rows = with_buckets(_vectors(corpus, "id", "vector"), model)
    keyed = rows.select("id", "vector", F.explode("buckets").alias("bucket"), F.xxhash64("id").alias("_at"))
    keyed.repartitionByRange("bucket", "_at").sortWithinPartitions("bucket").drop("_at").write.parquet(
        f"{path}/vectors"
    )


def nearest_stored(queries: DataFrame, path: str, k: int = DEFAULT_K, digits: int = DIGITS) -> DataFrame:
    """As ``nearest(exact=False)`` over vectors stored by :func:`write_buckets`.

    The buckets asked for are a filter on the clustered column, so the scan skips the row
    groups of other buckets. More queries than are broadcast go in batches.
    """
    spark = queries.sparkSession
    few = bounded_rows(_vectors(queries, "query_id", "vector"), MAX_QUERIES)
    if few is None:
        return _in_batches(queries, MAX_QUERIES, k, lambda part: nearest_stored(part, path, k, digits))
    if not few:
        return nearest(queries, queries.selectExpr("string(query_id) id", "vector"), k)
    model = BucketedRandomProjectionLSHModel.load(f"{path}/model")
    asked = _asked(spark, few, model)
    buckets = sorted({b for r in asked for b in r["buckets"]})
    stored = spark.read.parquet(f"{path}/vectors").where(F.col("bucket").isin(buckets))
    found = _compared(asked, stored.withColumn("buckets", F.array("bucket")), k, digits)
    # One row per vector, whatever number of tables it was found in.
    return top_k(found.groupBy("query_id", "id").agg(F.min("distance").alias("distance")), k)
