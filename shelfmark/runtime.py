"""Session, scratch storage and the few execution helpers the operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def session(app: str = "shelfmark", **settings: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Master, memory and shuffle partitions come from the submitted configuration, or from
    ``settings`` (dots as double underscores: ``spark__master="local[8]"``).
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for name, value in settings.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def local_session(app: str, cores: str = "*") -> SparkSession:
    """For benchmarks and checks on one machine."""
    return session(
        app, spark__master=f"local[{cores}]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster in ``spark.checkpoint.dir``.

    Only a local session may go without the setting: it then gets a folder of its own.
    """
    shared = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
    own = tempfile.mkdtemp(prefix="shelfmark-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return own


_scratch_paths: list[str] = []


def new_scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_dir(spark)}/shelfmark-{label}-{uuid.uuid4().hex}"
    _scratch_paths.append(path)
    return path


def drop_scratch(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _scratch_paths.remove(name)


@contextmanager
def temporary_scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the scratch tables that are made inside, once their results are stored elsewhere."""
    before = len(_scratch_paths)
    try:
        yield
    finally:
        for name in _scratch_paths[before:]:
            drop_scratch(spark, name)


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs a re-read, not a re-computation, and
    gives the optimizer real sizes for what follows.
    """
    spark = df.sparkSession
    path = new_scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Give a small scan enough partitions for Python work.

    A scan that already has a task per core is left alone: at that size a shuffle of the
    texts would cost more than it brings. Below it there are fewer input splits than cores,
    so the data is small and the shuffle is cheap. Pass a plain scan (no shuffle in it).
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= 2 * cores:
        return scan
    return scan.repartition(2 * cores, *keys)


def bounded_rows(df: DataFrame, limit: int) -> list | None:
    """All rows of ``df`` if there are at most ``limit``, else None."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def small(df: DataFrame, limit: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else ``df`` as it is.

    Counts, so pass a stored table or something as cheap.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
