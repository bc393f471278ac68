"""Session settings and the shared folder for cut-off points of iterative jobs."""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, name: str = "topicloom") -> SparkSession:
    """Session for tests and the benchmark; on a cluster spark-submit supplies these settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TOPICLOOM_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster such a folder lives on
    one machine and is lost with it, so the setting is demanded there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="topicloom-"))
    return spark.sparkContext.getCheckpointDir()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class _Scopes(threading.local):
    """Open scopes of a thread: streams that run side by side don't see each other's."""

    def __init__(self):
        self.open: list[list[str]] = []


_scopes = _Scopes()


@contextlib.contextmanager
def step_scope(spark: SparkSession):
    """Delete the tables that ``materialize`` writes inside the block when it ends; write the result before that."""
    _scopes.open.append([])
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _scopes.open.pop():
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def materialize(df: DataFrame, name: str = "step", kept: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of iterative jobs. The table outlives any executor, later rounds read it with
    column pruning, and its file size is what Spark compares with its broadcast limit. It stays until
    the folder is cleared, or until the end of a ``step_scope``; ``kept`` lets it outlive the
    innermost one.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    scopes = _scopes.open[:-1] if kept else _scopes.open
    if scopes:
        scopes[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int, per_part: int = 100_000) -> DataFrame:
    """``df`` in as many partitions as its rows need: one per ``per_part``, but as many as the session has cores.

    ``rows`` bounds the rows of ``df`` and of the tables it is joined from. A step of some thousand rows else becomes a task and a file for every
    shuffle partition, and on a file system without native calls every file starts processes. A larger table keeps its partitions.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_part)))


def by_shuffle(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the table and must not be broadcast.

    A written step is small on disk but not in memory: below the broadcast limit it may hold millions of rows, which would
    all go through the driver.
    """
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for CPU-heavy projections over a small input.

    A file with one row group is read by one task. If the scan has less than half as many splits as
    the session has cores, the rows are dealt out; a large table has many splits and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
