"""Streaming ingest and clustering that grows batch by batch."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.operators.cells import build_cells, knn
from topicloom.operators.density import PIPE_DEFAULTS, condense, label_points, tree_from_edges, weighted_points
from topicloom.operators.ranking import top_in_group
from topicloom.operators.relational import unseen
from topicloom.session import materialize, step_scope, work_path


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def run_to_end(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Work off everything available, one micro-batch after the other."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingest(stream: DataFrame, uid: str, embed: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """Embed and append only articles the target does not hold; a replayed batch adds nothing."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([uid])
        if _exists(spark, target):
            new = unseen(new, spark.read.parquet(target), uid)
        embed(new).write.mode("append").parquet(target)

    run_to_end(stream, each, checkpoint)


class GrowingClusters:
    """Density clusters over batches of new vectors, with all state in tables by batch.

    A batch searches its neighbors among old and new vectors; the tree of the old candidates and the new edges follows from the
    old tree's edges and the new ones alone. Core distances can only shrink as neighbors arrive, and edges are weighed again with
    the current ones; an edge once dropped stays dropped, so labels between full rebuilds are an approximation. Equal vectors are one
    weighted point, whichever batch they come in.

    ``path`` (a folder all executors reach) holds one version per batch: its new ``members`` (id, rep) and ``vectors`` (rep, vector), and the
    whole of ``near`` (the best distances of every point), ``edges`` (candidates) and ``labels``. A version counts once its mark is written,
    after everything else. A batch starts from the last complete version before its own number and overwrites its own. So a process that is
    started again goes on where the last one stopped, and a batch that is replayed changes nothing.
    """

    def __init__(self, uid: str, vec: str, neighbors: int = 8, path: str | None = None, **params):
        self.uid, self.vec, self.path = uid, vec, path
        self.params = {**PIPE_DEFAULTS, **params}
        self.k = max(neighbors, self.params["min_samples"])

    def versions(self, spark: SparkSession) -> list[int]:
        """Numbers of the complete versions, in order."""
        if self.path is None or not _exists(spark, f"{self.path}/complete"):
            return []
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/complete")
        marks = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
        return sorted(int(m.getPath().getName()) for m in marks)

    def _part(self, version: int, name: str) -> str:
        return f"{self.path}/{name}/batch={version}"

    def _read(self, spark: SparkSession, versions: list[int], name: str, like: DataFrame) -> DataFrame:
        """Rows of some versions of a table, none if there is no version."""
        if not versions:
            return spark.createDataFrame([], like.schema)
        return spark.read.schema(like.schema).parquet(*[self._part(v, name) for v in versions])

    def _write(self, df: DataFrame, version: int, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self._part(version, name))
        return df.sparkSession.read.schema(df.schema).parquet(self._part(version, name))

    def _mark(self, spark: SparkSession, version: int) -> None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/complete/{version}")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True).close()

    def add(self, batch: DataFrame, batch_id: int | None = None) -> DataFrame:
        """Take in a batch (by default the one after the last) and return (uid, label) of everything seen so far."""
        spark = batch.sparkSession
        self.path = self.path or work_path(spark, "growing")
        complete = self.versions(spark)
        batch_id = (complete[-1] + 1 if complete else 0) if batch_id is None else batch_id
        with step_scope(spark):
            labels = self._write(self._labels(batch, batch_id, [v for v in complete if v < batch_id]), batch_id, "labels")
        self._mark(spark, batch_id)
        return labels

    def _labels(self, batch: DataFrame, batch_id: int, before: list[int]) -> DataFrame:
        spark, uid, vec, need = batch.sparkSession, self.uid, self.vec, self.params["min_samples"]
        rows = batch.groupBy(uid).agg(F.min(vec).alias(vec))
        like = rows.select(F.col(uid), F.col(uid).alias("rep"))
        old_members = self._read(spark, before, "members", like)
        old_vectors = self._read(spark, before, "vectors", rows.select(F.col(uid).alias("rep"), vec))
        rows = materialize(unseen(rows, old_members, uid), "batch")
        distinct = rows.groupBy(vec).agg(F.min(uid).alias("_first"))
        placed = materialize(distinct.join(old_vectors.withColumnRenamed("rep", "_old"), vec, "left"), "placed")
        new_members = rows.join(placed.select(vec, F.coalesce("_old", "_first").alias("rep")), vec).select(uid, "rep")
        members = old_members.unionByName(self._write(new_members, batch_id, "members"))
        new_vectors = self._write(placed.where(F.col("_old").isNull()).select(F.col("_first").alias("rep"), vec), batch_id, "vectors")
        cells = build_cells(old_vectors.unionByName(new_vectors).select(F.col("rep").alias("_y"), vec), "_y", vec)
        found = materialize(knn(new_vectors, cells, "rep", vec, self.k, same=True).select(F.col("rep").alias("a"), F.col("neighbor").alias("b"), "distance"), "found")
        both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance")).distinct()
        known = both.unionByName(self._read(spark, before[-1:], "near", both))
        near = self._write(top_in_group(known, ["a"], [F.col("distance"), F.col("b")], need).drop("rank"), batch_id, "near")
        groups = materialize(members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies")), "groups")
        lists = top_in_group(near, ["a"], [F.col("distance"), F.col("b")], need).select(F.col("a").alias("rep"), F.col("b").alias("neighbor"), "distance", "rank")
        points = materialize(weighted_points(groups, lists, need), "points")
        fresh = found.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "distance").distinct()
        edges = materialize(fresh.unionByName(self._read(spark, before[-1:], "edges", fresh)).distinct(), "edges")
        tree = tree_from_edges(points, edges, members.select("rep", uid), uid, self.params["alpha"])
        self._write(tree.edges.select("lo", "hi").join(edges, ["lo", "hi"]).select("lo", "hi", "distance"), batch_id, "edges")
        return label_points(tree, condense(tree, [self.params])).drop("run")


def cluster_stream(stream: DataFrame, model: GrowingClusters, target: str, checkpoint: str) -> None:
    """Write (batch_id, uid, label) of all vectors seen so far after every micro-batch; a batch overwrites its own rows only."""

    def each(batch: DataFrame, batch_id: int) -> None:
        model.add(batch, batch_id).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    run_to_end(stream, each, checkpoint)


def file_stream(spark: SparkSession, df: DataFrame, batches: int, order: str, name: str, files: int | None = None) -> DataFrame:
    """Replay ``df`` as a stream: ``batches`` ranges of ``order``, written one after the other as ``files`` files
    each, and read back one range per micro-batch."""
    path = work_path(spark, name)
    files = files or spark.sparkContext.defaultParallelism
    # Only the order column is sorted into the ranges; a range of whole rows would be one task.
    ranges = df.select(order).repartitionByRange(batches, order).groupBy(F.spark_partition_id().alias("range")).agg(F.min(order).alias("start"))
    later = ranges.orderBy("range").collect()[1:]
    passed = [F.coalesce(F.col(order) >= F.lit(r["start"]), F.lit(False)).cast("int") for r in later]
    ranged = materialize(df.withColumn("_batch", functools.reduce(Column.__add__, passed, F.lit(0))), "replay")
    for i in range(batches):
        ranged.where(F.col("_batch") == i).drop("_batch").repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)
