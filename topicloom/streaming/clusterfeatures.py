"""Micro-clusters as additive features: any number of tasks keep parts of one key, and the parts add up.

Space is cut into cells of side ``side``, time into panes of length ``pane``. The entry of a (key,
pane, cell) holds sums only: rows, weight, weighted offsets from the cell's corner and their squares,
each sample faded to the end of its pane. Sums are reduced in every task before the shuffle, so a hot
key or cell costs one row per task. The streaming state has one entry per (key, pane, cell); the
watermark closes panes and refuses rows that come later than ``late``.

Weights fade with the clock: a sample of age a counts ``2 ** (-a / half_life)``. Fading by two steps is
fading by their sum, so panes faded on to a common time add up to the same as a pass over all samples.
Unlike ``microclusters`` nothing depends on the order of arrival.

Rows without a time, or with a vector that is null, of another length or not finite, take no part. A null key is a key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from topicloom.operators.density import dbscan
from topicloom.session import materialize

OUTLIER = -1


@dataclass(frozen=True)
class Cells:
    """Cell side, half life in seconds, least weight of a potential cluster; pane length and lateness as Spark intervals."""

    side: float = 1.0
    half_life: float = 86400.0
    threshold: float = 1.5
    pane: str = "1 hour"
    late: str = "1 hour"

    def __post_init__(self):
        if not self.side > 0 or not self.half_life > 0:
            raise ValueError("side and half_life must be above 0")


def cell_of(features: Column, side: float) -> Column:
    """Numbers of the cell that holds a vector."""
    return F.transform(features, lambda v: F.floor(v.cast("double") / side))


def faded(earlier: Column, later: Column, half_life: float) -> Column:
    """What is left at ``later`` of a weight given at ``earlier``; above 1 if ``later`` lies before."""
    return F.pow(F.lit(2.0), (F.unix_micros(earlier) - F.unix_micros(later)) / (half_life * 1e6))


def _sums(dim: int, w: Column, offset, square: Column) -> list[Column]:
    return [F.sum(w).alias("weight"), F.array(*[F.sum(offset(i)) for i in range(dim)]).alias("offset"), F.sum(square).alias("square")]


def cell_features(rows: DataFrame, key: str, features: str, at: str, dim: int, spec: Cells, weight: str | None = None) -> DataFrame:
    """(key, pane, cell, n, weight, offset, square, newest) of a table or a stream; ``pane`` is the pane's end.

    In a stream use the update mode: a changed entry replaces the one written before.
    """
    x = F.col("_x")
    sound = x.isNotNull() & (F.size(x) == dim) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    timed = rows.select(
        F.col(key).alias("key"), F.transform(features, lambda v: v.cast("double")).alias("_x"), F.col(at).cast("timestamp").alias("_at"), w.alias("_w"),
    ).where(sound & F.col("_at").isNotNull()).withWatermark("_at", spec.late)
    placed = timed.select(
        "key", F.window("_at", spec.pane).alias("_window"), "_at", cell_of(x, spec.side).alias("cell"), "_w", "_x")
    w = F.col("_w") * faded(F.col("_at"), F.col("_window.end"), spec.half_life)
    away = [F.col("_x")[i] - F.col("cell")[i] * F.lit(spec.side) for i in range(dim)]
    sums = _sums(dim, w, lambda i: w * away[i], w * sum((d * d for d in away[1:]), away[0] * away[0]))
    return placed.groupBy("key", "_window", "cell").agg(F.count(F.lit(1)).alias("n"), *sums, F.max("_at").alias("newest")).select(
        "key", F.col("_window.end").alias("pane"), "cell", "n", "weight", "offset", "square", "newest")


def keep_features(features: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the changed entries of every micro-batch below ``path``; a replayed batch overwrites its own folder."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return features.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_features(spark: SparkSession, path: str) -> DataFrame:
    """The last state of every entry under ``path``."""
    kept = spark.read.parquet(path)
    values = [c for c in kept.columns if c not in ("key", "pane", "cell", "batch_id")]
    last = kept.groupBy("key", "pane", "cell").agg(F.max_by(F.struct(*values), "batch_id").alias("_last"))
    return last.select("key", "pane", "cell", "_last.*")


def merged(features: DataFrame, dim: int, spec: Cells, at: Column | None = None) -> DataFrame:
    """Micro-clusters (key, cell, n, weight, center, radius, kind) at a time, by default that of the newest sample.

    Features of any panes, lanes or sites are added up; a cluster is potential from the threshold on, else an outlier.
    """
    if at is None:
        newest = features.agg(F.max("newest").alias("t")).first()["t"]
        at = F.lit(newest).cast("timestamp")
    fade = faded(F.col("pane"), at, spec.half_life)
    total = features.groupBy("key", "cell").agg(
        F.sum("n").alias("n"), *_sums(dim, F.col("weight") * fade, lambda i: F.col("offset")[i] * fade, F.col("square") * fade))
    mean = F.transform("offset", lambda o: o / F.col("weight"))
    spread = F.col("square") / F.col("weight") - F.aggregate(mean, F.lit(0.0), lambda s, m: s + m * m)
    center = F.zip_with("cell", mean, lambda c, m: c * F.lit(spec.side) + m)
    return total.where("weight > 0").select(
        "key", "cell", "n", "weight", center.alias("center"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("radius"),
        F.when(F.col("weight") >= spec.threshold, "potential").otherwise("outlier").alias("kind"))


def cluster_labels(clusters: DataFrame, eps: float, min_samples: float) -> DataFrame:
    """(key, cell, label): weighted DBSCAN over the centers of potential micro-clusters, of all keys together."""
    name = F.concat_ws("/", F.coalesce(F.col("key").cast("string"), F.lit("")), F.array_join(F.transform("cell", lambda c: c.cast("string")), "/"))
    potential = materialize(clusters.where("kind = 'potential'").select(name.alias("_c"), "key", "cell", F.col("center").alias("_v"), "weight"), "potential")
    if potential.isEmpty():
        return potential.select("key", "cell", F.lit(OUTLIER).alias("label"))
    found = dbscan(potential, "_c", "_v", eps, min_samples, "weight")
    return potential.join(found.select("_c", "label"), "_c").select("key", "cell", "label")


def sample_labels(samples: DataFrame, uid: str, key: str, features: str, labels: DataFrame, spec: Cells) -> DataFrame:
    """(uid, label): the label of the sample's own cell; without a potential cluster there, an outlier."""
    placed = samples.select(F.col(uid), F.col(key).alias("key"), cell_of(F.col(features), spec.side).alias("cell"))
    named = labels.select(F.col("key").alias("_k"), F.col("cell").alias("_c"), "label")
    here = F.col("key").eqNullSafe(F.col("_k")) & (F.col("cell") == F.col("_c"))
    return placed.join(named, here, "left").select(uid, F.coalesce("label", F.lit(OUTLIER)).cast("int").alias("label"))
