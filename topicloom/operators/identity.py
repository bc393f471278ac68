"""Which cluster of a batch goes on as which cluster of the next one, and names that stay with a cluster over all batches.

Every batch labels all rows seen so far anew, so label numbers mean nothing from one batch to the next; rows do. Clusters of neighboring
batches are matched by the rows they share. All batches are matched in the same rounds, and only counts per pair of clusters are joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.operators.graph import jump
from topicloom.operators.ranking import rank_in_group
from topicloom.session import materialize


def frames(labels: DataFrame, batch: str = "batch_id") -> DataFrame:
    """``labels`` with a number per batch: 1, 2, ... in the order of ``batch``."""
    values = labels.select(batch).where(F.col(batch).isNotNull()).distinct().withColumn("_all", F.lit(0))
    numbers = rank_in_group(values, ["_all"], [F.col(batch)], "frame").drop("_all")
    return labels.join(numbers.withColumn("frame", F.col("frame").cast("int")), batch)


def followed(numbered: DataFrame, uid: str, label: str, noise: int = -1) -> DataFrame:
    """(uid, frame, label, before): each row's cluster, and its cluster one frame earlier, null where it had none.

    One shuffle, by ``uid``. Noise and rows without id or label are left out; of several labels in a frame the smallest counts.
    """
    rows = numbered.where(F.col(uid).isNotNull() & (F.col(label) != noise)).select(F.col(uid).alias("uid"), "frame", F.col(label).alias("label"))
    once = rows.repartition("uid").groupBy("uid", "frame").agg(F.min("label").alias("label"))
    last = lambda c: F.lag(c).over(Window.partitionBy("uid").orderBy("frame"))
    return once.withColumn("before", F.when(last("frame") == F.col("frame") - 1, last("label")))


def overlaps(rows: DataFrame, percent: float) -> tuple[DataFrame, DataFrame]:
    """(frame, label, size), and (frame, before, after, shared, o) for pairs that share ``percent`` of the earlier cluster's rows; ``o`` orders them."""
    sizes = materialize(rows.groupBy("frame", "label").agg(F.count(F.lit(1)).alias("size")), "sizes")
    shared = rows.where("before is not null").groupBy("frame", "before", F.col("label").alias("after")).agg(F.count(F.lit(1)).alias("shared"))
    earlier = sizes.select((F.col("frame") + 1).alias("frame"), F.col("label").alias("before"), F.col("size").alias("_size_before"))
    later = sizes.select("frame", F.col("label").alias("after"), F.col("size").alias("_size_after"))
    pairs = shared.join(earlier, ["frame", "before"]).join(later, ["frame", "after"]).where(100 * F.col("shared") >= percent * F.col("_size_before"))
    order = F.struct((-F.col("shared")).alias("n"), (F.col("_size_before") + F.col("_size_after")).alias("sizes"), "before", "after")
    return sizes, pairs.select("frame", "before", "after", "shared", order.alias("o"))


def match(pairs: DataFrame) -> DataFrame:
    """(frame, before, after, shared): greedy one-to-one matching of each frame, the pairs first in order first.

    Pairs that are the best of both their clusters are taken together, then those of matched clusters are dropped. The first of
    all pairs always is such a pair, so the rounds end, and the result is that of taking one pair after the other.
    """
    pairs, taken = materialize(pairs, "overlaps"), []
    while not pairs.isEmpty():
        best = lambda side: pairs.groupBy("frame", side).agg(F.min("o").alias("o")).select("frame", "o")
        mutual = best("before").join(best("after"), ["frame", "o"])
        taken.append(materialize(mutual.select("frame", "o.before", "o.after", (-F.col("o.n")).alias("shared")), "matched"))
        for side in ("before", "after"):
            pairs = pairs.join(taken[-1].select("frame", side), ["frame", side], "left_anti")
        pairs = materialize(pairs, "overlaps")
    return reduce(DataFrame.unionByName, taken) if taken else pairs.select("frame", "before", "after", "shared")


def identities(labels: DataFrame, uid: str, label: str = "label", batch: str = "batch_id", percent: float = 30, noise: int = -1) -> DataFrame:
    """(frame, label, identity, size, before, shared) per cluster and frame.

    ``labels``: (batch, uid, label), all rows seen so far with every batch. A cluster goes on in the next frame as the one it is matched
    with (``match``: most shared rows, ties to the smaller clusters, then labels), if that holds at least ``percent`` of its rows. ``identity`` is
    the frame and label under which it was first seen, as text. ``before`` and ``shared`` are null for a cluster that is new. Of a split, the part
    with most of the rows keeps the name; of clusters that merge, the one that gives most rows does. Noise and null ids have no part in it.
    """
    rows = materialize(followed(frames(labels, batch), uid, label, noise), "followed")
    sizes, pairs = overlaps(rows, percent)
    matched = match(pairs).withColumnRenamed("after", "label")
    name = lambda frame, of: F.concat_ws(":", frame.cast("string"), F.col(of).cast("string"))
    nodes = materialize(sizes.join(matched, ["frame", "label"], "left").withColumn("node", name(F.col("frame"), "label")), "clusters")
    up = nodes.select("node", F.when(F.col("before").isNotNull(), name(F.col("frame") - 1, "before")).otherwise(F.col("node")).alias("identity"))
    return nodes.join(jump(up, [], "node", "identity"), "node").select("frame", "label", "identity", "size", "before", "shared")


def identity_frames(labels: DataFrame, uid: str, label: str = "label", batch: str = "batch_id", percent: float = 30, noise: int = -1) -> DataFrame:
    """``labels`` with ``frame`` and ``identity``, the table behind an animated plot whose colors stay with a cluster; noise has no identity."""
    named = identities(labels, uid, label, batch, percent, noise).select("frame", F.col("label").alias(label), "identity")
    return frames(labels, batch).join(named, ["frame", label], "left")
