"""Ranks and neighbors inside groups of any size.

A plain window gathers a whole group in one task. Here the rows are range-partitioned by
(group, order), so a big group spreads over many tasks; ranks and neighbors are made per range and
shifted by the row counts of the ranges before, a table of groups x ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.session import materialize

RANGE = "_range"


def _by_range(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Rows tagged with their range; written out so that the tags are the same for every reader."""
    ranged = df.repartitionByRange(*[F.col(g) for g in group], *order)
    return materialize(ranged.withColumn(RANGE, F.spark_partition_id()), "ranges")


def rank_in_group(df: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Number the rows of each group 1..n by ``order``, which must be unique within the group."""
    ranged = _by_range(df, group, order)
    inside = Window.partitionBy(*group, RANGE).orderBy(*order)
    before = Window.partitionBy(*group).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        ranged.groupBy(*group, RANGE).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        ranged.withColumn("_inside", F.row_number().over(inside))
        .join(shift, [*group, RANGE])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop(RANGE, "_inside", "_before")
    )


def next_in_group(df: DataFrame, group: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """``value`` of the following row of the group, null for the last row."""
    ranged = _by_range(df.withColumn("_value", value), group, order)
    inside = Window.partitionBy(*group, RANGE).orderBy(*order)
    numbered = ranged.withColumn("_inside", F.row_number().over(inside)).withColumn("_ahead_row", F.lead("_value").over(inside))
    first = numbered.where("_inside = 1").select(*group, RANGE, F.col("_value").alias("_first"))
    across = Window.partitionBy(*group).orderBy(RANGE)
    following = first.withColumn("_following", F.lead("_first").over(across)).drop("_first")
    return (
        numbered.join(following, [*group, RANGE])
        .withColumn(name, F.coalesce("_ahead_row", "_following"))
        .drop(RANGE, "_value", "_inside", "_ahead_row", "_following")
    )


def top_in_group(df: DataFrame, group: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group. Spark keeps only ``n`` rows per group and task before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
