"""Tidy tables behind scatter, bar, tree and animated plots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.operators.ranking import rank_in_group


def points(linked: DataFrame, label: str, frame_by: str = "created_at") -> DataFrame:
    """Scatter points with the label as text and a frame number per ``frame_by`` value."""
    values = linked.select(frame_by).distinct().withColumn("_all", F.lit(0))
    frames = rank_in_group(values, ["_all"], [F.col(frame_by)], "frame").drop("_all")
    frames = frames.withColumn("frame", F.col("frame").cast("int"))
    return linked.withColumn("labels", F.col(label).cast("string")).join(frames, frame_by)


def bars(linked: DataFrame, label: str, day: str = "created_at", counted: str = "headline") -> DataFrame:
    """Rows per label and day."""
    return linked.groupBy(F.col(label).cast("string").alias("labels"), day).agg(F.count(counted).alias("n"))


def tree_edges(condensed: DataFrame, larger_than: int = 3) -> DataFrame:
    """Treemap rows of a condensed tree: names as text, children above a size."""
    return condensed.where(F.col("child_size") > larger_than).select(
        F.col("child").cast("string").alias("names"), F.col("parent").cast("string").alias("parents"),
        F.col("child_size").alias("values"),
    )
