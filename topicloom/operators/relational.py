"""Filters, joins and counts over articles, labels and coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.operators.ranking import top_in_group

OUTLIER = -1
ENTITY_COLUMNS = {
    "kicker_headline_NER": "kicker_headline_ne", "text_NER": "text_ne", "seo_title_NER": "seo_title_ne",
}


def newest(df: DataFrame, limit: int | None = 250, when: str = "created_at", uid: str = "article_uid") -> DataFrame:
    """The newest rows; all of them if ``limit`` is None."""
    ordered = df.orderBy(F.col(when).desc(), F.col(uid))
    return df if limit is None else ordered.limit(limit)


def unseen(df: DataFrame, known: DataFrame, uid: str = "article_uid") -> DataFrame:
    """Rows whose id is not in ``known``."""
    return df.join(known.select(uid), uid, "left_anti")


def with_ids(df: DataFrame, ids: DataFrame | list | None, uid: str = "article_uid") -> DataFrame:
    """All rows, or those with a listed id (a literal list or a DataFrame of ids)."""
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids.select(uid), uid, "left_semi")
    if isinstance(ids, list):
        return df.where(F.col(uid).isin(*ids))
    raise TypeError("ids must be None, a list or a DataFrame")


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    return top_in_group(df, keys, order, 1, "_rank").drop("_rank")


def attach_topic_words(df: DataFrame, words: DataFrame, label: str, topic: str = "topic", how: str = "inner") -> DataFrame:
    """Join topic words to labeled rows. ``left`` keeps rows without words."""
    return df.join(words.withColumnRenamed(topic, label), label, how)


def relink(coordinates: DataFrame, labels: DataFrame, articles: DataFrame, uid: str = "article_uid") -> DataFrame:
    """One row per article: coordinates x, y[, z], topic number, article columns and day as text.

    Entity columns are carried along if the articles have them.
    """
    entity = [F.col(c).alias(n) for c, n in ENTITY_COLUMNS.items() if c in articles.columns]
    text = articles.select(
        uid, "headline", "seo_title", F.col("text").alias("raw_text"), *entity,
        F.date_format("created_at", "yyyy-MM-dd").alias("created_at"),
    )
    axes = [c for c in ("x", "y", "z") if c in coordinates.columns]
    return coordinates.select(uid, *axes).join(labels.select(uid, "topic_number"), uid).join(text, uid)


def outlier_summary(df: DataFrame, label: str) -> DataFrame:
    """Outliers, clustered rows, clustered share and number of clusters without the outliers."""
    out = F.col(label) == OUTLIER
    return df.agg(
        F.count_if(out).alias("outliers"),
        F.count_if(~out).alias("clustered"),
        F.countDistinct(F.when(~out, F.col(label))).alias("clusters"),
    ).withColumn("clustered_share", F.round(F.try_divide(F.col("clustered"), F.col("outliers") + F.col("clustered")), 6))


def topic_sizes(df: DataFrame, topic: str = "Topic") -> DataFrame:
    """Rows per topic with a non-null text, largest first. The text column is ``Doc``, ``title`` or ``headline``."""
    text = next((c for c in ("Doc", "title", "headline") if c in df.columns), None)
    if text is None:
        raise ValueError("need a Doc, title or headline column")
    return df.groupBy(topic).agg(F.count(text).alias("Size")).orderBy(F.col("Size").desc(), topic)


def label_by_day(df: DataFrame, label: str, day: str, labels: list) -> DataFrame:
    """Days as rows, labels as columns, counts as cells. ``labels`` are the columns wanted."""
    return df.groupBy(day).pivot(label, labels).agg(F.count(F.lit(1)))
