"""Describing topics: topic documents, class-based TF-IDF, entity votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.operators.ranking import rank_in_group, top_in_group
from topicloom.session import materialize

# Weights of the annotation fields and entity types that do not vote.
ENTITY_WEIGHTS = {"text_ne": 1, "seo_title_ne": 2, "kicker_headline_ne": 3}
SILENT_TYPES = ["NUMBER", "COMMON"]


def topic_documents(
    df: DataFrame, topic: str, uid: str, text: str = "text", headline: str = "headline", rows_per_part: int = 1000
) -> DataFrame:
    """Texts joined by a space and headlines by ``. `` per topic, in parts of at most ``rows_per_part`` articles.

    A topic may hold a third of the corpus, which fits neither one task nor one string; its parts,
    put one behind the other, are the topic document. Terms are counted on the articles instead
    (``c_tf_idf``), so nothing downstream needs the joined string.
    """
    ranked = rank_in_group(df.select(topic, uid, text, headline), [topic], [F.col(uid)])
    part = F.floor((F.col("rank") - 1) / rows_per_part).alias("part")
    rows = F.sort_array(F.collect_list(F.struct("rank", text, headline)))
    return (
        ranked.groupBy(topic, part)
        .agg(F.count(F.lit(1)).alias("articles"), rows.alias("rows"))
        .select(
            topic, "part", "articles",
            F.array_join(F.transform("rows", lambda r: r[text]), " ").alias("doc"),
            F.array_join(F.transform("rows", lambda r: r[headline]), ". ").alias("headlines"),
        )
    )


def c_tf_idf_from_counts(counts: DataFrame, topic: str, m: int | DataFrame) -> DataFrame:
    """Class-based TF-IDF of (topic, term, n): ``n / topic total * ln(m / term total)``.

    Negative if a term occurs more than ``m`` times. ``m`` is the number of articles, or a one-row
    DataFrame holding it. The counts are written once, so that both totals and the scores read the
    reduced table instead of going through the texts three times.
    """
    counts = materialize(counts, "counts")
    topic_total = counts.groupBy(topic).agg(F.sum("n").alias("topic_total"))
    term_total = counts.groupBy("term").agg(F.sum("n").alias("term_total"))
    joined = counts.join(topic_total, topic).join(term_total, "term")
    articles = F.lit(m) if isinstance(m, int) else F.lit(m.first()[0])
    return joined.select(
        topic, "term", "n",
        (F.col("n") / F.col("topic_total") * F.log(articles / F.col("term_total"))).alias("score"),
    )


def c_tf_idf(df: DataFrame, topic: str, terms: Column, m: int | DataFrame) -> DataFrame:
    """Class-based TF-IDF of an array column of terms."""
    counts = (
        df.select(topic, F.explode(terms).alias("term")).groupBy(topic, "term").agg(F.count(F.lit(1)).alias("n"))
    )
    return c_tf_idf_from_counts(counts, topic, m)


def top_terms(scores: DataFrame, topic: str, n: int = 20, digits: int = 9) -> DataFrame:
    """The ``n`` best terms per topic with their rank; scores are rounded first so that ties are real ties."""
    rounded = scores.withColumn("score", F.round("score", digits))
    return top_in_group(rounded, [topic], [F.col("score").desc(), F.col("term")], n)


def topic_label(top: DataFrame, topic: str, n: int, sep: str = " | ") -> DataFrame:
    """The first ``n`` terms per topic joined into a label."""
    return (
        top.where(F.col("rank") <= n).groupBy(topic)
        .agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("terms"))
        .select(topic, F.array_join(F.transform("terms", lambda t: t["term"]), sep).alias("label"))
    )


def entity_terms(df: DataFrame, topic: str, weights: dict[str, int]) -> DataFrame:
    """(topic, entity, type, weighted count) over several parsed entity columns in one pass."""
    def weighted(column: str, w: int) -> Column:
        return F.transform(
            F.col(column), lambda e: F.struct(e["text"].alias("term"), e["type"].alias("type"), F.lit(w).alias("w"))
        )

    tagged = F.flatten(F.array(*[weighted(c, w) for c, w in weights.items()]))
    return (
        df.select(topic, F.explode(tagged).alias("e")).groupBy(topic, F.col("e.term").alias("term"), F.col("e.type").alias("type"))
        .agg(F.sum("e.w").alias("n"))
    )


def entity_vote(df: DataFrame, topic: str, weights: dict[str, int] = ENTITY_WEIGHTS, n: int = 8) -> DataFrame:
    """Label of each topic: its ``n`` entities with the most weighted votes, ties by name."""
    votes = (
        entity_terms(df, topic, weights).where(~F.col("type").isin(*SILENT_TYPES))
        .groupBy(topic, "term").agg(F.sum("n").alias("n"))
    )
    best = top_in_group(votes, [topic], [F.col("n").desc(), F.col("term")], n)
    return topic_label(best, topic, n)


def entity_summary(
    df: DataFrame, topic: str, m: int | DataFrame, sizes: DataFrame, weights: dict[str, int], n: int = 10
) -> DataFrame:
    """Best entity terms per topic by weighted class-based TF-IDF, with the topic size."""
    counts = entity_terms(df, topic, weights).groupBy(topic, "term").agg(F.sum("n").alias("n"))
    best = top_terms(c_tf_idf_from_counts(counts, topic, m), topic, n)
    return topic_label(best, topic, n).join(sizes, topic)
