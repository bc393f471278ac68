"""Similarity and search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from topicloom.catalog.base import query, table
from topicloom.catalog.topics import VOCAB_SQL, known_words
from topicloom.operators import descent as ds
from topicloom.operators import similarity as sm


def unit(spark, sf):
    """Embeddings with unit length, in double precision."""
    from topicloom.functions.vectors import normalize

    return table(spark, sf, "embeddings").select("vec_id", normalize(F.col("embedding")).alias("embedding"), "label")


def raw(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")


UNIT = """l AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS len FROM embeddings),
  u AS (SELECT vec_id, label, list_transform(e, lambda x: x / len) AS e FROM l)"""
RAW = "u AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


def _nearest_sql(expr: str, k: int, base: str, self_too: bool = True) -> str:
    where = "" if self_too else "WHERE a.vec_id <> b.vec_id"
    return f"""WITH {base}, d AS (SELECT a.vec_id, b.vec_id AS neighbor, {expr} AS distance FROM u a, u b {where}),
  r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(distance, 9), neighbor) AS rank FROM d)
SELECT vec_id, neighbor, CAST(rank AS INTEGER) AS rank, abs(round(distance, 6)) AS distance FROM r WHERE rank <= {k}"""


def _rounded(df):
    return df.withColumn("distance", F.abs(F.round("distance", 6)))


@query("nearest_cosine", _nearest_sql("1 - list_inner_product(a.e, b.e)", 10, UNIT))
def nearest_cosine(spark, sf):
    e = unit(spark, sf)
    return _rounded(sm.nearest(e, e, "vec_id", "embedding", 10, "cosine"))


@query("nearest_angular", _nearest_sql("acos(least(greatest(list_inner_product(a.e, b.e), -1), 1)) / pi()", 10, UNIT, False))
def nearest_angular(spark, sf):
    e = unit(spark, sf)
    return _rounded(sm.nearest(e, e, "vec_id", "embedding", 10, "angular", include_self=False))


@query("nearest_euclidean", _nearest_sql("list_distance(a.e, b.e)", 5, RAW))
def nearest_euclidean(spark, sf):
    e = raw(spark, sf)
    return _rounded(sm.nearest(e, e, "vec_id", "embedding", 5, "euclidean"))


@query("nearest_cityblock", _nearest_sql("list_sum(list_transform(list_zip(a.e, b.e), lambda p: abs(p[1] - p[2])))", 5, RAW, False))
def nearest_cityblock(spark, sf):
    e = raw(spark, sf)
    return _rounded(sm.nearest(e, e, "vec_id", "embedding", 5, "cityblock", include_self=False))


@query("nearest_sqeuclidean", _nearest_sql("list_distance(a.e, b.e) * list_distance(a.e, b.e)", 5, RAW))
def nearest_sqeuclidean(spark, sf):
    e = raw(spark, sf)
    return _rounded(sm.nearest(e, e, "vec_id", "embedding", 5, "sqeuclidean"))


@query("nearest_many_cells", _nearest_sql("list_distance(a.e, b.e)", 5, RAW))
def nearest_many_cells(spark, sf):
    """The same search over many small cells and blocks."""
    e = raw(spark, sf)
    return _rounded(sm.nearest(e, e, "vec_id", "embedding", 5, "euclidean", cell_rows=32, block_rows=64))


@query("nearest_to_clusters", f"""WITH {UNIT}, c AS (SELECT label, dim, avg(v) AS m FROM (SELECT label, unnest(e) AS v, generate_subscripts(e, 1) AS dim FROM u) GROUP BY label, dim),
  n AS (SELECT label, list(m ORDER BY dim) AS c FROM c GROUP BY label), z AS (SELECT label, ceil(count(*) / 5) AS k FROM u GROUP BY label),
  d AS (SELECT n.label, u.vec_id AS neighbor, 1 - list_inner_product(n.c, u.e) AS distance FROM n, u),
  r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(distance, 9), neighbor) AS rank FROM d)
SELECT label, neighbor, CAST(rank AS BIGINT) AS rank, round(distance, 6) AS distance FROM r JOIN z USING (label) WHERE rank <= k""")
def nearest_to_clusters(spark, sf):
    e = unit(spark, sf)
    return _rounded(sm.nearest_to_centroids(e, e, "vec_id", "embedding", "label", 5)).select("label", "neighbor", F.col("rank").cast("long").alias("rank"), "distance")


@query("approximate_nearest")
def approximate_nearest(spark, sf):
    """Nearest rows from the two nearest cells only."""
    e = unit(spark, sf)
    return _rounded(sm.nearest(e, e, "vec_id", "embedding", 10, "cosine", probes=2, cell_rows=128))


@query("search_by_article", f"""WITH {UNIT}, q AS (SELECT vec_id AS query, e AS qe FROM u WHERE vec_id = 7),
  s AS (SELECT query, vec_id, round(list_inner_product(e, qe), 9) AS score FROM u, q),
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, source, CAST(DATE '2020-09-01' + CAST(doc_id % 14 AS INTEGER) AS VARCHAR) AS created_at
FROM r JOIN documents ON doc_id = vec_id WHERE rank <= 20""")
def search_by_article(spark, sf):
    """Articles most similar to a stored one, best first, then by date."""
    from topicloom.catalog.base import articles

    found = sm.search(unit(spark, sf), "vec_id", "embedding", [7], 20)
    info = articles(spark, sf).select(F.col("article_uid").alias("vec_id"), "source", F.col("created_at").cast("string").alias("created_at"))
    return found.join(info, "vec_id").withColumn("score", F.round("score", 6)).orderBy(F.col("score").desc(), "created_at", "vec_id")


@query("similar_pairs", f"""WITH {UNIT}, d AS (SELECT a.vec_id, b.vec_id AS neighbor, list_inner_product(a.e, b.e) AS score FROM u a, u b WHERE a.vec_id <> b.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, neighbor) AS rk FROM d),
  p AS (SELECT DISTINCT least(vec_id, neighbor) AS a, greatest(vec_id, neighbor) AS b, round(score, 6) AS score FROM r WHERE rk <= 20)
SELECT a, b, score, x.source AS title_a, y.source AS title_b FROM p JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b WHERE score >= 0.3""")
def similar_pairs(spark, sf):
    """Top-k report: pairs above a similarity among the 20 most similar rows of each row, with the titles of both sides."""
    pairs = sm.similar_pairs(unit(spark, sf), "vec_id", "embedding", 20).withColumn("score", F.round("score", 6)).where("score >= 0.3")
    titles = table(spark, sf, "documents", "doc_id", "source")
    a = titles.select(F.col("doc_id").alias("a"), F.col("source").alias("title_a"))
    b = titles.select(F.col("doc_id").alias("b"), F.col("source").alias("title_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "score", "title_a", "title_b")


@query("most_similar_words", rf"""WITH {VOCAB_SQL}, l AS (SELECT word, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM words),
  u AS (SELECT word, list_transform(v, lambda x: x / n) AS v FROM l),
  m AS (SELECT list(x ORDER BY dim) AS m FROM (SELECT dim, avg(x) AS x FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM u WHERE word IN ('the', 'and')) GROUP BY dim))
SELECT word, round(list_inner_product(v, m) / sqrt(list_inner_product(m, m)), 6) AS score FROM u, m WHERE word NOT IN ('the', 'and') ORDER BY round(list_inner_product(v, m) / sqrt(list_inner_product(m, m)), 9) DESC, word LIMIT 10""")
def most_similar_words(spark, sf):
    return sm.most_similar_words(known_words(spark, sf), ["the", "and"], 10).withColumn("score", F.round("score", 6))


def _silhouette_sql(base: str, d: str) -> str:
    return f"""WITH {base}, d AS (SELECT a.vec_id, a.label, b.label AS other, a.vec_id = b.vec_id AS self, {d} AS d FROM u a, u b),
  m AS (SELECT vec_id, label, other, sum(d) AS s, count(*) AS n FROM d WHERE NOT self GROUP BY ALL),
  ab AS (SELECT vec_id, label, max(CASE WHEN other = label THEN s / n END) AS a, min(CASE WHEN other <> label THEN s / n END) AS b FROM m GROUP BY vec_id, label)
SELECT vec_id, label, round(coalesce((b - a) / greatest(a, b), 0), 6) AS silhouette FROM ab"""


@query("silhouette_cosine", _silhouette_sql(UNIT, "1 - list_inner_product(a.e, b.e)"))
def silhouette_cosine(spark, sf):
    return sm.silhouette_rows(raw(spark, sf), "vec_id", "embedding", "label", "cosine").withColumn("silhouette", F.round("silhouette", 6))


@query("silhouette_squared", _silhouette_sql(RAW, "list_distance(a.e, b.e) * list_distance(a.e, b.e)"))
def silhouette_squared(spark, sf):
    return sm.silhouette_rows(raw(spark, sf), "vec_id", "embedding", "label", "sqeuclidean").withColumn("silhouette", F.round("silhouette", 6))


@query("pairs_above_score", f"""WITH {UNIT}, g AS (SELECT e, min(vec_id) AS rep, count(*) AS copies FROM u GROUP BY e)
SELECT x.rep AS a, y.rep AS b, round(list_inner_product(x.e, y.e), 6) AS score, x.copies AS copies_a, y.copies AS copies_b
FROM g x JOIN g y ON x.rep < y.rep WHERE list_inner_product(x.e, y.e) >= 0.25""")
def pairs_above_score(spark, sf):
    """All pairs of vectors above a similarity, however many a row has."""
    return sm.pairs_above(unit(spark, sf), "vec_id", "embedding", 0.25, cell_rows=128).withColumn("score", F.round("score", 6))


def fractional(a, b):
    """Minkowski distance of order one half, dimension by dimension; triangles may be broken."""
    x, y, out = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), np.zeros((len(a), len(b)))
    size = max(1, (1 << 14) // max(len(b), 1))  # strips that stay in the processor's cache
    for at in range(0, len(a), size):
        part, step = out[at : at + size], np.empty((min(size, len(a) - at), len(b)))
        for p, q in zip(x, y, strict=True):
            np.subtract(p[at : at + size, None], q, out=step)
            np.abs(step, out=step)
            part += np.sqrt(step, out=step)
    return np.square(out, out=out)


@query("nearest_fractional", _nearest_sql("power(list_sum(list_transform(list_zip(a.e, b.e), lambda p: sqrt(abs(p[1] - p[2])))), 2)", 5, RAW, False).replace(
    "round(distance, 6)", "round(distance, 4)"))
def nearest_fractional(spark, sf):
    """Nearest rows by a distance given as a function."""
    e = raw(spark, sf)
    found = sm.nearest(e, e, "vec_id", "embedding", 5, fractional, include_self=False)
    return found.withColumn("distance", F.abs(F.round("distance", 4)))


@query("graph_recall", """SELECT count(*) AS rows, true AS good FROM embeddings""")
def graph_recall(spark, sf):
    """Whether the neighbor graph by descent finds at least 90 % of the ten nearest rows."""
    e = unit(spark, sf)
    found = ds.nearest(e, "vec_id", "embedding", 10, "cosine", k=40, sample=15).select("vec_id", "neighbor")
    true = sm.nearest(e, e, "vec_id", "embedding", 10, "cosine", include_self=False).select("vec_id", "neighbor")
    hits = true.join(found.withColumn("hit", F.lit(1)), ["vec_id", "neighbor"], "left").agg(F.count("hit").alias("hits"), F.count("*").alias("all"))
    rows = e.agg(F.count("*").alias("rows"))
    return hits.join(rows).select("rows", (10 * F.col("hits") >= 9 * F.col("all")).alias("good"))
