"""Topic words, features and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.catalog.base import in_list, query, rules_sql, table
from topicloom.functions import stopwords as sw
from topicloom.functions import text as tx
from topicloom.functions import vectors as vx
from topicloom.operators import features as ft
from topicloom.operators import metrics as mt
from topicloom.operators import tokens as tk
from topicloom.operators import topics as tp
from topicloom.session import materialize

STOP = sw.default_stopwords()

_SCORES = """t AS (SELECT topic, sum(n) AS tn FROM c GROUP BY topic), g AS (SELECT term, sum(n) AS gn FROM c GROUP BY term),
  s AS (SELECT topic, term, n, n / tn * ln((SELECT count(*) FROM documents) / gn) AS score FROM c JOIN t USING (topic) JOIN g USING (term))"""
_CLEAN_WORDS = rf"regexp_extract_all(lower({rules_sql('text', tx.cleaning_rules(newline=' '))}), '[\p{{L}}\p{{N}}_]{{2,}}')"
_COUNTS = f"""c AS (SELECT topic, term, count(*) AS n FROM (SELECT source AS topic, unnest({_CLEAN_WORDS}) AS term FROM documents)
  WHERE term NOT IN ({in_list(STOP)}) GROUP BY topic, term)"""
_TOP = "r AS (SELECT topic, term, n, round(score, 9) AS score, row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, term) AS rank FROM s)"


def _terms():
    return sw.drop_stopwords(tx.words(tx.clean_article(F.col("text"), newline=" ")), STOP)


def _docs(spark, sf):
    return table(spark, sf, "documents", "doc_id", "source", "text").select("doc_id", F.col("source").alias("topic"), "text")


def _size(spark, sf):
    return table(spark, sf, "documents", "doc_id").agg(F.count(F.lit(1)))


@query("topic_words", f"WITH {_COUNTS}, {_SCORES}, {_TOP} SELECT topic, term, n, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20")
def topic_words(spark, sf):
    """Which words describe each topic: clean, tokenize, class-based TF-IDF, best 20."""
    return tp.top_terms(tp.c_tf_idf(_docs(spark, sf), "topic", _terms(), _size(spark, sf)), "topic", 20)


@query("c_tf_idf", f"WITH {_COUNTS}, {_SCORES} SELECT topic, term, n, round(score, 9) AS score FROM s")
def c_tf_idf(spark, sf):
    scores = tp.c_tf_idf(_docs(spark, sf), "topic", _terms(), _size(spark, sf))
    return scores.withColumn("score", F.round("score", 9))


_BIGRAMS = rf"""w AS (SELECT source AS topic, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM documents),
  c AS (SELECT topic, term, count(*) AS n FROM (SELECT topic, unnest(w) AS term FROM w
    UNION ALL SELECT topic, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1])) FROM w WHERE len(w) >= 2) GROUP BY topic, term)"""


@query("topic_bigrams", f"WITH {_BIGRAMS}, {_SCORES}, {_TOP} SELECT topic, term, n, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20")
def topic_bigrams(spark, sf):
    """Terms of one and two words."""
    grams = vx.let(tx.words(F.col("text")), lambda t: F.concat(t, tx.ngrams(t, 2)))
    return tp.top_terms(tp.c_tf_idf(_docs(spark, sf), "topic", grams, _size(spark, sf)), "topic", 20)


@query("topic_labels", f"WITH {_COUNTS}, {_SCORES}, {_TOP} SELECT topic, string_agg(term, ' | ' ORDER BY rank) AS label FROM r WHERE rank <= 7 GROUP BY topic")
def topic_labels(spark, sf):
    top = tp.top_terms(tp.c_tf_idf(_docs(spark, sf), "topic", _terms(), _size(spark, sf)), "topic", 20)
    return tp.topic_label(top, "topic", 7)


_TF = r"""n AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents) GROUP BY doc_id, term)"""


@query("tf_idf", f"""WITH {_TF}, d AS (SELECT term, count(*) AS df FROM n GROUP BY term),
  w AS (SELECT doc_id, term, n * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM n JOIN d USING (term)),
  l AS (SELECT doc_id, sqrt(sum(w * w)) AS len FROM w GROUP BY doc_id)
SELECT doc_id, term, round(w / len, 9) AS weight FROM w JOIN l USING (doc_id)""")
def tf_idf(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text")
    counts = tk.term_counts(docs, ["doc_id"], tx.words(F.col("text")))
    return ft.tf_idf(counts, "doc_id", docs.count()).withColumn("weight", F.round("weight", 9))


_HASHED = r"""n AS (SELECT doc_id, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % 64 AS dim, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents) GROUP BY ALL),
  l AS (SELECT doc_id, sqrt(sum(n * n)) AS len FROM n GROUP BY doc_id)"""


@query("hashed_embeddings", f"WITH {_HASHED} SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(n / len, 9) AS value FROM n JOIN l USING (doc_id)")
def hashed_embeddings(spark, sf):
    vec = table(spark, sf, "documents", "doc_id", "text").select("doc_id", ft.hashed_embedding(tx.words(F.col("text"))).alias("v"))
    return vec.select("doc_id", F.posexplode("v").alias("dim", "value")).where("value <> 0").withColumn("value", F.round("value", 9))


VOCAB_SQL = r"""vocab AS (SELECT term AS word, row_number() OVER (ORDER BY count(*) DESC, term) - 1 AS id
  FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents) GROUP BY term),
  words AS (SELECT word, embedding FROM vocab JOIN embeddings ON vec_id = id)"""


def known_words(spark, sf):
    """Word vectors: the most frequent words of the corpus take the rows of the embeddings table in turn."""
    from topicloom.operators.ranking import rank_in_group

    counts = tk.term_counts(table(spark, sf, "documents", "text"), [], tx.words(F.col("text")))
    ranked = rank_in_group(counts.withColumn("_all", F.lit(0)), ["_all"], [F.col("n").desc(), F.col("term")], "id")
    emb = table(spark, sf, "embeddings").select((F.col("vec_id") + 1).alias("id"), F.col("embedding").alias("vector"))
    return ranked.join(emb, "id").select(F.col("term").alias("word"), "vector")


DIMS = 64


def _pooled_sql(agg: str) -> str:
    return f"""WITH {_TF}, {VOCAB_SQL} SELECT doc_id, {agg} FROM n JOIN words ON word = term GROUP BY doc_id"""


@query("pooled_mean", _pooled_sql(", ".join(f"round(sum(n * CAST(embedding[{i}] AS DOUBLE)) / sum(n), 6) AS d{i}" for i in (1, 2, 64))))
def pooled_mean(spark, sf):
    """Mean-pooled word vectors; three of the dimensions are shown."""
    docs = table(spark, sf, "documents", "doc_id", "text")
    out = ft.pool_tokens(docs, "doc_id", tx.words(F.col("text")), known_words(spark, sf), DIMS)
    return out.select("doc_id", *[F.round(F.col("embedding")[i - 1], 6).alias(f"d{i}") for i in (1, 2, 64)])


@query("pooled_max", _pooled_sql(", ".join(f"round(max(CAST(embedding[{i}] AS DOUBLE)), 6) AS d{i}" for i in (1, 2, 64))))
def pooled_max(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text")
    out = ft.pool_tokens(docs, "doc_id", tx.words(F.col("text")), known_words(spark, sf), DIMS, "max")
    return out.select("doc_id", *[F.round(F.col("embedding")[i - 1], 6).alias(f"d{i}") for i in (1, 2, 64)])


_UNNEST = "SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings"


@query("normalized", f"""WITH u AS ({_UNNEST}), l AS (SELECT vec_id, sqrt(sum(CAST(v AS DOUBLE) * v)) AS len FROM u GROUP BY vec_id)
SELECT vec_id, CAST(dim - 1 AS INTEGER) AS dim, round(v / len, 6) AS value FROM u JOIN l USING (vec_id)""")
def normalized(spark, sf):
    v = vx.normalize(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(v).alias("dim", "value")).withColumn("value", F.round("value", 6))


@query("standardized", f"""WITH u AS ({_UNNEST}), s AS (SELECT dim, avg(CAST(v AS DOUBLE)) AS m, stddev_pop(CAST(v AS DOUBLE)) AS sd FROM u GROUP BY dim)
SELECT vec_id, CAST(dim - 1 AS INTEGER) AS dim, round((v - m) / sd, 6) AS value FROM u JOIN s USING (dim)""")
def standardized(spark, sf):
    out = ft.standardize(table(spark, sf, "embeddings", "vec_id", "embedding"), "embedding", DIMS)
    return out.select("vec_id", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query("mean_of_two", """WITH a AS (SELECT vec_id, label, embedding FROM embeddings), b AS (SELECT vec_id AS id, embedding AS other FROM embeddings)
SELECT vec_id, round((CAST(embedding[1] AS DOUBLE) + other[1]) / 2, 6) AS first, round((CAST(embedding[64] AS DOUBLE) + other[64]) / 2, 6) AS last
FROM a JOIN b ON id = (vec_id + 1) % (SELECT count(*) FROM embeddings)""")
def mean_of_two(spark, sf):
    """Mean of a vector and its follower's."""
    emb = table(spark, sf, "embeddings", "vec_id", "embedding")
    other = emb.select(((F.col("vec_id") - 1 + emb.count()) % emb.count()).alias("vec_id"), F.col("embedding").alias("other"))
    m = emb.join(other, "vec_id").withColumn("m", vx.mean_of(F.col("embedding"), F.col("other")))
    return m.select("vec_id", F.round(F.col("m")[0], 6).alias("first"), F.round(F.col("m")[63], 6).alias("last"))


@query("known_vocabulary", rf"""WITH {VOCAB_SQL} SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS word FROM benchmark)
WHERE word IN (SELECT word FROM words) GROUP BY word""")
def known_vocabulary(spark, sf):
    """Words of the benchmark items that have a vector."""
    counts = tk.term_counts(table(spark, sf, "benchmark"), [], tx.words(F.col("text"))).withColumnRenamed("term", "word")
    return counts.join(known_words(spark, sf).select("word"), "word", "left_semi")


_SIF = ", ".join(f"round(sum(n * 0.001 / (0.001 + total) * CAST(embedding[{i}] AS DOUBLE)) / sum(n), 9) AS d{i}" for i in (1, 2, 64))


@query("sif_vectors", f"""WITH {_TF}, {VOCAB_SQL}, k AS (SELECT doc_id, term, n, n AS total FROM n WHERE term NOT IN ({in_list(STOP)}))
SELECT doc_id, {_SIF} FROM k JOIN words ON word = term GROUP BY doc_id""")
def sif_vectors(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text")
    counts = tk.term_counts(docs, ["doc_id"], sw.drop_stopwords(tx.words(F.col("text")), STOP))
    out = ft.sif_vectors(counts, ["doc_id"], known_words(spark, sf), DIMS)
    return out.select("doc_id", *[F.round(F.col("sif")[i - 1], 9).alias(f"d{i}") for i in (1, 2, 64)])


_PAIRS = r"""turns AS (SELECT conv_id, turn // 2 AS pair, turn % 2 AS side, text FROM conversations),
  n AS (SELECT conv_id, pair, side, term, count(*) AS n FROM (SELECT conv_id, pair, side, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM turns) GROUP BY ALL),
  f AS (SELECT conv_id, pair, term, sum(n) AS total FROM n GROUP BY ALL)"""


@query("sif_pair_vectors", f"WITH {_PAIRS}, {VOCAB_SQL} SELECT conv_id, CAST(pair AS BIGINT) AS pair, CAST(side AS BIGINT) AS side, {_SIF} FROM n JOIN f USING (conv_id, pair, term) JOIN words ON word = term GROUP BY conv_id, pair, side")
def sif_pair_vectors(spark, sf):
    """SIF vectors of two texts with the counts of the pair: consecutive turns."""
    turns = table(spark, sf, "conversations").select(
        "conv_id", F.floor(F.col("turn") / 2).alias("pair"), (F.col("turn") % 2).alias("side"), "text"
    )
    counts = materialize(tk.term_counts(turns, ["conv_id", "pair", "side"], tx.words(F.col("text"))), "counts")
    total = counts.groupBy("conv_id", "pair", "term").agg(F.sum("n").alias("total"))
    out = ft.sif_vectors(counts, ["conv_id", "pair", "side"], known_words(spark, sf), DIMS, frequency=total)
    return out.select("conv_id", "pair", F.col("side").cast("long").alias("side"), *[F.round(F.col("sif")[i - 1], 9).alias(f"d{i}") for i in (1, 2, 64)])


@query("training_pairs", f"""WITH p AS (SELECT a.conv_id * 100000 + a.turn AS uid, {rules_sql('lower(a.text)', tx.HARD_RULES)} AS headline, {rules_sql('lower(b.text)', tx.HARD_RULES)} AS seo_title
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT uid, headline, seo_title, CAST(1.0 AS DOUBLE) AS label, CASE WHEN CAST(('0x' || substr(md5(uid || ':1'), 1, 8)) AS BIGINT) % 100 < 20 THEN 'test' ELSE 'train' END AS part
FROM p WHERE length(headline) > 3 AND length(seo_title) > 3""")
def training_pairs(spark, sf):
    turns = table(spark, sf, "conversations")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    pairs = turns.join(following, ["conv_id", "turn"]).withColumn("uid", F.col("conv_id") * 100000 + F.col("turn"))
    return ft.training_pairs(pairs, "uid", tx.clean_hard(F.col("text")), tx.clean_hard(F.col("other")))


_CONT = """c AS (SELECT doc_id, quality AS truth, doc_id % 7 AS predicted FROM labels),
  n AS (SELECT truth, predicted, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT truth, sum(n) AS n FROM n GROUP BY truth), p AS (SELECT predicted, sum(n) AS n FROM n GROUP BY predicted),
  e AS (SELECT (SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) FROM t) AS ht, (SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) FROM p) AS hp, (SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) FROM n) AS hj),
  m AS (SELECT (ht + hp - hj) / ht AS h, (ht + hp - hj) / hp AS c FROM e)"""


@query("label_agreement", f"WITH {_CONT} SELECT round(h, 9) AS homogeneity, round(c, 9) AS completeness, round(2 * h * c / (h + c), 9) AS v_measure FROM m")
def label_agreement(spark, sf):
    """Quality labels against a grouping of the ids."""
    rows = table(spark, sf, "labels").select(F.col("quality").alias("truth"), (F.col("doc_id") % 7).alias("predicted"))
    out = mt.agreement(rows, "truth", "predicted")
    return out.select(*[F.round(c, 9).alias(c) for c in ("homogeneity", "completeness", "v_measure")])


@query("cluster_shape", """SELECT round(count(*) FILTER (p = -1) / count(*), 9) AS outlier_ratio, count(DISTINCT p) AS unique_clusters, round((count(DISTINCT p) - 1) / count(DISTINCT t), 9) AS clusters_ratio
FROM (SELECT CASE WHEN label = 0 THEN -1 ELSE label END AS p, vec_id % 20 AS t FROM embeddings)""")
def cluster_shape(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("p"), (F.col("vec_id") % 20).alias("t"))
    out = mt.cluster_shape(rows, "t", "p")
    return out.select(F.round("outlier_ratio", 9).alias("outlier_ratio"), "unique_clusters", F.round("clusters_ratio", 9).alias("clusters_ratio"))
