"""Text queries: loading, cleaning, tokens, sentences."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from topicloom.catalog.base import ARTICLES, articles, in_list, query, quoted, rules_sql, strip_sql, table
from topicloom.functions import stopwords as sw
from topicloom.functions import text as tx
from topicloom.operators import tokens as tk

STOP = sw.default_stopwords()


def _clean_sql(profile: str) -> str:
    return f"SELECT doc_id AS article_uid, {rules_sql('text', tx.cleaning_rules(profile))} AS clean FROM documents"


@query("clean_articles", _clean_sql("reference"))
def clean_articles(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("article_uid"), tx.clean_article(F.col("text")).alias("clean"))


@query("clean_articles_lower", f"SELECT article_uid, lower(clean) AS clean FROM ({_clean_sql('reference')})")
def clean_articles_lower(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("article_uid"), tx.clean_article(F.col("text"), lower=True).alias("clean")
    )


@query("clean_articles_legacy", _clean_sql("legacy"))
def clean_articles_legacy(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("article_uid"), tx.clean_article(F.col("text"), profile="legacy").alias("clean")
    )


@query("clean_pages", f"SELECT page_id, {rules_sql('html', tx.cleaning_rules())} AS clean FROM pages")
def clean_pages(spark, sf):
    """Raw HTML exercises the symbol, URL and slash rules."""
    return table(spark, sf, "pages").select("page_id", tx.clean_article(F.col("html")).alias("clean"))


@query("clean_text_hard", f"SELECT doc_id AS article_uid, {rules_sql('lower(text)', tx.HARD_RULES)} AS clean FROM documents")
def clean_text_hard(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("article_uid"), tx.clean_hard(F.col("text")).alias("clean"))


_TITLE = r"regexp_extract(html, '<title>([^<]*)</title>', 1) || ' - ' || split_part(url, '/', 4) || ' - Bild.de'"


def _title_sql(drop: int, keep: bool) -> str:
    base = "t"
    for m in tx.TITLE_MARKERS:
        base = f"replace({base}, {quoted(m)}, '')"
    base = f"replace({base}, chr(160), ' ')"
    parts = f"string_split({base}, '-')"
    cut = f"array_to_string(list_transform(list_slice({parts}, 1, greatest(len({parts}) - {drop}, 0)), lambda p: {strip_sql('p')}), ' ')"
    cut = strip_sql(cut)
    value = f"CASE WHEN contains({base}, '-') THEN {cut} ELSE {base} END" if keep else cut
    return f"WITH titles AS (SELECT page_id, {_TITLE} AS t FROM pages) SELECT page_id, {value} AS title FROM titles"


def _titles(spark, sf, **kw):
    title = F.concat(
        F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(" - "),
        F.split_part(F.col("url"), F.lit("/"), F.lit(4)), F.lit(" - Bild.de"),
    )
    return table(spark, sf, "pages").select("page_id", tx.strip_title_marker(title, **kw).alias("title"))


@query("title_marker", _title_sql(1, True))
def title_marker(spark, sf):
    return _titles(spark, sf)


@query("title_marker_section", _title_sql(2, True))
def title_marker_section(spark, sf):
    return _titles(spark, sf, remove_section=True)


@query("title_marker_legacy", _title_sql(1, False))
def title_marker_legacy(spark, sf):
    return _titles(spark, sf, keep_unmarked=False)


@query("sentences_by_dot", f"""
SELECT article_uid, CAST(pos - 1 AS INTEGER) AS pos, {strip_sql('s')} AS sentence FROM (
  SELECT doc_id AS article_uid, unnest(parts) AS s, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, list_filter(string_split(text, '.'), lambda x: x <> '') AS parts FROM documents))""")
def sentences_by_dot(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("article_uid"), F.posexplode(tx.sentences_by_dot(F.col("text"))).alias("pos", "sentence")
    )


SENTENCES_SQL = f"list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda s: {strip_sql('s')}), lambda s: s <> '')"


@query("sentences", f"""
SELECT article_uid, CAST(pos - 1 AS INTEGER) AS pos, sentence FROM (
  SELECT doc_id AS article_uid, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, {SENTENCES_SQL} AS parts FROM documents))""")
def sentences(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("article_uid"), F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence")
    )


def _title_expr():
    return tx.strip_title_marker(F.col("seo_title"))


def _seo(drop: int) -> str:
    s = "replace(replace(replace(seo_title, 'bild.de', ''), 'Bild.de', ''), '*** BILDplus Inhalt ***', '')"
    s = f"replace({s}, chr(160), ' ')"
    parts = f"string_split({s}, '-')"
    cut = strip_sql(f"array_to_string(list_transform(list_slice({parts}, 1, greatest(len({parts}) - {drop}, 0)), lambda p: {strip_sql('p')}), ' ')")
    return f"CASE WHEN contains({s}, '-') THEN {cut} ELSE {s} END"


@query("embedding_inputs", f"""
WITH {ARTICLES} SELECT article_uid, {_seo(2)} || '. ' || text AS for_service, headline || ' ' || {_seo(1)} AS mix,
  headline || ' ' || {_seo(1)} || text AS title_and_text FROM articles""")
def embedding_inputs(spark, sf):
    title = _title_expr()
    return articles(spark, sf).select(
        "article_uid",
        F.concat(tx.strip_title_marker(F.col("seo_title"), remove_section=True), F.lit(". "), F.col("text")).alias("for_service"),
        F.concat_ws(" ", "headline", title).alias("mix"),
        F.concat(F.col("headline"), F.lit(" "), title, F.col("text")).alias("title_and_text"),
    )


@query("plain_headlines", f"WITH {ARTICLES} SELECT article_uid, translate(lower(headline), {quoted(string.punctuation)}, '') AS headline FROM articles")
def plain_headlines(spark, sf):
    return articles(spark, sf).select("article_uid", tx.no_punctuation(F.lower("headline")).alias("headline"))


def _alpha_sql(expr: str = "text") -> str:
    bare = rules_sql(f"translate({expr}, {quoted(string.punctuation)}, '')", [("regex", tx.URL, "")])
    split = rf"regexp_split_to_array({bare}, '[{tx.SPACE}]+')"
    return rf"list_filter({split}, lambda t: regexp_full_match(t, '\p{{L}}{{2,}}') AND t NOT IN ({in_list(STOP)}))"


@query("alphabetic_tokens", f"""
SELECT article_uid, CAST(pos - 1 AS INTEGER) AS pos, token FROM (
  SELECT doc_id AS article_uid, unnest(ts) AS token, generate_subscripts(ts, 1) AS pos
  FROM (SELECT doc_id, {_alpha_sql()} AS ts FROM documents))""")
def alphabetic_tokens(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("article_uid"), F.posexplode(tk.alphabetic_tokens(F.col("text"), STOP)).alias("pos", "token")
    )


def _stem_sql(t: str) -> str:
    e = f"replace(translate(lower({t}), {quoted(tk.FOLD_FROM)}, {quoted(tk.FOLD_TO)}), chr(223), 'ss')"
    for ending in tk.ENDINGS:
        e = rf"regexp_replace({e}, '{ending}', '\1')"
    return e


@query("stem_counts", f"""
SELECT stem, count(*) AS n, count(DISTINCT article_uid) AS articles FROM (
  SELECT article_uid, {_stem_sql('token')} AS stem FROM (SELECT doc_id AS article_uid, unnest({_alpha_sql()}) AS token FROM documents))
GROUP BY stem""")
def stem_counts(spark, sf):
    stems = tk.stems(tk.alphabetic_tokens(F.col("text"), STOP))
    per_article = tk.term_counts(table(spark, sf, "documents"), ["doc_id"], stems)
    return per_article.groupBy(F.col("term").alias("stem")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("articles"))


@query("split_tokens", f"""
SELECT token, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[{tx.SPACE}]+')) AS token FROM documents)
WHERE token <> '' AND token NOT IN ({in_list(STOP)}) GROUP BY token""")
def split_tokens(spark, sf):
    parts = F.split(F.col("text"), rf"[{tx.SPACE}]+")
    return tk.term_counts(table(spark, sf, "documents"), [], sw.drop_stopwords(parts, STOP)).select(F.col("term").alias("token"), "n")


@query("stopword_free_terms", rf"""
SELECT doc_id AS article_uid, term, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM documents)
WHERE term NOT IN ({in_list(STOP)}) GROUP BY doc_id, term""")
def stopword_free_terms(spark, sf):
    kept = sw.drop_stopwords(tx.words(F.col("text")), STOP)
    return tk.term_counts(table(spark, sf, "documents"), ["doc_id"], kept).withColumnRenamed("doc_id", "article_uid")


@query("stopword_hits", f"""
WITH stop AS (SELECT DISTINCT unnest([{in_list(STOP)}]) AS word)
SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[{tx.SPACE}]+')) AS t FROM documents) JOIN stop ON word = t
GROUP BY word""")
def stopword_hits(spark, sf):
    """Occurrences of each stopword: the list as a table."""
    words = spark.createDataFrame([(w,) for w in STOP], "word string")
    found = tk.term_counts(table(spark, sf, "documents"), [], F.split(F.col("text"), rf"[{tx.SPACE}]+"))
    return found.join(words, found["term"] == words["word"]).select("word", "n")


def _grams_sql(n: int) -> str:
    return (f"list_transform(generate_series(1, len(w) - {n - 1}), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' '))")


def _top_ngrams_sql(sizes: list[int], limit: int | None) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {n} AS size, unnest({_grams_sql(n)}) AS ngram FROM w WHERE len(w) >= {n}" for n in sizes
    )
    ranked = rf"""
WITH w AS (SELECT regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM documents),
grams AS (SELECT size, ngram, count(*) AS n FROM ({parts}) GROUP BY size, ngram)"""
    if limit is None:
        return ranked + " SELECT CAST(size AS INTEGER) AS size, ngram, n FROM grams"
    return ranked + f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY size ORDER BY n DESC, ngram) AS rank FROM grams)
SELECT CAST(size AS INTEGER) AS size, ngram, n, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= {limit}"""


@query("top_ngrams", _top_ngrams_sql([2, 3, 4], 20))
def top_ngrams(spark, sf):
    return tk.top_ngrams(table(spark, sf, "documents"), tx.words(F.col("text")), [2, 3, 4], 20)


@query("ngram_tables", _top_ngrams_sql([2, 3, 4, 5, 6], None))
def ngram_tables(spark, sf):
    return tk.top_ngrams(table(spark, sf, "documents"), tx.words(F.col("text")), [2, 3, 4, 5, 6], None)


@query("token_frequency", r"""
SELECT doc_id AS article_uid, term, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents) GROUP BY doc_id, term""")
def token_frequency(spark, sf):
    return tk.term_counts(table(spark, sf, "documents"), ["doc_id"], tx.words(F.col("text"))).withColumnRenamed("doc_id", "article_uid")
