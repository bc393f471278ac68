"""Query registry and the mapping of the test tables onto articles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions import text as tx
from topicloom.session import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that must give the same rows."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


TEXT_TABLES = {"documents": ["doc_id", "text", "lang", "source"], "pages": ["page_id", "url", "html"]}


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    """A test table; text tables are spread over the cores, with only the ``columns`` asked for."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    if name in TEXT_TABLES:
        return spread(df.select(*(columns or TEXT_TABLES[name])))
    return df.select(*columns) if columns else df


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as articles: headline = first line, seo title = last line with a site suffix, day = id mod 14."""
    t = F.col("text")
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("article_uid"),
        F.split_part(t, F.lit("\n"), F.lit(1)).alias("headline"),
        F.concat(F.split_part(t, F.lit("\n"), F.lit(-1)), F.lit(" - "), F.col("lang"), F.lit(" - Bild.de")).alias("seo_title"),
        t.alias("text"), "lang", "source",
        F.date_add(F.lit("2020-09-01").cast("date"), (F.col("doc_id") % 14).cast("int")).alias("created_at"),
    )


ARTICLES = """articles AS (
  SELECT doc_id AS article_uid, split_part(text, chr(10), 1) AS headline,
         split_part(text, chr(10), -1) || ' - ' || lang || ' - Bild.de' AS seo_title,
         text, lang, source, DATE '2020-09-01' + CAST(doc_id % 14 AS INTEGER) AS created_at
  FROM documents)"""

WORDS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
TOKENS = rf"""tokens AS (SELECT doc_id, source, lang, unnest({WORDS_SQL}) AS term FROM documents)"""


def quoted(s: str) -> str:
    """SQL literal; control and unusual characters by code point, so the text is the same for every reader."""
    if all(32 <= ord(c) < 127 for c in s):
        return "'" + s.replace("'", "''") + "'"
    return "(" + " || ".join(f"chr({ord(c)})" if not 32 <= ord(c) < 127 else quoted(c) for c in s) + ")"


def rules_sql(expr: str, rules: list[tx.Rule]) -> str:
    """A cleaning rule list as nested SQL calls."""
    for kind, what, repl in rules:
        if kind == "regex":
            to = repl.replace("$1", r"\1").replace("$2", r"\2")
            pattern = quoted(what.replace("€", r"\x{20ac}").replace("–", r"\x{2013}"))
            expr = f"regexp_replace({expr}, {pattern}, {quoted(to)}, 'g')"
        elif kind == "literal":
            expr = f"replace({expr}, {quoted(what)}, {quoted(repl)})"
        elif kind == "trim":
            expr = f"trim({expr}, ' ')"
        else:
            expr = f"translate({expr}, {quoted(what)}, '')"
    return expr


STRIP = ("regex", rf"^[{tx.SPACE}]+|[{tx.SPACE}]+\z", "")


def strip_sql(expr: str) -> str:
    return rules_sql(expr, [STRIP])


def in_list(words: list[str]) -> str:
    return ", ".join(quoted(w) for w in words)


# Articles with entity annotations as JSON text: capitalized word runs, type by name length.
NAME = r"\p{Lu}[\p{L}]+(?: \p{Lu}[\p{L}]+){0,2}"
TYPES = ["PERSON", "LOCATION", "NUMBER", "COMMON"]


def annotated(spark: SparkSession, sf: str) -> DataFrame:
    """Articles with kicker/headline, text and seo-title annotations."""

    def as_json(col):
        names = F.regexp_extract_all(col, F.lit(f"({NAME})"), 1)
        kinds = F.array(*[F.lit(t) for t in TYPES])
        entities = F.transform(names, lambda n: F.struct(n.alias("name"), F.get(kinds, F.length(n) % 4).alias("type")))
        return F.to_json(F.array(F.struct(entities.alias("entities"))))

    base = articles(spark, sf)
    return base.select(
        "*", as_json(F.col("headline")).alias("kicker_headline_NER"), as_json(F.col("text")).alias("text_NER"),
        as_json(F.col("seo_title")).alias("seo_title_NER"),
    )


def entities_sql(col: str, source: str = "articles") -> str:
    """(article_uid, topic, pos, name, type) of a column: names without "bild", repeats dropped but for the last."""
    return f"""
  SELECT article_uid, source AS topic, name, CASE length(name) % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'LOCATION'
         WHEN 2 THEN 'NUMBER' ELSE 'COMMON' END AS type, max(pos) AS pos
  FROM (SELECT article_uid, source, unnest(ns) AS name, generate_subscripts(ns, 1) AS pos
        FROM (SELECT article_uid, source, regexp_extract_all({col}, '{NAME}') AS ns FROM {source}))
  WHERE NOT contains(lower(name), 'bild') GROUP BY article_uid, source, name"""
