"""Tagging text with known entity names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions import text as tx
from topicloom.functions.vectors import let
from topicloom.session import materialize


def known_names(annotated: DataFrame, entities: Column) -> DataFrame:
    """(name, type, annotated): lower-case names, most frequent type, times annotated."""
    found = annotated.select(F.explode(entities).alias("e")).groupBy(
        F.lower("e.text").alias("name"), F.col("e.type").alias("type")
    ).agg(F.count(F.lit(1)).alias("n"))
    return found.groupBy("name").agg(
        F.min(F.struct((-F.col("n")).alias("k"), "type"))["type"].alias("type"), F.sum("n").alias("annotated")
    )


def mention_grams(col: Column, longest: int = 3) -> Column:
    """Lower-case n-grams of 1..``longest`` words."""
    tokens = F.regexp_extract_all(F.lower(col), F.lit(rf"({tx.WORD}+)"), 1)
    return let(tokens, lambda t: F.flatten(F.array(*[tx.ngrams(t, n) for n in range(1, longest + 1)])))


#: Bits of a name filter: so many per name, and at most 8 MB, which travel with every task.
BITS_PER_NAME, LEAST_BITS, MOST_BITS = 16, 1 << 12, 1 << 26
#: Seeds of the two positions of a name.
SEEDS = (11, 29)


def _position(name: Column, seed: int, bits: int) -> Column:
    return F.xxhash64(name, F.lit(seed)).bitwiseAND(F.lit(bits - 1))


def name_filter(names: DataFrame) -> tuple[DataFrame, int]:
    """(one row with the Bloom filter of ``name`` as an array of words of 64 bits, number of bits).

    The size follows from the number of names up to 8 MB, good for some 4 million names at 2 % false hits. For more of them more false hits
    pass, and are dropped by the join behind the filter; no name is ever missed.
    """
    wanted = BITS_PER_NAME * max(1, names.count())
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (wanted - 1).bit_length()))
    at = names.where("name is not null").select(F.explode(F.array(*[_position(F.col("name"), s, bits) for s in SEEDS])).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("mask"))
    every = names.sparkSession.range(bits // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    row = every.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")))).alias("all"))
    return materialize(row.select(F.col("all.mask").alias("filter")), "filter"), bits


def may_be_name(gram: Column, words: Column, bits: int) -> Column:
    """False only for what is no name."""
    held = [F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1 for at in (_position(gram, s, bits) for s in SEEDS)]
    return held[0] & held[1]


def possible_names(df: DataFrame, uid: str, text: str, names: DataFrame) -> DataFrame:
    """(uid, name): n-grams of the texts that pass the filter of ``names``, decided inside the scan, before a row is made of any."""
    words, bits = name_filter(names)
    grams = df.select(F.col(uid), mention_grams(F.col(text)).alias("_grams"), words.scalar().alias("_words"))
    return grams.select(uid, F.explode(F.filter("_grams", lambda g: may_be_name(g, F.col("_words"), bits))).alias("name"))


def find_names(df: DataFrame, uid: str, text: str, names: DataFrame) -> DataFrame:
    """(uid, name, mentions): known names in the texts.

    Only n-grams that pass a filter of the names leave the scan; the join drops the few that are no name.
    """
    hits = possible_names(df, uid, text, names)
    return hits.join(names.select("name"), "name", "left_semi").groupBy(uid, "name").agg(F.count(F.lit(1)).alias("mentions"))


def gazetteer(names: DataFrame, found: DataFrame) -> DataFrame:
    """(name, type, score): the score is the share of a name's mentions that were annotated, at most 1."""
    total = found.groupBy("name").agg(F.sum("mentions").alias("n"))
    return names.join(total, "name").select("name", "type", F.least(F.col("annotated") / F.col("n"), F.lit(1.0)).alias("score"))


def tag(found: DataFrame, uid: str, names: DataFrame, threshold: float = 0.70) -> DataFrame:
    """(uid, name, type, score, mentions) of the names whose score is above ``threshold``."""
    return found.join(names.where(F.col("score") > threshold), "name").select(uid, "name", "type", "score", "mentions")
