"""Column choice and joins shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed by the data contracts: a word is a run of characters that are neither blank nor ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names (new=old); found by exact name, whatever other columns are called."""
    names = df.columns
    taken = df.toDF(*[f"_{i}" for i in range(len(names))])
    return taken.select(*[F.col(f"_{names.index(old)}").alias(new) for new, old in columns.items()])


def with_row(df: DataFrame, **columns: str) -> DataFrame:
    """Like ``pick``, with the whole row as the struct ``doc``, so that no name of it can clash. ``unpacked`` gives the row back."""
    names = df.columns
    taken = df.toDF(*[f"_{i}" for i in range(len(names))])
    row = F.struct(*[F.col(f"_{i}") for i in range(len(names))]).alias("doc")
    return taken.select(*[F.col(f"_{names.index(old)}").alias(new) for new, old in columns.items()], row)


def unpacked(df: DataFrame, names: list[str], **changed: Column) -> DataFrame:
    """The columns of the struct ``doc`` under their names, some of them changed."""
    return df.select(*[changed.get(c, F.col(f"doc._{i}")).alias(c) for i, c in enumerate(names)])


def words_of(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def count_words(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold_of(key: Column) -> Column:
    """crc32 of the key's decimal text, modulo 5; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5


def salted_join(big: DataFrame, small: DataFrame, key: str, spread: Column, salts: int = 16, how: str = "left") -> DataFrame:
    """Join on a hot key, null equal to null: ``small`` (one row per key) is repeated ``salts`` times, ``big`` is dealt by ``spread``.

    If ``small`` turns out below the broadcast limit, Spark broadcasts it and nothing is shuffled.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumnRenamed(key, "_key").withColumn("_salt_of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = left.join(right, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_salt_of")), how)
    return met.drop("_salt", "_salt_of", "_key")
