"""Corpus pipeline over the documents table: classify, remove near copies, redact secrets, mix sources, tokenize.

Every stage takes all rows that the one before kept, and each but the last returns the columns of ``documents``. A null text counts
as empty, repeated rows and empty tables pass through every stage as its operator defines.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import bpe, jaccard, mixing, rulefit, secrets
from topicloom.session import materialize


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble gives a score of at least 0.3 for quality."""
    return rulefit.accepted(docs, rulefit.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 of their 5-word shingles: the one with the smallest id."""
    return jaccard.one_of_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark."""
    return secrets.redacted(docs, chars_col="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as a mixture of 150% of all words takes them, sources weighing 3, 1, 2."""
    return mixing.mixture(docs, chars_col="n_chars")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, n_bytes): token ids of every row, and the bytes that they decode to."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.tokenize(docs, ranks, public_tokenizers.PATTERN)
    return encoded.select("doc_id", "n_tokens", "ids", F.length("decoded").cast("long").alias("n_bytes"))


STAGES = [
    ("quality classifier", classify), ("n-gram Jaccard join", remove_copies), ("secret scans", redact),
    ("mixing sources to target weights", mix), ("byte-level BPE encoding and decoding", tokenize),
]

#: Fitted models and random draws can't be said in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
