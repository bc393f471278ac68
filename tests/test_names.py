"""Names found by a filter inside the scan."""

import collections
import re

import numpy as np
from pyspark.sql import functions as F

from topicloom.operators import entities as en


def texts_and_names(spark, n_names=300):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(vocabulary[j] for j in rng.integers(0, 3000, 80)) for _ in range(150)] + ["", None, "w1", "W1 w2, w3"]
    names = sorted({" ".join(vocabulary[j] for j in rng.integers(0, 3000, 1 + i % 3)) for i in range(n_names)} | {"w1", "w1 w2 w3", "not there"})
    return texts, names, spark.createDataFrame(list(enumerate(texts)), "uid long, text string"), spark.createDataFrame([(x,) for x in names], "name string")


def mentions(texts, names):
    found = collections.Counter()
    for uid, text in enumerate(texts):
        tokens = re.findall(r"\w+", (text or "").lower())
        for n in (1, 2, 3):
            found.update((uid, " ".join(tokens[i : i + n])) for i in range(len(tokens) - n + 1))
    return {k: v for k, v in found.items() if k[1] in set(names)}


def test_only_hits_leave_the_scan(spark):
    texts, names, df, table = texts_and_names(spark)
    want = mentions(texts, names)
    got = {(r["uid"], r["name"]): r["mentions"] for r in en.find_names(df, "uid", "text", table).collect()}
    assert got == want and len(want) > 300
    passed = [(r["uid"], r["name"]) for r in en.possible_names(df, "uid", "text", table).collect()]
    everything = df.select(F.explode(en.mention_grams(F.col("text")))).count()
    hits = sum(want.values())
    assert set(want) <= set(passed) and len(passed) - hits < 0.04 * everything < everything - hits
    # no exchange stands between the scan and the filtered n-grams
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = en.find_names(df, "uid", "text", table)
        assert {(r["uid"], r["name"]): r["mentions"] for r in shuffled.collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_a_full_filter_misses_nothing(spark, monkeypatch):
    """Beyond the largest filter everything may pass; the join still decides."""
    monkeypatch.setattr(en, "MOST_BITS", 1 << 12)
    monkeypatch.setattr(en, "BITS_PER_NAME", 1)
    texts, names, df, table = texts_and_names(spark, 6000)
    got = {(r["uid"], r["name"]): r["mentions"] for r in en.find_names(df, "uid", "text", table).collect()}
    assert got == mentions(texts, names)


def test_no_names_and_no_texts(spark):
    _, _, df, table = texts_and_names(spark)
    assert en.find_names(df, "uid", "text", table.limit(0)).collect() == []
    assert en.find_names(df.limit(0), "uid", "text", table).collect() == []
    assert en.find_names(df, "uid", "text", table.limit(0).unionByName(table.limit(1).select(F.lit(None).cast("string").alias("name")))).collect() == []
