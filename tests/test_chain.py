"""Chains do each step once, and cleaning gives the same texts as its rules one by one."""

import functools
import random

import numpy as np
from pyspark.sql import functions as F

from topicloom.functions import text as tx
from topicloom.plans.pipe import Pipe


def plain(col, rules):
    """The rules one by one, without tests of the text."""
    def step(c, rule):
        kind, what, repl = rule
        if kind == "regex":
            return F.regexp_replace(c, what, repl)
        if kind == "literal":
            return F.replace(c, F.lit(what), F.lit(repl))
        return F.trim(c) if kind == "trim" else F.translate(c, what, "")

    return functools.reduce(step, rules, col)


def test_rules_are_skipped_only_where_they_change_nothing(spark):
    pick = random.Random(5)
    parts = [*tx.SYMBOLS, *" \t\n\x1c\x85\xa0  　\xad“„€£!-:/.,09٣\U0001d7d7aäß_", *[" "] * 50, *"--::12//", "bild.de", "BildPlus", "bild plus",
             "mehr gleich bei Bild!", "derStandard.at", "http://x y", " (12)", "12:3-", "(1:2)", "1.2.2020", "a/b/c", "...", " . ", ",", "bi", "ld"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 90))) for _ in range(4000)] + ["", None, "plain words"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    for rules in (tx.cleaning_rules(), tx.cleaning_rules("legacy", " "), tx.HARD_RULES):
        both = rows.select("t", tx.apply_rules(F.col("t"), rules).alias("a"), plain(F.col("t"), rules).alias("b"))
        assert both.where(~F.col("a").eqNullSafe(F.col("b"))).collect() == []


def counting(path):
    """A model that notes how many texts it was given."""
    def make_model():
        def predict(texts):
            with open(path, "a") as f:
                f.write("x" * len(texts))
            return np.array([[len(t), t.count("a") + 1.0] for t in texts], dtype=np.float32)

        return predict

    return make_model


def test_a_chain_embeds_every_row_once(spark, tmp_path):
    x = spark.createDataFrame([(i, "a" * i + "bc") for i in range(1, 4)], "article_uid long, text string")
    y = spark.createDataFrame([(i, "a" * (i % 7) + "b" * i) for i in range(1, 31)], "article_uid long, text string").repartition(3)
    pipe = Pipe(x, y).embed("text", make_model=counting(str(tmp_path / "seen"))).normalize()
    found = Pipe(*[d.where(F.col("embedding").isNotNull()) for d in pipe.value()]).nearest(2).value()
    assert found.count() == 6 and len(found.collect()) == 6
    assert len((tmp_path / "seen").read_text()) == 33


def test_recall_computes_only_rows_asked_for(spark, tmp_path):
    seen = str(tmp_path / "seen")

    @F.pandas_udf("string")
    def marked(texts):
        with open(seen, "a") as f:
            f.write("x" * len(texts))
        return texts + "!"

    x = spark.createDataFrame([(1, "aab"), (2, "abb")], "article_uid long, text string")
    y = spark.createDataFrame([(i, "a" * (i % 9) + "b" * i) for i in range(1, 41)], "article_uid long, text string")
    pipe = Pipe(x, y).together(lambda d: d.withColumn("text", marked("text"))).store("marked", "text")
    pipe = Pipe(*pipe.embed("text").value(), kept=pipe.kept).normalize().nearest(1)
    before = len(open(seen).read())
    assert before == 42
    rows = pipe.recall("marked", "neighbor", "y", "near_").value().collect()
    assert len(rows) == 2 and all(r["near_text"].endswith("!") for r in rows)
    assert len(open(seen).read()) - before <= 2
