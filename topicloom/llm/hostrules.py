"""Host-level quality rules: failures by host, shrunk towards all hosts by an empirical beta prior.

Every document is judged by the base rules from its whole text. Per host and rule, the failures are counted; a rate over few
documents says little, so it is shrunk: the rates of all hosts give a beta prior by their mean and variance, and a host's
posterior mean is its rate. A host whose posterior rate of any rule is above ``host_limit`` is rejected with all its
documents. Only counts per host are shuffled; the verdicts, one row per host, are joined back with the hot hosts dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import pick, salted_join, words_of
from topicloom.session import materialize

#: Fixed by the contract: symbols counted, window length, shortest text, highest share of repeated words in percent.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in the text, the first occurrence included."""
    n = F.size(words)
    last = F.greatest(n - WINDOW, F.lit(-1))
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    prints = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]))

    def covered(prints: Column) -> Column:
        # Sorted by print, windows stand next to their equals; the places of those, in order, cover WINDOW words each.
        def marked(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["p"] == x["p"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

        placed = F.array_sort(F.transform(prints, lambda p, i: F.struct(p.alias("p"), i.alias("i"))))
        return F.transform(F.array(placed), marked)[0]

    def length(places: Column) -> Column:
        first = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum"))
        step = lambda a, i: F.struct((i + WINDOW).alias("end"), (a["sum"] + (i + WINDOW - F.greatest(a["end"], i))).alias("sum"))
        return F.aggregate(places, first, step)["sum"]

    return F.transform(F.array(prints), lambda p: F.when(F.size(F.array_distinct(p)) == F.size(p), F.lit(0).cast("long")).otherwise(length(covered(p))))[0]


def base_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, BASE, base_failed) per document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    counted = pick(docs, doc_id=id_col, host=host_col, text=text_col).select(
        "doc_id", "host", "text", words_of(F.col("text")).alias("words"), lines.alias("lines")
    ).select(
        "doc_id", "host", F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    short = F.col("n_words") < MIN_WORDS
    repeats = 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    return counted.withColumn("short", short).withColumn("repeats", repeats).withColumn("base_failed", short | repeats)


def host_rates(judged: DataFrame, rules: list[str]) -> DataFrame:
    """(host, n_docs, <rule>_rate): posterior mean failure rate per host and rule.

    The prior is fitted by moments over hosts: their mean rate m, and the variance v of their rates left when the variance
    that chance alone gives is taken off. Its strength is m (1 - m) / v - 1; where hosts differ no more than by chance, the prior
    is as strong as all documents together.
    """
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.col(r).cast("long")).alias(r) for r in rules])
    share = lambda r: F.col(r) / F.col("n_docs")
    total = hosts.agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("hosts"), F.sum(1 / F.col("n_docs")).alias("inverse"),
        *[F.sum(r).alias(r) for r in rules], *[F.avg(share(r)).alias(f"{r}_center") for r in rules],
        *[F.avg(share(r) * share(r)).alias(f"{r}_squares") for r in rules]).first()  # one row of numbers
    rated = hosts
    for r in rules:
        mean = total[r] / total["n"] if total["n"] else 0.0
        strength = float(total["n"])
        if total["n"]:
            spread = total[f"{r}_squares"] - total[f"{r}_center"] ** 2 - mean * (1 - mean) * total["inverse"] / total["hosts"]
            strength = max(0.0, min(mean * (1 - mean) / spread - 1, strength)) if spread > 0 else strength
        rated = rated.withColumn(f"{r}_rate", (F.col(r) + mean * strength) / (F.col("n_docs") + strength))
    return rated.select("host", "n_docs", *[f"{r}_rate" for r in rules])


def judge(docs: DataFrame, host_limit: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, BASE, base_failed, <rule>_rate, kept) per document.

    ``kept`` is false if a base rule fails or the host's posterior failure rate of a rule is above ``host_limit``.

    Nulls: a null text has no words and fails as too short; null hosts are one host; a null id is kept. Repeated rows count each.
    An empty table gives no rows. Other columns are ignored.
    """
    rules = ["short", "repeats"]
    judged = materialize(base_rules(docs, id_col, text_col, host_col), "judged")  # read twice below, without the texts
    rates = host_rates(judged, rules)
    met = salted_join(judged, rates, "host", F.col("doc_id"))
    worst = F.greatest(*[F.col(f"{r}_rate") for r in rules], F.lit(0.0))
    return met.select("doc_id", "host", *BASE, "base_failed", *[f"{r}_rate" for r in rules], (~F.col("base_failed") & (worst <= host_limit)).alias("kept"))
