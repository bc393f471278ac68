"""Quality classifier as a sparse rule ensemble: tree paths become rules, a lasso weighs them, Spark columns apply them.

1. Statistics of every whole text, as built-in column functions.
2. A bounded sample of labelled rows trains a small random forest. Every path from a root to a node, as a conjunction of
   ``statistic <= x`` or ``statistic > x``, is a rule.
3. A logistic regression with an L1 penalty weighs the rules; most get the weight 0 and go.
4. The others make one column expression, the probability of label 1, so that scoring runs inside the scan.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import fold_of, pick, unpacked, with_row, words_of
from topicloom.session import materialize

Condition = tuple[str, str, float]
Rule = tuple[Condition, ...]

STATISTICS = [
    "n_words", "word_length", "longest_word", "distinct_words", "same_as_next", "sentence_ends", "upper_share", "digit_share",
    "symbol_share", "pipe_share", "mark_share", "dup_lines", "words_per_line",
]


def statistics(docs: DataFrame, *kept: str) -> DataFrame:
    """(kept, STATISTICS as doubles) per row of ``docs``, which has a ``text``; a null text counts as empty."""
    text, words, lines = F.col("text"), F.col("words"), F.col("lines")
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    chars = F.greatest(F.length("bare"), F.lit(1)).cast("double")
    without = lambda pattern: (F.length("bare") - F.length(F.regexp_replace("bare", pattern, ""))) / chars
    same = F.filter(words, lambda w, i: F.coalesce(F.get(words, i + 1) == w, F.lit(False)))
    stats = {
        "n_words": F.size(words), "word_length": F.length("bare") / n,
        "longest_word": F.aggregate(words, F.lit(0), lambda a, w: F.greatest(a, F.length(w))),
        "distinct_words": F.size(F.array_distinct(words)) / n, "same_as_next": F.size(same) / n,
        "sentence_ends": F.size(F.filter(words, lambda w: F.substring(w, -1, 1).isin(".", "!", "?"))) / n,
        "upper_share": without(r"\p{Lu}+"), "digit_share": without(r"\p{N}+"), "symbol_share": without(r"[#$%&*<>=+~^@_{}\[\]\\]+"),
        "pipe_share": without(r"\|+"), "mark_share": without("!+"),
        "dup_lines": 1 - F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "words_per_line": F.size(words) / F.greatest(F.size(lines), F.lit(1)),
    }
    whole = docs.withColumn("text", F.coalesce("text", F.lit("")))
    split = whole.select(
        *kept, words_of(text).alias("words"), F.regexp_replace("text", r"[\x20\x09-\x0D]+", "").alias("bare"),
        F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"))
    return split.select(*kept, *[stats[c].cast("double").alias(c) for c in STATISTICS])


def tree_paths(debug: str, names: list[str]) -> list[Rule]:
    """Conjunctions from the root to every other node of one tree, as Spark prints it."""
    rules, path = [], []
    for line in debug.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if found:
            path = [*path[: len(found[1]) - 2], (names[int(found[2])], found[3], float(found[4]))]
            rules.append(tightest(path))
    return rules


def tightest(path: list[Condition]) -> Rule:
    """The same conjunction with one bound per statistic and side, in a fixed order."""
    best: dict[tuple[str, str], float] = {}
    for name, side, x in path:
        old = best.get((name, side), x)
        best[name, side] = min(old, x) if side == "<=" else max(old, x)
    return tuple(sorted((name, side, x) for (name, side), x in best.items()))


def holds(rule: Rule) -> Column:
    """The rule as a boolean column."""
    out = F.lit(True)
    for name, side, x in rule:
        out = out & (F.col(name) <= x if side == "<=" else F.col(name) > x)
    return out


def as_vector(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df).select("features", "label")


class RuleEnsemble:
    """Weighted rules; ``probability`` is a Spark column over the statistics."""

    def __init__(self, intercept: float, weights: dict[Rule, float]):
        self.intercept, self.weights = intercept, weights

    def probability(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in sorted(self.weights.items()):
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    @classmethod
    def fit(cls, labelled: DataFrame, trees: int = 24, depth: int = 3, penalty: float = 0.001, seed: int = 11) -> RuleEnsemble:
        """Fit on (STATISTICS, label double), a bounded table. Without both labels, or too few rows: a constant, the share of label 1."""
        seen = labelled.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("mean")).first()
        if not seen["n"] or seen["mean"] in (0.0, 1.0):
            mean = seen["mean"] if seen["n"] else 0.5
            return cls({0.0: -20.0, 1.0: 20.0}.get(mean, 0.0), {})
        forest = RandomForestClassifier(
            numTrees=trees, maxDepth=depth, minInstancesPerNode=5, maxBins=64, featureSubsetStrategy="0.6", subsamplingRate=0.7, seed=seed)
        model = forest.fit(as_vector(labelled, STATISTICS))
        rules = sorted({r for t in model.trees for r in tree_paths(t.toDebugString, STATISTICS)})
        if not rules:  # too few rows for any split
            return cls(math.log(seen["mean"] / (1 - seen["mean"])), {})
        marks = labelled.select("label", *[holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
        lasso = LogisticRegression(regParam=penalty, elasticNetParam=1.0, maxIter=100, standardization=False)
        fitted = lasso.fit(as_vector(marks, [f"r{i}" for i in range(len(rules))]))
        weights = {r: float(w) for r, w in zip(rules, fitted.coefficients.toArray(), strict=True) if w}
        return cls(float(fitted.intercept), weights)


def fit(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> RuleEnsemble:
    """Fit on at most ``sample_rows`` labelled rows, those with the smallest hash of the id; held-out rows are never used.

    Held out are rows whose crc32 of the id modulo 5 is 0. Labels other than 0 and 1, and ids with both, are left out.
    """
    known = pick(labels, doc_id=id_col, label=label_col).where("label in (0, 1)").groupBy("doc_id").agg(F.avg(F.col("label").cast("double")).alias("label"))
    known = known.where("label in (0, 1)").where(fold_of(F.col("doc_id")) != 0)
    chosen = known.join(pick(docs, doc_id=id_col), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    chosen = materialize(chosen, "chosen")  # bounded: Spark may broadcast it to the scan of the texts
    sample = statistics(pick(docs, doc_id=id_col, text=text_col).join(chosen, "doc_id"), "doc_id", "label")
    return RuleEnsemble.fit(materialize(sample.orderBy("doc_id", *STATISTICS).drop("doc_id").coalesce(1), "sample"))


def score(docs: DataFrame, ensemble: RuleEnsemble, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per document.

    Nulls: a null text counts as empty and gets a score like any other; a null id is held out or not by its empty text.
    Repeated rows are scored each. An empty table gives no rows. Other columns never enter a score.
    """
    scored = statistics(pick(docs, doc_id=id_col, text=text_col), "doc_id").withColumn("score", ensemble.probability())
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, ensemble: RuleEnsemble, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, unchanged."""
    # The row number keeps the filter above the statistics: below them, every rule would compute its statistics anew.
    scored = statistics(with_row(docs, text=text_col), "doc").withColumn("row", F.monotonically_increasing_id())
    scored = scored.withColumn("score", ensemble.probability()).where((F.col("score") >= threshold) & (F.col("row") >= 0))
    return unpacked(scored, docs.columns)
