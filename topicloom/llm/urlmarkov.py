"""URL filter: rules first, then the ratio of two character language models.

Urls that a rule allows or blocks teach two variable-order Markov models over bytes, one of accepted and one of rejected urls.
Every counted context of up to ``order`` bytes is kept; a context that was never seen falls back to its shorter end. Contexts are
smoothed into their shorter ends by Witten and Bell's rule. A url's score is its log-likelihood under the accepted model less
that under the rejected one, divided by its length. The threshold is calibrated on a fifth of the labelled urls that the models
do not learn from: it separates the two kinds with the best mean accuracy.

The models are a table of one row per context and never are in one place. Urls are scored chunk by chunk (about ``chunk_bytes``
of urls, dealt by hash): a chunk asks for its distinct contexts, one row each, and gets back what followed them in both kinds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import pick
from topicloom.llm.textbytes import buffers
from topicloom.session import materialize

#: Stand before the first byte and after the last one of a url.
BEGIN, END = 2, 3
#: Scores are calibrated in steps of 1/STEPS between -SPAN and SPAN.
STEPS, SPAN = 1000, 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: what follows the first ``://`` up to / ? # or the end, A-Z lowered; then up to ? # or the end. Else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rules(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; ``rules``: (verdict, host/path). Of equal rules the first counts."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(reversed(list(rules)), key=lambda r: len(r[1])):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def windows(urls: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Per length 1..order+1, the packed bytes that end at each scored place; and the number of places of each url.

    Scored are the url's bytes, A-Z lowered, and its end. Packed numbers of different lengths differ by a leading 1.
    """
    data, offsets = buffers(urls)
    lengths = np.diff(offsets)
    width = lengths + order + 1
    starts = np.cumsum(width) - width
    text = np.full(int(width.sum()), BEGIN, np.uint64)
    inside = np.arange(len(data)) - np.repeat(offsets[:-1], lengths) + np.repeat(starts, lengths) + order
    text[inside] = np.where((data >= 65) & (data <= 90), data + 32, data)
    text[starts + width - 1] = END
    scored = np.ones(len(text), bool)
    scored[(np.arange(order) + starts[:, None]).ravel()] = False
    places = np.flatnonzero(scored)
    out, packed = [], np.zeros(len(places), np.uint64)
    for j in range(order + 1):
        packed = packed + (text[places - j] << np.uint64(8 * j))
        out.append(packed + (np.uint64(1) << np.uint64(8 * (j + 1))))
    return out, lengths + 1


def count_windows(urls: DataFrame, order: int) -> DataFrame:
    """(label, size, window, n): how often each window of each size ends at a scored place; summed per batch before the shuffle."""

    def run(batches):
        for batch in batches:
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            for label in np.unique(labels):
                packed, _ = windows(batch.column("url").filter(pa.array(labels == label)), order)
                for size, w in enumerate(packed, 1):
                    found, n = np.unique(w, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(found), label)), pa.array(np.full(len(found), size, np.int32)), pa.array(found.view(np.int64)), pa.array(n)],
                        ["label", "size", "window", "n"])

    return urls.mapInArrow(run, "label int, size int, window long, n long").groupBy("label", "size", "window").agg(F.sum("n").alias("n"))


class Markov:
    """One model, or what a chunk needs of it: per context length, windows with their counts and contexts with total and kinds."""

    def __init__(self, order: int, tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        #: per order: windows, counts, and the context of each window
        self.levels = []
        for size, (window, n, context) in enumerate(tables, 1):
            by = np.argsort(window)
            contexts, slot, kinds = np.unique(context, return_inverse=True, return_counts=True)
            totals = np.bincount(slot, weights=n, minlength=len(contexts))
            self.levels.append((size, window[by], n[by].astype(np.float64), contexts, totals, kinds.astype(np.float64)))

    def log_likelihood(self, packed: list[np.ndarray]) -> np.ndarray:
        """Natural log of the probability of the byte at each place."""
        p = np.full(len(packed[0]), 1 / 256)
        for size, window, n, contexts, totals, kinds in self.levels:
            if len(window) == 0:
                continue
            key = packed[size - 1]
            context = context_of(key)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            kept = contexts[at] == context
            to = np.minimum(np.searchsorted(window, key), len(window) - 1)
            count = np.where(window[to] == key, n[to], 0.0)
            p = np.where(kept, (count + kinds[at] * p) / (totals[at] + kinds[at]), p)
        return np.log(p)


def context_of(window: np.ndarray) -> np.ndarray:
    """The window without its last byte."""
    return window >> np.uint64(8)


class Models:
    """Both models as a stored table (context, symbols, rejected, accepted): the bytes seen after a context, and how often in each kind.

    Contexts of different lengths differ by their leading 1; a row holds at most 258 bytes and their counts.
    """

    def __init__(self, table: DataFrame, order: int):
        self.table, self.order = table, order

    def __getitem__(self, label: int) -> Asked:
        return Asked(self, label)


class Asked:
    """One of both models, asked from the driver for a few windows."""

    def __init__(self, models: Models, label: int):
        self.models, self.label = models, label

    def log_likelihood(self, packed: list[np.ndarray]) -> np.ndarray:
        contexts = np.unique(np.concatenate([context_of(p) for p in packed])).view(np.int64)
        table = self.models.table
        asked = table.sparkSession.createDataFrame(pa.table({"context": contexts}))
        return answered(asked.join(table, "context").toArrow(), self.models.order)[self.label].log_likelihood(packed)


def answered(rows: pa.Table, order: int) -> tuple[Markov, Markov]:
    """The rejected and the accepted model, as far as the rows of ``Models.table`` tell."""
    rows = rows.combine_chunks()
    symbols = rows.column("symbols").combine_chunks()
    context = np.repeat(rows.column("context").to_numpy().view(np.uint64), np.diff(symbols.offsets.to_numpy()))
    window = (context << np.uint64(8)) + symbols.flatten().to_numpy().astype(np.uint64)
    models = []
    for kind in ("rejected", "accepted"):
        n = rows.column(kind).combine_chunks().flatten().to_numpy()
        tables = []
        for size in range(1, order + 2):
            mine = (n > 0) & (window >> np.uint64(8 * size) == 1)
            tables.append((window[mine], n[mine], context[mine]))
        models.append(Markov(order, tables))
    return models[0], models[1]


def learn(labelled: DataFrame, order: int) -> Models:
    """Models from (label, url); all counts are kept."""
    of = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(F.lit(0)))
    windows_seen = count_windows(labelled, order).groupBy("window").agg(of(0).alias("rejected"), of(1).alias("accepted"))
    entry = F.struct(F.col("window").bitwiseAND(F.lit(255)).cast("int").alias("symbol"), "rejected", "accepted")
    rows = windows_seen.groupBy(F.shiftright("window", 8).alias("context")).agg(F.collect_list(entry).alias("seen"))
    rows = rows.select("context", F.col("seen.symbol").alias("symbols"), F.col("seen.rejected").alias("rejected"), F.col("seen.accepted").alias("accepted"))
    return Models(materialize(rows, "contexts"), order)


def with_score(urls: DataFrame, models: Models, order: int, chunk_bytes: int = 2 << 20) -> DataFrame:
    """Adds ``score`` to a table with a ``url``; null for a null url."""
    names = urls.columns
    # Stored, so that a row stays in its chunk; the row's number spreads equal urls.
    dealt = materialize(urls.withColumn("_deal", F.xxhash64("url", F.monotonically_increasing_id())), "urls")
    # A row counts its bytes, its end and what else it carries.
    size = dealt.agg(F.sum(F.coalesce(F.octet_length("url"), F.lit(0)) + 32)).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    dealt = dealt.withColumn("_chunk", F.pmod("_deal", F.lit(chunks))).drop("_deal")

    def asked(table: pa.Table) -> pa.Table:
        packed, _ = windows(table.column("url"), order)
        contexts = np.concatenate([np.unique(context_of(p)) for p in packed])
        return pa.table({"_chunk": np.full(len(contexts), table.column("_chunk")[0].as_py(), np.int64), "context": contexts.view(np.int64)})

    def scored(table: pa.Table, answers: pa.Table) -> pa.Table:
        url = table.column("url").combine_chunks()
        packed, places = windows(url, order)
        rejected, accepted = answered(answers, order)
        ratio = accepted.log_likelihood(packed) - rejected.log_likelihood(packed)
        score = np.add.reduceat(ratio, np.cumsum(places) - places) / places
        score = pa.array(score, mask=url.is_null().to_numpy(zero_copy_only=False))
        return table.select(names).append_column("score", score)

    questions = dealt.select("_chunk", "url").groupBy("_chunk").applyInArrow(asked, "_chunk long, context long")
    answers = questions.join(models.table, "context").select("_chunk", "context", "symbols", "rejected", "accepted")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema)
    return dealt.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(scored, f"{kinds}, score double")


def calibrate(scored: DataFrame) -> float:
    """Threshold on (label, score) below which urls are blocked: best mean accuracy of both kinds, then the one nearest to 0."""
    step = F.greatest(F.lit(-SPAN * STEPS), F.least(F.lit(SPAN * STEPS), F.floor(F.col("score") * STEPS)))
    rows = scored.groupBy("label", step.alias("step")).count().collect()  # bounded by the steps
    totals = {k: sum(r["count"] for r in rows if r["label"] == k) for k in (0, 1)}
    if not totals[0] or not totals[1]:
        return 0.0
    by_step: dict[int, list[int]] = {}
    for r in rows:
        by_step.setdefault(r["step"], [0, 0])[r["label"]] += r["count"]
    best, below = (0.5, 0.0), [0, 0]
    steps = sorted(by_step)
    for step, following in zip(steps, [*steps[1:], steps[-1] + 1], strict=True):
        for kind in (0, 1):
            below[kind] += by_step[step][kind]
        # Any threshold between two steps that hold urls does the same: the one nearest to 0.
        at = min(max(0.0, (step + 1) / STEPS), following / STEPS)
        accuracy = (below[0] / totals[0] + 1 - below[1] / totals[1]) / 2
        if accuracy > best[0] or (math.isclose(accuracy, best[0]) and abs(at) < abs(best[1])):
            best = (accuracy, at)
    return best[1]


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str]], order: int = 4, id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) per page; ``rules``: (allow or block, host/path).

    The verdict is that of the longest rule that fits; else block if the score is below the calibrated threshold, allow otherwise.
    Nulls: a null url has empty host and path, no score, and is allowed; a null id is kept. If one kind of label is missing, the
    threshold is 0 and its model gives every byte the same probability. Repeated urls teach and are judged each. An empty
    table gives no rows. Other columns are ignored.
    """
    host, path = parts(F.col("url"))
    parsed = pick(pages, page_id=id_col, url=url_col).withColumn("host", host).withColumn("path", path)
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", rule).withColumn("given", verdict)
    parsed = parsed.withColumn("label", F.when(F.col("url").isNotNull(), (F.col("given") == "allow").cast("int")))
    held_out = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    models = learn(parsed.where(F.col("label").isNotNull() & ~held_out).select("label", "url"), order)
    scored = materialize(with_score(parsed, models, order), "scores")
    threshold = calibrate(scored.where(F.col("label").isNotNull() & held_out))
    own = F.when(F.col("score") < threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("given", own).alias("verdict"), "score")
