"""Graph steps as rounds of joins: pointer jumping, tours of trees, ancestors, connected components, ranks of nodes."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.operators.ranking import next_in_group
from topicloom.session import by_shuffle, few, materialize


def jump(df: DataFrame, keys: list[str], node: str, up: str, rows: int | None = None) -> DataFrame:
    """Follow ``up`` to the end of every path: (keys, node, up = end). An end points at itself.

    Each round doubles the reach, so the rounds are the logarithm of the longest path. ``rows``, if known, bounds the rows of ``df``.
    """
    def double(paths: DataFrame) -> DataFrame:
        ahead = paths.select(*keys, F.col(node).alias(up), F.col(up).alias("_far"))
        return paths.join(by_shuffle(ahead), [*keys, up], "left").select(
            *keys, node, F.coalesce("_far", up).alias(up), (F.col("_far") != F.col(up)).alias("_moved")
        )

    paths = df.select(*keys, node, up)
    while True:
        moved = double(paths)
        moved = materialize(moved if rows is None else few(moved, rows), "paths")
        paths = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return paths


def any_ancestor(df: DataFrame, keys: list[str], node: str, parent: str, flag: str) -> DataFrame:
    """(keys, node, below): whether any proper ancestor carries ``flag``. Roots have a null parent."""
    flagged = df.select(*keys, F.col(node).alias(parent), F.col(flag).alias("_f"))
    state = materialize(df.select(*keys, node, parent).join(by_shuffle(flagged), [*keys, parent], "left").select(
        *keys, node, F.col(parent).alias("_ptr"), F.coalesce("_f", F.lit(False)).alias("below")), "ancestors")

    def double(now: DataFrame) -> DataFrame:
        ahead = now.select(*keys, F.col(node).alias("_ptr"), F.col("_ptr").alias("_next"), F.col("below").alias("_more"))
        return now.join(by_shuffle(ahead), [*keys, "_ptr"], "left").select(
            *keys, node, F.col("_next").alias("_ptr"), (F.col("below") | F.coalesce("_more", F.lit(False))).alias("below"))

    while not state.where(F.col("_ptr").isNotNull()).isEmpty():
        state = materialize(double(state), "ancestors")
    return state.drop("_ptr")


def sum_below(df: DataFrame, node: str, parent: str, value: str) -> DataFrame:
    """(node, value): sum of ``value`` over a node and everything below it, in log-depth rounds."""

    def double(now: DataFrame) -> DataFrame:
        gained = now.where(F.col("_ptr").isNotNull()).groupBy(F.col("_ptr").alias(node)).agg(F.sum(value).alias("_gain"))
        ahead = now.select(F.col(node).alias("_ptr"), F.col("_ptr").alias("_next"))
        return (
            now.join(by_shuffle(gained), node, "left").join(by_shuffle(ahead), "_ptr", "left")
            .select(node, F.col("_next").alias("_ptr"), (F.col(value) + F.coalesce("_gain", F.lit(0))).alias(value)))

    state = materialize(df.select(node, F.col(parent).alias("_ptr"), value), "sums")
    while not state.where(F.col("_ptr").isNotNull()).isEmpty():
        state = materialize(double(state), "sums")
    return state.drop("_ptr")


def tour(df: DataFrame, keys: list[str], node: str, parent: str) -> DataFrame:
    """(keys, node, root, low, high): nested intervals of the trees of a forest; roots have a null parent.

    A walk around a tree enters and leaves every node. The walk is a linked list, which pointer doubling
    ranks in as many rounds as the logarithm of its length, however deep the tree is. ``high`` and ``low``
    are the steps left when a node is entered and left: b stands at or below a if both have the same root and
    low(a) <= low(b) < high(a). Children follow in the order of ``node``. A cycle, a repeated node or an unknown parent is a ``ValueError``.
    """
    tree = materialize(df.select(*keys, node, parent), "tree")
    below = tree.where(F.col(parent).isNotNull())
    kids = next_in_group(below, [*keys, parent], [F.col(node)], F.col(node), "_sibling").select(*keys, node, "_sibling")
    first = below.groupBy(*keys, F.col(parent).alias(node)).agg(F.min(node).alias("_first"))
    at = lambda n, left: F.struct(F.col(n).alias("n"), F.lit(left).alias("left"))
    entered = tree.join(by_shuffle(first), [*keys, node], "left").select(
        *keys, at(node, False).alias("_e"), F.when(F.col("_first").isNotNull(), at("_first", False)).otherwise(at(node, True)).alias("_next"))
    left = tree.join(by_shuffle(kids), [*keys, node], "left").select(
        *keys, at(node, True).alias("_e"),
        F.when(F.col("_sibling").isNotNull(), at("_sibling", False)).when(F.col(parent).isNotNull(), at(parent, True)).otherwise(at(node, True)).alias("_next"))
    steps = entered.unionByName(left).withColumn("_d", F.when(F.col("_e") == F.col("_next"), 0).otherwise(1).cast("long"))

    def double(now: DataFrame) -> DataFrame:
        ahead = now.select(*keys, F.col("_e").alias("_next"), F.col("_next").alias("_far"), F.col("_d").alias("_more"))
        return now.join(by_shuffle(ahead), [*keys, "_next"]).select(
            *keys, "_e", F.col("_far").alias("_next"), (F.col("_d") + F.col("_more")).alias("_d"), (F.col("_far") != F.col("_next")).alias("_moved"))

    state = materialize(steps, "tour")
    length = state.count()
    for _ in range(length.bit_length() + 1):
        state = materialize(double(state), "tour")
        if state.count() != length:
            raise ValueError("a node is repeated, or its parent is unknown")
        if state.where("_moved").isEmpty():
            break
        state = state.drop("_moved")
    if not state.where("_moved or (_e = _next and _d > 0)").isEmpty():
        raise ValueError("the parents form a cycle")
    left = F.col("_e.left")
    return state.groupBy(*keys, F.col("_e.n").alias(node)).agg(
        F.max(F.col("_next.n")).alias("root"), F.max(F.when(left, F.col("_d"))).alias("low"), F.max(F.when(~left, F.col("_d"))).alias("high"))


def inside(points: DataFrame, spans: DataFrame, keys: list[str], at: str, low: str, high: str) -> DataFrame:
    """Pairs of a point and each span with low <= at < high, of the same ``keys``; whole numbers from 0 on.

    A span is cut into blocks of lengths 2^k at multiples of 2^k, at most two of a length, and a point lies in
    one block of every length. So each pair meets once in an equal join, and nothing else is compared.
    """
    top = spans.agg(F.max(high).alias("top")).first()["top"] or 0
    lengths = F.sequence(F.lit(0), F.lit(int(top).bit_length()))
    shift = lambda x, k: F.call_function("shiftright", x, k)

    def blocks(k: Column) -> Column:
        lo = shift(F.col(low) + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k)
        hi = shift(F.col(high), k)
        odd = lambda x: (lo < hi) & (x % 2 == 1)
        return F.array(F.struct(k.alias("k"), F.when(odd(lo), lo).alias("b")), F.struct(k.alias("k"), F.when(odd(hi), hi - 1).alias("b")))

    cut = spans.withColumn("_block", F.explode(F.filter(F.flatten(F.transform(lengths, blocks)), lambda s: s["b"].isNotNull())))
    held = points.withColumn("_block", F.explode(F.transform(lengths, lambda k: F.struct(k.alias("k"), shift(F.col(at), k).alias("b")))))
    return held.join(by_shuffle(cut), [*keys, "_block"]).drop("_block")


def ancestor_pairs(df: DataFrame, keys: list[str], node: str, parent: str) -> DataFrame:
    """(keys, node, ancestor) for every node and each of its ancestors, itself included."""
    walked = materialize(tour(df, keys, node, parent), "intervals")
    spans = walked.select(*keys, "root", F.col(node).alias("ancestor"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    found = inside(walked.select(*keys, "root", node, F.col("low").alias("_at")), spans, [*keys, "root"], "_at", "_low", "_high")
    return found.select(*keys, node, "ancestor")


def components(edges: DataFrame, nodes: DataFrame, node: str, rows: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable over the edges (a, b).

    Every round each node points at its smallest smaller neighbor, paths are shortened and the graph
    is contracted, which at least halves the nodes that still have edges. ``rows``, if known, bounds the rows of ``edges``.
    """
    maps: list[DataFrame] = []
    left = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    left = materialize(left if rows is None else few(left, rows), "edges")
    while held := left.count():
        down = left.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("up"))
        lowest = left.select(F.col("a").alias("n")).distinct().join(by_shuffle(down), "n", "left_anti").withColumn("up", F.col("n"))
        ends = jump(down.unionByName(lowest), [], "n", "up", 2 * held)
        maps.append(ends)
        to_a = ends.select(F.col("n").alias("a"), F.col("up").alias("_a"))
        to_b = ends.select(F.col("n").alias("b"), F.col("up").alias("_b"))
        left = left.join(by_shuffle(to_a), "a").join(by_shuffle(to_b), "b").where("_a <> _b")
        left = materialize(few(left.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), 2 * held), "edges")

    def follow(df: DataFrame, ends: DataFrame) -> DataFrame:
        there = ends.select(F.col("n").alias("component"), F.col("up").alias("_end"))
        return df.join(by_shuffle(there), "component", "left").select(node, F.coalesce("_end", "component").alias("component"))

    return functools.reduce(follow, maps, nodes.select(node, F.col(node).alias("component")))


def rank_nodes(
    edges: DataFrame, keys: list[str], rounds: int = 10, damping: float = 0.85, weight: Column | None = None
) -> DataFrame:
    """Weighted PageRank per key over undirected edges (keys, a, b): (keys, node, score).

    Scores of a key start at 1/n and add up to 1; every node has an edge, so none dangles.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    pairs = materialize(edges.select(*keys, "a", "b", w.alias("w")), "pairs")
    both = pairs.unionByName(pairs.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    out = both.groupBy(*keys, "a").agg(F.sum("w").alias("_out"))
    count = out.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    nodes = materialize(out.join(count, keys).withColumn("src", F.monotonically_increasing_id()), "nodes")
    source = nodes.select(*keys, "a", "src", "_out")
    target = nodes.select(*keys, F.col("a").alias("b"), F.col("src").alias("dst"))
    # Number the nodes once and lay links and nodes out by source: a round then moves only summed scores.
    spark = edges.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = both.join(source, [*keys, "a"]).join(target, [*keys, "b"]).select("src", "dst", (F.col("w") / F.col("_out")).alias("p"))
    links = materialize(links, "links").repartition(parts, "src").persist()
    sizes = nodes.select("src", "_n").repartition(parts, "src").persist()
    scores = sizes.select("src", (1 / F.col("_n")).alias("score"))
    for i in range(rounds):
        received = links.join(scores, "src").groupBy(F.col("dst").alias("src")).agg(F.sum(F.col("p") * F.col("score")).alias("_got"))
        scores = sizes.join(received, "src", "left").select(
            "src", ((1 - damping) / F.col("_n") + damping * F.coalesce("_got", F.lit(0.0))).alias("score"))
        if i % 5 == 4 or i == rounds - 1:
            scores = materialize(scores, "scores")
    links.unpersist()
    sizes.unpersist()
    return nodes.select(*keys, F.col("a").alias("node"), "src").join(scores, "src").select(*keys, "node", "score")
