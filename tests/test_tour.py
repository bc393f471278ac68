"""Tours of trees and range joins against plain recursion."""

import random

import pytest
from pyspark.sql import functions as F

from topicloom.operators import graph as gr


def forest(seed, n=120):
    """(run, node, parent): two runs with trees of random shape, several roots, one without children."""
    rnd = random.Random(seed)
    rows = []
    for run in (0, 1):
        rows += [(run, i, None if i % 40 == 0 else rnd.randrange(i // 40 * 40, i)) for i in range(n)]
        rows.append((run, n, None))
    return rows


def twin(rows):
    """(run, node) -> (root, low, high) by recursion."""
    kids = {}
    for run, node, parent in rows:
        kids.setdefault((run, parent), []).append(node)
    out = {}

    def walk(run, node, root, steps):
        steps.append((node, "high"))
        for k in sorted(kids.get((run, node), [])):
            walk(run, k, root, steps)
        steps.append((node, "low"))

    for run in {r[0] for r in rows}:
        for root in kids[run, None]:
            steps = []
            walk(run, root, root, steps)
            for i, (node, side) in enumerate(steps):
                out.setdefault((run, node), {"root": root})[side] = len(steps) - 1 - i
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_tour_and_ancestors(spark, seed):
    rows = forest(seed)
    df = spark.createDataFrame(rows, "run int, c int, parent int")
    found = {(r["run"], r["c"]): {"root": r["root"], "low": r["low"], "high": r["high"]} for r in gr.tour(df, ["run"], "c", "parent").collect()}
    assert found == twin(rows)
    up = {(run, c): p for run, c, p in rows}
    wanted = []
    for run, c, _ in rows:
        a = c
        while a is not None:
            wanted.append((run, c, a))
            a = up[run, a]
    pairs = [(r["run"], r["c"], r["ancestor"]) for r in gr.ancestor_pairs(df, ["run"], "c", "parent").collect()]
    assert sorted(pairs) == sorted(wanted)


def test_chain_takes_few_rounds(spark, monkeypatch):
    """500 levels: the rounds are the logarithm of the 1000 steps."""
    rounds = []
    plain = gr.materialize
    monkeypatch.setattr(gr, "materialize", lambda df, name="step": (rounds.append(name), plain(df, name))[1])
    df = spark.createDataFrame([(i, i - 1 if i else None) for i in range(500)], "c int, parent int")
    found = {r["c"]: (r["low"], r["high"]) for r in gr.tour(df, [], "c", "parent").collect()}
    assert found == {i: (i, 999 - i) for i in range(500)}
    assert rounds.count("tour") <= 12


def test_ranges_meet_once(spark):
    rnd = random.Random(5)
    spans = [(g, i, *sorted((rnd.randrange(0, 70), rnd.randrange(0, 70)))) for g in (0, 1) for i in range(60)] + [(0, 60, 3, 3), (1, 61, 0, 64), (1, 62, 0, 1)]
    points = [(g, i, rnd.randrange(0, 90)) for g in (0, 1, 2) for i in range(80)]
    found = gr.inside(spark.createDataFrame(points, "g int, p int, at long"), spark.createDataFrame(spans, "g int, s int, lo long, hi long"), ["g"], "at", "lo", "hi")
    wanted = [(g, p, s) for g, p, at in points for h, s, lo, hi in spans if g == h and lo <= at < hi]
    assert sorted((r["g"], r["p"], r["s"]) for r in found.collect()) == sorted(wanted)


def test_empty_and_single(spark):
    df = spark.createDataFrame([("a", None)], "c string, parent string")
    assert [tuple(r) for r in gr.tour(df, [], "c", "parent").select("c", "root", "low", "high").collect()] == [("a", "a", 0, 1)]
    assert [tuple(r) for r in gr.ancestor_pairs(df, [], "c", "parent").collect()] == [("a", "a")]
    assert gr.ancestor_pairs(df.where(F.lit(False)), [], "c", "parent").collect() == []


@pytest.mark.parametrize("rows", [[(0, 1), (1, 0)], [(0, None), (1, 7)], [(0, None), (0, None)]])
def test_what_is_no_tree_is_refused(spark, rows):
    with pytest.raises(ValueError):
        gr.tour(spark.createDataFrame(rows, "c int, parent int"), [], "c", "parent")


def test_joins_of_trees_are_not_broadcast(spark):
    """Both sides have a row per node; a broadcast would pass them through the driver."""
    rows = forest(3)
    df = spark.createDataFrame(rows, "run int, node int, parent int")
    found = gr.ancestor_pairs(df, ["run"], "node", "parent")
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
