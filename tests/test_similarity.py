"""Similarity search against numpy."""

import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.operators import cells as cl
from topicloom.operators import similarity as sm
from topicloom.operators import summaries as su
from topicloom.operators.graph import ancestor_pairs, components, rank_nodes
from topicloom.session import materialize, shared_dir, step_scope

RNG = np.random.default_rng(5)
X = RNG.normal(size=(150, 6))
X = np.concatenate([X, np.repeat(X[:1], 60, 0)])
X /= np.linalg.norm(X, axis=1)[:, None]


def frame(spark, x=X):
    return spark.createDataFrame([(i, [float(v) for v in r], i % 4 - 1) for i, r in enumerate(x)], "id long, v array<double>, label int")


def matrix(metric):
    if metric == "cosine":
        return 1 - X @ X.T
    if metric == "angular":
        return np.arccos(np.clip(X @ X.T, -1, 1)) / np.pi
    if metric == "cityblock":
        return np.abs(X[:, None] - X[None]).sum(2)
    d = np.sqrt(((X[:, None] - X[None]) ** 2).sum(2))
    return d * d if metric == "sqeuclidean" else d


@pytest.mark.parametrize("metric,cell_rows,block_rows", [
    ("cosine", 1000, 1000), ("cosine", 20, 16), ("angular", 1000, 20), ("cityblock", 25, 20), ("euclidean", 25, 1000), ("sqeuclidean", 30, 30)])
def test_nearest(spark, metric, cell_rows, block_rows):
    df = frame(spark)
    got = {}
    for r in sm.nearest(df, df, "id", "v", 4, metric, include_self=False, cell_rows=cell_rows, block_rows=block_rows).collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["neighbor"], r["distance"])
    d = matrix(metric)
    for i in range(len(X)):
        want = sorted((round(max(d[i, j], 0.0), 7), j) for j in range(len(X)) if j != i)[:4]
        mine = [got[i][k + 1] for k in range(4)]
        assert np.allclose([m[1] for m in mine], [w[0] for w in want], atol=1e-6)
        assert [m[0] for m in mine] == [w[1] for w in want]


def test_top_k_beyond_rows(spark):
    df = frame(spark, X[:5])
    assert sm.nearest(df, df, "id", "v", 50).count() == 25


def test_probes_are_a_subset_with_good_recall(spark):
    df = frame(spark)
    some = {(r["id"], r["neighbor"]) for r in sm.nearest(df, df, "id", "v", 5, probes=2, cell_rows=40).collect()}
    exact = {(r["id"], r["neighbor"]) for r in sm.nearest(df, df, "id", "v", 5).collect()}
    assert len(some & exact) / len(exact) > 0.6


@pytest.mark.parametrize("cell_rows", [1000, 25])
def test_nearest_to_centroids(spark, cell_rows):
    df = frame(spark)
    got = {}
    for r in sm.nearest_to_centroids(df, df, "id", "v", "label", 10, cell_rows=cell_rows, block_rows=30).collect():
        got.setdefault(r["label"], {})[r["rank"]] = r["neighbor"]
    label = np.arange(len(X)) % 4 - 1
    assert set(got) == {0, 1, 2}
    for c in got:
        mine = X[label == c]
        d = 1 - X @ mine.mean(0)
        k = -(-len(mine) // 10)
        assert [got[c][i + 1] for i in range(k)] == [j for _, j in sorted((round(v, 9), j) for j, v in enumerate(d))][:k]


@pytest.mark.parametrize("measure", ["cosine", "sqeuclidean"])
def test_silhouette(spark, measure):
    d = matrix(measure)
    label = np.arange(len(X)) % 4 - 1
    want = []
    for i in range(len(X)):
        own = (label == label[i]) & (np.arange(len(X)) != i)
        a = d[i, own].mean()
        b = min(d[i, label == c].mean() for c in set(label) if c != label[i])
        want.append((b - a) / max(a, b))
    got = [r["silhouette"] for r in sm.silhouette_rows(frame(spark), "id", "v", "label", measure).orderBy("id").collect()]
    assert np.allclose(got, want, atol=1e-6)
    assert abs(sm.silhouette(frame(spark), "id", "v", "label", measure).first()[0] - np.mean(want)) < 1e-6


def test_pairs_and_search(spark):
    df = frame(spark, X[:40])
    s = X[:40] @ X[:40].T
    want = sorted(((-round(s[a, b], 9), a, b) for a in range(40) for b in range(a + 1, 40)))[:5]
    got = [(r["a"], r["b"]) for r in sm.similar_pairs(df, "id", "v", 39, limit=5).collect()]
    assert got == [(a, b) for _, a, b in want]
    found = [r["id"] for r in sm.search(df, "id", "v", [3], 4).orderBy("rank").collect()]
    assert found == [j for _, j in sorted((-round(v, 9), j) for j, v in enumerate(s[3]))][:4]


def test_centrality_is_the_stationary_walk(spark):
    v = np.abs(X[:30])
    v /= np.linalg.norm(v, axis=1)[:, None]
    s = v @ v.T
    walk = s / s.sum(1, keepdims=True)
    p = np.full(30, 1 / 30)
    for _ in range(200):
        p = p @ walk
    df = spark.createDataFrame([(i, "t", [float(x) for x in r]) for i, r in enumerate(v)], "i int, topic string, v array<double>")
    got = [r["centrality"] for r in su.centrality(df, "topic", "v", 6).orderBy("i").collect()]
    assert np.allclose(got, p * 30, atol=1e-9)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i != 20] + [(60, 50), (50, 60)], "a int, b int")
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 50, 60, 70]], "n int")
    got = {r["n"]: r["component"] for r in components(edges, nodes, "n").collect()}
    assert {got[i] for i in range(21)} == {0} and {got[i] for i in range(21, 41)} == {21}
    assert (got[50], got[60], got[70]) == (50, 50, 70)


def test_rank_nodes(spark):
    pairs = [("t", "a", "b", 3), ("t", "a", "c", 1), ("t", "c", "d", 2), ("u", "a", "z", 1)]
    df = spark.createDataFrame(pairs, "t string, a string, b string, n int")
    got = {(r["t"], r["node"]): r["score"] for r in rank_nodes(df, ["t"], 7, weight=F.col("n")).collect()}
    names = ["a", "b", "c", "d"]
    w = np.zeros((4, 4))
    for t, a, b, n in pairs[:3]:
        w[names.index(a), names.index(b)] = w[names.index(b), names.index(a)] = n
    p = np.full(4, 0.25)
    for _ in range(7):
        p = 0.15 / 4 + 0.85 * (p @ (w / w.sum(1, keepdims=True)))
    assert np.allclose([got[("t", x)] for x in names], p) and abs(got[("u", "z")] - 0.5) < 1e-9


def test_ancestor_pairs(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", "a"), (1, "c", "b")], "run int, c string, p string")
    got = {(r["c"], r["ancestor"]) for r in ancestor_pairs(df, ["run"], "c", "p").collect()}
    assert got == {("a", "a"), ("b", "b"), ("c", "c"), ("b", "a"), ("c", "b"), ("c", "a")}


@pytest.mark.parametrize("rows", [1500, 6000])
def test_blocks_grow_with_the_table(spark, rows):
    """A vector is copied once per block or chunk it meets: their number stays the same however small the cells are."""
    df = spark.range(rows).select("id", F.array(*[F.rand(i) for i in range(3)]).alias("v"))
    found = cl.build_cells(df, "id", "v", cell_rows=4, block_rows=8)
    assert len(found.pivots) > 300
    assert found.sizes.agg(F.sum(F.ceil(F.col("rows") / found.block_rows))).first()[0] <= 3 * cl.GRID


def test_few_copies_of_rows_all_alike(spark, monkeypatch):
    """Where every row meets every cell, it is copied for about ``GRID`` blocks of the others, on each side; some rows are asked at a time."""
    df = spark.range(3000).select("id", F.array(*[F.randn(i) for i in range(24)]).alias("v"))
    found = cl.build_cells(df, "id", "v", cell_rows=64, block_rows=8)
    assert found.sizes.agg(F.sum(F.ceil(F.col("rows") / found.block_rows))).first()[0] <= 12
    monkeypatch.setattr(cl, "VISIT_ROWS", 7)
    got = sm.nearest(df.limit(90), df.limit(90), "id", "v", 3, "euclidean", cell_rows=16, block_rows=8).collect()
    x = np.array([r["v"] for r in df.orderBy("id").limit(90).collect()])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert {(r["id"], r["rank"]): r["neighbor"] for r in got} == {(i, k + 1): j for i in range(90) for k, j in enumerate(d[i].argsort()[:3])}


def test_steps_of_a_scope(spark):
    with step_scope(spark):
        with step_scope(spark):
            gone, stays = materialize(spark.range(3), "inner-scope"), materialize(spark.range(4), "outer-scope", kept=True)
            assert gone.count() == 3
        assert stays.count() == 4
        folder = pathlib.Path(shared_dir(spark).removeprefix("file:"))
        assert not [*folder.glob("inner-scope-*")] and len([*folder.glob("outer-scope-*")]) == 1
    assert not [*folder.glob("outer-scope-*")]


def test_tiles_hold_every_asked_pair_once():
    rnd = np.random.default_rng(1)
    keep, own, cell = rnd.random((50, 6)) < 0.4, rnd.integers(0, 6, 50), rnd.choice([0, 2, 3, 5], 70)
    seen = np.zeros((50, 70), int)
    for rows, parts in cl.tiles(keep, own, cell, 8):
        for i, j in parts:
            assert len(i) <= 8 and len(j) <= 8
            seen[np.ix_(rows[i], j)] += 1
    assert (seen == keep[:, cell]).all()


def test_cityblock_bound_holds():
    rnd = np.random.default_rng(2)
    a, b = rnd.normal(0, 100, (40, 64)), rnd.normal(0, 100, (300, 64))
    d, error = cl.rough_l1(a, b)
    assert (np.abs(d - np.abs(a[:, None] - b[None]).sum(2)) <= error[:, None]).all()
