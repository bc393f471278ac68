"""Neighbor graph by descent, distances given as functions, pairs above a score."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.operators import density as dn
from topicloom.operators import descent as ds
from topicloom.operators import similarity as sm


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")


def by_value():
    """A function that is sent to workers as it is: they can't import this module."""

    def half(a, b):
        return (np.abs(a[:, None] - b[None]) ** 0.5).sum(2) ** 2

    return half


half = by_value()


def cloud(n, dim=6, seed=7):
    return np.random.default_rng(seed).normal(size=(n, dim))


def recall(lists, d, k):
    np.fill_diagonal(d, np.inf)
    true = d.argsort(1)[:, :k]
    return sum(r["neighbor"] in true[r["rep"]] for r in lists.where(F.col("rank") <= k).collect()) / (len(d) * k)


def test_recall_and_work_per_row(spark):
    work = {}
    for n in (600, 2400):
        x = cloud(n)
        graph = ds.neighbor_graph(frame(spark, x), "id", "v", 10)
        assert recall(graph.lists, ((x[:, None] - x[None]) ** 2).sum(2), 8) >= 0.9
        counts = {r["rep"]: r["count"] for r in graph.lists.groupBy("rep").count().collect()}
        assert len(counts) == n and set(counts.values()) == {10}
        work[n] = graph.compared / n / (graph.rounds + 1)
    assert work[2400] <= 1.25 * work[600]  # comparisons per row and round


def test_function_as_distance(spark):
    x = cloud(300, 4)
    graph = ds.neighbor_graph(frame(spark, x), "id", "v", 10, half)
    d = half(x, x)
    assert recall(graph.lists, d.copy(), 8) >= 0.9
    assert all(abs(r["distance"] - d[r["rep"], r["neighbor"]]) < 1e-9 for r in graph.lists.collect())
    df = frame(spark, x[:80])
    np.fill_diagonal(d, np.inf)
    want = [(i, int(j)) for i in range(80) for j in d[i, :80].argsort()[:3]]
    got = sm.nearest(df, df, "id", "v", 3, half, include_self=False, block_rows=16)
    assert sorted((r["id"], r["neighbor"]) for r in got.collect()) == sorted(want)
    eps = float(np.quantile(d[:80, :80][np.isfinite(d[:80, :80])], 0.05))
    labels = {r["id"]: r for r in dn.dbscan(df, "id", "v", eps, 4, block_rows=16, distance=half).collect()}
    near = (d[:80, :80] <= eps) | np.eye(80, dtype=bool)
    core = near.sum(1) >= 4
    assert [labels[i]["core"] for i in range(80)] == core.tolist()
    for i in np.flatnonzero(core):
        assert len({labels[int(j)]["label"] for j in np.flatnonzero(core & near[i])}) == 1


def test_hubs_copies_and_small_tables(spark):
    x = np.concatenate([cloud(200, 3), np.repeat(np.zeros((1, 3)), 120, 0)])  # one vector in a third of all rows
    rows = ds.nearest(frame(spark, x), "id", "v", 4).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    got = {}
    for r in rows:
        got.setdefault(r["id"], []).append(r["distance"])
    assert all(len(got[i]) == 4 for i in range(len(x)))
    near = np.sort(d, 1)[:, :4]
    assert np.mean([np.allclose(sorted(got[i]), near[i], atol=1e-9) for i in range(len(x))]) >= 0.95
    assert all(max(got[i]) == 0 for i in range(200, 320))
    for n in (0, 1, 2):
        assert ds.neighbor_graph(frame(spark, x[:n]), "id", "v", 5).lists.count() == (2 if n == 2 else 0)
    with pytest.raises(ValueError):
        ds.neighbor_graph(frame(spark, x), "id", "v", 5, "unheard-of")


def test_graph_clusters_equal_exact_ones_on_planted_groups(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.25, (40, 2)) for c in ((0, 0), (6, 0), (0, 6))] + [np.repeat([[0.0, 0.0]], 20, 0)])
    params = {"min_cluster_size": 8, "min_samples": 4, "cluster_selection_epsilon": 0.0, "allow_single_cluster": False}
    exact = {r["id"]: r["label"] for r in dn.cluster(frame(spark, x), "id", "v", **params).collect()}
    graph = {r["id"]: r["label"] for r in dn.cluster_graph(frame(spark, x), "id", "v", **params).collect()}
    assert graph.keys() == exact.keys()
    # the graph misses few edges, so few labels differ; clusters are numbered by their smallest member both times
    assert np.mean([graph[i] == exact[i] for i in exact]) >= 0.95


@pytest.mark.parametrize("cell_rows,block_rows", [(1000, 1000), (20, 16)])
def test_pairs_above_a_score(spark, cell_rows, block_rows):
    x = cloud(150, 5)
    x = np.concatenate([x, np.repeat(x[:1], 40, 0)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = frame(spark, x)
    got = {(r["a"], r["b"]): r for r in sm.pairs_above(df, "id", "v", 0.5, cell_rows, block_rows).collect()}
    s = x[:150] @ x[:150].T
    assert set(got) == {(a, b) for a in range(150) for b in range(a + 1, 150) if s[a, b] >= 0.5}
    assert all(r["copies_a"] == (41 if a == 0 else 1) and r["copies_b"] == 1 and abs(r["score"] - s[a, b]) < 1e-12 for (a, b), r in got.items())
    assert {r["id"]: r["rep"] for r in sm.classes(df, "id", "v").collect()} == {i: i if i < 150 else 0 for i in range(190)}


def test_a_full_list_hears_of_nearer_rows_only():
    x = cloud(40)
    ids, group, fresh = np.arange(40), np.repeat([0, 1], 20), np.ones(40, bool)
    every = ds._best_in_groups(ids, x, group, fresh, 5, "euclidean")
    limit = np.where(ids % 2 == 0, every.groupby("a")["d"].nth(2).to_numpy(), np.nan)  # lists of odd rows aren't full
    found = ds._best_in_groups(ids, x, group, fresh, 5, "euclidean", limit)
    assert found.groupby("a").size().tolist() == [3, 5] * 20
    kept = every[~(every["d"] > limit[every["a"]])]
    assert sorted(zip(kept["a"], kept["b"], kept["d"])) == sorted(zip(found["a"], found["b"], found["d"]))
