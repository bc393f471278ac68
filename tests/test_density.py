"""Clusterings against plain single-machine twins on small inputs."""

import math

import numpy as np
import pytest

from topicloom.operators import density as dn


def tree_twin(x, copies_key, min_samples, alpha):
    """Merge list of all points, equal vectors as one point: [(w, lo, hi)], cores, reps, copies."""
    groups = {}
    for i, row in enumerate(x):
        groups.setdefault(tuple(row), []).append(i)
    reps = sorted((min(v), k, len(v)) for k, v in groups.items())
    ids = [r[0] for r in reps]
    pts = np.array([r[1] for r in reps])
    n = [r[2] for r in reps]
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(2))
    core = []
    for i in range(len(ids)):
        near = sorted((d[i, j], j) for j in range(len(ids)) if j != i)
        left, c = n[i] - 1, 0.0
        if left < min_samples:
            for dist, j in near:
                left, c = left + n[j], dist
                if left >= min_samples:
                    break
        core.append(c)
    edges = sorted(
        (max(core[i], core[j], d[i, j] / alpha), min(ids[i], ids[j]), max(ids[i], ids[j]))
        for i in range(len(ids)) for j in range(i + 1, len(ids))
    )
    return edges, dict(zip(ids, core)), ids, dict(zip(ids, n)), {i: ids for i in ids}, groups


def labels_twin(x, min_cluster_size=3, min_samples=3, alpha=1.0, cluster_selection_epsilon=0.0, cluster_selection_method="eom", allow_single_cluster=False):
    edges, core, ids, n, _, groups = tree_twin(x, None, min_samples, alpha)
    owner = {i: i for i in ids}
    node = {i: ("leaf", i, n[i]) for i in ids}

    def find(a):
        while owner[a] != a:
            a = owner[a]
        return a

    root = None
    for w, a, b in edges:
        ra, rb = find(a), find(b)
        if ra == rb:
            continue
        merged = ("merge", w, node[ra][2] + node[rb][2], node[ra], node[rb])
        owner[ra] = rb
        node[rb] = root = merged
    clusters, exits = [], []
    lam = lambda w: 1 / w if w > 0 else math.inf

    def members(t):
        return [t[1]] if t[0] == "leaf" else members(t[3]) + members(t[4])

    def walk(t, c, is_root):
        if t[0] == "leaf":
            exits.append((t[1], c, lam(core[t[1]]) if n[t[1]] >= min_cluster_size else None))
            return
        a, b = t[3], t[4]
        big = [k for k in (a, b) if k[2] >= min_cluster_size]
        if len(big) == 2:
            for k in (a, b):
                clusters.append({"parent": c, "birth": lam(t[1]), "size": k[2]})
                walk(k, len(clusters) - 1, False)
            return
        for k in (a, b):
            if k[2] < min_cluster_size:
                exits.extend((m, c, lam(t[1])) for m in members(k))
            else:
                walk(k, c, False)

    clusters.append({"parent": None, "birth": 0.0, "size": root[2]})
    walk(root, 0, True)
    kids = {i: [j for j, k in enumerate(clusters) if k["parent"] == i] for i in range(len(clusters))}
    stab = [0.0] * len(clusters)
    for p, c, v in exits:
        stab[c] += n[p] * (v - clusters[c]["birth"])
    for j, k in enumerate(clusters):
        if k["parent"] is not None:
            stab[k["parent"]] += k["size"] * (k["birth"] - clusters[k["parent"]]["birth"])
    chosen = set()
    if cluster_selection_method == "leaf":
        chosen = {i for i in kids if not kids[i] and (i or allow_single_cluster)}
    else:
        best = {}

        def rate(i):
            below = sum(rate(j) for j in kids[i])
            best[i] = not (kids[i] and below > stab[i])
            return max(stab[i], below)

        def take(i):
            if best[i] and (i or allow_single_cluster):
                chosen.add(i)
            else:
                for j in kids[i]:
                    take(j)

        rate(0)
        take(0)
    eps = cluster_selection_epsilon
    if eps > 0 and len(clusters) > 1:
        lifted = set()
        for c in chosen:
            if c and 1 / clusters[c]["birth"] < eps:
                while True:
                    p = clusters[c]["parent"]
                    if p == 0:
                        c = 0 if allow_single_cluster else c
                        break
                    c = p
                    if 1 / clusters[c]["birth"] > eps:
                        break
            lifted.add(c)
        chosen = lifted
        if 0 in chosen:
            chosen = {0}
    out = {}
    last = max([v for p, c, v in exits if c == 0] + [k["birth"] for k in clusters if k["parent"] == 0])
    for p, c, v in exits:
        while c not in chosen and clusters[c]["parent"] is not None:
            c = clusters[c]["parent"]
        ok = c in chosen and (c != 0 or v >= (1 / eps if eps > 0 else last))
        out[p] = c if ok else None
    lead = {}
    for p, c in out.items():
        if c is not None:
            lead[c] = min(lead.get(c, p), p)
    number = {c: i for i, (_, c) in enumerate(sorted((v, k) for k, v in lead.items()))}
    final = {}
    for members_ in groups.values():
        c = out[min(members_)]
        for m in members_:
            final[m] = -1 if c is None else number[c]
    return [final[i] for i in range(len(x))]


def blobs(seed=3, copies=True):
    rng = np.random.default_rng(seed)
    centers = [(0, 0), (6, 0), (0, 6), (7, 7)]
    x = np.concatenate([rng.normal(c, 0.4 + 0.1 * i, (30, 2)) for i, c in enumerate(centers)] + [rng.uniform(-6, 14, (10, 2))])
    if copies:
        x = np.concatenate([x, np.repeat(x[:1], 12, 0), x[40:44]])
    return np.round(x, 6)


def frame(spark, x, offset=0, **extra):
    rows = [(i + offset, [float(v) for v in row], *extra.values()) for i, row in enumerate(x)]
    names = "id long, v array<double>" + "".join(f", {k} {'string' if isinstance(v, str) else 'double'}" for k, v in extra.items())
    return spark.createDataFrame(rows, names)


RUNS = [
    {"min_cluster_size": 5, "cluster_selection_epsilon": 0.0, "allow_single_cluster": False, "cluster_selection_method": "eom"},
    {"min_cluster_size": 3, "cluster_selection_epsilon": 0.0, "allow_single_cluster": False, "cluster_selection_method": "leaf"},
    {"min_cluster_size": 3, "cluster_selection_epsilon": 0.45, "allow_single_cluster": False, "cluster_selection_method": "leaf"},
    {"min_cluster_size": 4, "cluster_selection_epsilon": 0.3, "allow_single_cluster": True, "cluster_selection_method": "eom"},
    {"min_cluster_size": 60, "cluster_selection_epsilon": 0.0, "allow_single_cluster": True, "cluster_selection_method": "eom"},
]


@pytest.mark.parametrize("cell_rows,block_rows,min_samples,alpha", [(1000, 1000, 3, 1.0), (20, 16, 2, 0.8)])
def test_hierarchy_equals_twin(spark, cell_rows, block_rows, min_samples, alpha):
    x = blobs()
    runs = [{**r, "min_samples": min_samples, "alpha": alpha} for r in RUNS]
    got = dn.sweep(frame(spark, x), "id", "v", runs, cell_rows, block_rows).collect()
    for k, run in enumerate(runs):
        mine = [r["label"] for r in sorted((r for r in got if r["run"] == k), key=lambda r: r["id"])]
        assert mine == labels_twin(x, **run), run


def test_blobs_are_found(spark):
    x = blobs(copies=False)
    got = dn.cluster(frame(spark, x), "id", "v", min_cluster_size=10, min_samples=5, cluster_selection_epsilon=0.0, allow_single_cluster=False).collect()
    found = {r["id"]: r["label"] for r in got}
    assert len({v for v in found.values() if v >= 0}) == 4
    for b in range(4):
        mine = [found[i] for i in range(30 * b, 30 * b + 30)]
        assert max(mine.count(v) for v in set(mine) if v >= 0) >= 24


def test_groups_cluster_apart_in_one_job(spark):
    x, y = blobs(3, False)[:60], blobs(5, False)[:60]
    both = frame(spark, x, 0, day="a").unionByName(frame(spark, y, 1000, day="b"))
    run = {"min_cluster_size": 4, "cluster_selection_epsilon": 0.0, "allow_single_cluster": False, "cluster_selection_method": "leaf"}
    got = {r["id"]: r["label"] for r in dn.cluster(both, "id", "v", ["day"], cell_rows=25, block_rows=20, **run).collect()}
    assert [got[i] for i in range(60)] == labels_twin(x, min_samples=3, **run)
    assert [got[1000 + i] for i in range(60)] == labels_twin(y, min_samples=3, **run)


def test_condensed_members(spark):
    x = blobs(copies=False)
    tree = dn.build_tree(frame(spark, x), "id", "v", 3)
    cond = dn.condense(tree, [{"min_cluster_size": 10}])
    sizes = {(r["c"]): r["n"] for r in dn.cluster_members(cond).groupBy("c").count().withColumnRenamed("count", "n").collect()}
    stated = {r["c"]: r["size"] for r in cond.clusters.collect()}
    assert sizes == stated and max(stated.values()) == len(x)


def dbscan_twin(x, w, eps, min_samples):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = d <= eps
    core = (near @ w) >= min_samples
    comp = np.where(core, np.arange(len(x)), len(x))
    while True:
        new = comp.copy()
        for i in np.flatnonzero(core):
            new[i] = min(comp[j] for j in np.flatnonzero(near[i] & core))
        if (new == comp).all():
            break
        comp = new
    number = {c: i for i, c in enumerate(sorted(set(comp[core])))}
    out = []
    for i in range(len(x)):
        owners = [comp[j] for j in np.flatnonzero(near[i] & core)]
        out.append(number[comp[i]] if core[i] else (number[min(owners)] if owners else -1))
    return out


@pytest.mark.parametrize("cell_rows,block_rows", [(1000, 1000), (15, 10)])
def test_dbscan_equals_twin(spark, cell_rows, block_rows):
    x = blobs()
    w = np.where(np.arange(len(x)) % 7 == 0, 2.5, 1.0)
    rows = [(i, [float(v) for v in r], float(w[i])) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, v array<double>, w double")
    got = {r["id"]: r["label"] for r in dn.dbscan(df, "id", "v", 0.5, 5, "w", cell_rows, block_rows).collect()}
    assert [got[i] for i in range(len(x))] == dbscan_twin(x, w, 0.5, 5)


def test_steps_of_a_sweep_are_not_broadcast(spark, monkeypatch):
    """Their rows are points times runs: small on disk, but all of them would go through the driver."""
    plans = []
    real = dn.materialize

    def noted(df, *a, **kw):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, *a, **kw)

    rows = [(i, [float(i % 7) + i / 1000.0, float(i % 5)], i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    tree = dn.build_tree(df, "id", "v", 3)
    monkeypatch.setattr(dn, "materialize", noted)
    runs = [{**dn.PIPE_DEFAULTS, "min_cluster_size": 3}, {**dn.LEAF_DEFAULTS, "min_cluster_size": 5}]
    labels = dn.label_points(tree, dn.condense(tree, runs))
    plans.append(labels._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 8 and labels.count() == 120
    joins = [line for p in plans for line in p.split("\n") if "BroadcastHashJoin" in line]
    assert not [line for line in joins if "_range" not in line]  # offsets of ranges are few
