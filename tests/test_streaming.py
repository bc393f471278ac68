"""Micro-clusters against a plain sequential twin; streams against batches."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.session import materialize, work_path
from topicloom.streaming import incremental as inc
from topicloom.streaming import microclusters as mc


def twin(samples, p):
    """One plain pass over (x, w) samples: lists of [mean, var, weight, born]."""
    pot, out, t = [], [], 0
    fade = 2 ** (-p.lambd)

    def nearest(pool, x):
        return min(range(len(pool)), key=lambda i: (np.linalg.norm(pool[i][0] - x), i)) if pool else None

    def grown(c, x, w):
        new = c[2] * fade + w
        mean = c[0] + w / new * (x - c[0])
        var = c[1] * (new - w) / c[2] + w * (x - mean) * (x - c[0])
        return [mean, var, new, c[3]]

    for x, w in samples:
        done = False
        for pool in (pot, out):
            i = nearest(pool, x)
            if i is None:
                continue
            g = grown(pool[i], x, w)
            if np.linalg.norm(np.sqrt(g[1] / g[2])) <= p.eps:
                pool[i], done = g, True
                if pool is out and g[2] > p.threshold:
                    pot.append(out.pop(i))
                break
        if not done:
            out.append([x, np.zeros(len(x)), w, t])
        if t % p.period == 0:
            pot = [c for c in pot if c[2] >= p.threshold]
            base = 2 ** (-p.lambd * p.period) - 1
            out = [c for c in out if c[2] >= (2 ** (-p.lambd * (t - c[3] + p.period)) - 1) / base]
        t += 1
    return pot, out


PARAMS = mc.Fading(lambd=0.1, eps=1.0, beta=0.5, mu=3.0, max_weight=2.0)


def rows(n=80):
    rng = np.random.default_rng(2)
    centers = np.array([[0.0, 0.0], [8.0, 8.0], [0.0, 9.0]])
    return [(i, "ab"[i % 2], [float(v) for v in centers[rng.integers(3)] + rng.normal(0, 0.6, 2)], float(rng.integers(1, 3))) for i in range(n)]


@pytest.mark.parametrize("batches", [1, 3])
def test_stream_equals_sequential_pass(spark, batches):
    data = rows()
    df = spark.createDataFrame(data, "i long, k string, x array<double>, w double")
    stream = inc.file_stream(spark, df, batches, "i", "samples")
    target = work_path(spark, "snapshots")
    found = mc.micro_clusters(mc.checked_weight(stream, "w"), "k", "x", ["i"], PARAMS)
    found.writeStream.format("parquet").option("path", target).option("checkpointLocation", work_path(spark, "ck")).trigger(availableNow=True).start().awaitTermination()
    got = mc.latest(spark.read.parquet(target), "k").orderBy("k", "kind", "place").collect()
    for key in "ab":
        pot, out = twin([(np.array(x), w) for _, k, x, w in data if k == key], PARAMS)
        for kind, pool in (("potential", pot), ("outlier", out)):
            mine = [r for r in got if r["k"] == key and r["kind"] == kind]
            assert len(mine) == len(pool)
            for r, c in zip(mine, pool):
                assert np.allclose(r["center"], c[0]) and math.isclose(r["weight"], c[2]) and r["born"] == c[3]
        assert pot


def test_lanes_and_offline_labels(spark):
    df = spark.createDataFrame(rows(400), "i long, k string, x array<double>, w double")
    stream = inc.file_stream(spark, df, 2, "i", "samples")
    target = work_path(spark, "snapshots")
    found = mc.micro_clusters(mc.checked_weight(stream), "k", "x", ["i"], PARAMS, lanes=3)
    found.writeStream.format("parquet").option("path", target).option("checkpointLocation", work_path(spark, "ck")).trigger(availableNow=True).start().awaitTermination()
    snaps = spark.read.parquet(target)
    assert snaps.select("lane").distinct().count() == 3
    labels = {r["i"]: r["label"] for r in mc.offline_labels(df, "i", "x", snaps, "k", eps=3.0, min_samples=2).collect()}
    groups = {}
    for i, _, x, _ in rows(400):
        groups.setdefault((x[0] > 4, x[1] > 4.5), set()).add(labels[i])
    assert all(len(v) == 1 for v in groups.values()) and len(set.union(*groups.values())) == 3


def test_cluster_born_on_a_pruning_step_stays():
    for params in (mc.Fading(), mc.Fading(lambd=0.3, beta=0.6, mu=2.5)):
        model = mc.MicroClusters(1)
        model.learn(np.array([0.0]), 1.0, params)  # step 0 prunes
        assert model.outlier.weight.tolist() == [1.0] and model.outlier.born.tolist() == [0]
        for i in range(params.period):
            model.learn(np.array([100.0 * (i + 1)]), 1.0, params)
        assert 100.0 * params.period in model.outlier.mean.ravel()


def test_weight_zero_is_an_empty_cluster():
    params = mc.Fading(lambd=0)
    model = mc.MicroClusters(1)
    model.learn(np.array([500.0]), 0.0, params)
    model.learn(np.array([-9000.0]), 1.0, params)  # the empty cluster begins anew with it
    model.learn(np.array([500.0]), 1.0, params)
    model.learn(np.array([700.0]), 0.0, params)  # joins its neighbor without effect
    assert sorted(zip(model.outlier.mean.ravel().tolist(), model.outlier.weight.tolist())) == [(-9000.0, 1.0), (500.0, 1.0)]
    assert not np.isnan(model.outlier.var).any()
    model = mc.MicroClusters(1)
    for v in (500.0, 700.0):
        model.learn(np.array([v]), 0.0, params)  # nothing can join an empty cluster with nothing
    assert model.outlier.weight.tolist() == [0.0, 0.0]


def test_heavy_samples_are_refused():
    with pytest.raises(ValueError, match="max_weight"):
        mc.MicroClusters(1).learn(np.array([0.0]), 1.5, mc.Fading())


def test_no_centers_means_outliers(spark):
    df = spark.createDataFrame([(1, "a", [0.0, 0.0])], "i long, k string, x array<double>")
    none = spark.createDataFrame([], "k string, lane int, t long, kind string, place int, center array<double>, weight double, radius double, born long")
    assert [r["label"] for r in mc.offline_labels(df, "i", "x", none, "k").collect()] == [-1]


def test_parameters_are_checked():
    for bad in ({"lambd": 1, "beta": 2, "mu": 2}, {"beta": 0.5, "mu": 2}, {"lambd": -1}):
        with pytest.raises(ValueError):
            mc.Fading(**bad)
    assert mc.Fading(lambd=0).period is None and mc.Fading().period == 11
    model = mc.MicroClusters(1)
    for v in (0.0, 0.1, 0.2):
        model.learn(np.array([v]), 1.0, mc.Fading(lambd=0))
    assert model.t == 3 and len(model.potential.weight) == 1


def test_weights_are_checked(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "w double")
    with pytest.raises(Exception, match="sample weights"):
        mc.checked_weight(df, "w").collect()
    assert mc.checked_weight(df, None).select("weight").distinct().count() == 1


def test_ingest_is_idempotent(spark):
    df = spark.createDataFrame([(i % 10, i, f"t{i % 10}") for i in range(20)], "uid long, n long, text string")
    target = work_path(spark, "ingest")
    for _ in range(2):
        inc.ingest(inc.file_stream(spark, df, 2, "n", "docs"), "uid", lambda d: d.select("uid", F.length("text").alias("e")), target, work_path(spark, "ck"))
    assert sorted(r["uid"] for r in spark.read.parquet(target).collect()) == list(range(10))


def test_growing_clusters_find_planted_groups(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, (24, 2)) for c in [(0, 0), (6, 6)]])
    order = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), [float(v) for v in x[i]]) for i in order], "id long, v array<double>")
    model = inc.GrowingClusters("id", "v", min_cluster_size=8, min_samples=3, cluster_selection_epsilon=0.0, allow_single_cluster=False)
    model.add(df.where("id % 2 = 0"))
    labels = {r["id"]: r["label"] for r in model.add(df.where("id % 2 = 1")).collect()}
    assert len(labels) == 48
    found = [{labels[i] for i in range(24 * g, 24 * g + 24)} - {-1} for g in range(2)]
    assert all(found) and not found[0] & found[1]


def test_growing_clusters_survive_a_restart_and_a_replay(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.3, (20, 2)) for c in [(0, 0), (6, 6)]] + [np.repeat([[6.0, 6.0]], 12, 0)])
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    parts = [df.where(F.col("id") % 2 == i) for i in range(2)]
    params = dict(min_cluster_size=6, min_samples=3, cluster_selection_epsilon=0.0, allow_single_cluster=False)
    rows = lambda labels: sorted((r["id"], r["label"]) for r in labels.collect())
    path = work_path(spark, "grow")
    first = rows(inc.GrowingClusters("id", "v", path=path, **params).add(parts[0], 0))
    # another process goes on from the stored version
    again = inc.GrowingClusters("id", "v", path=path, **params)
    assert again.versions(spark) == [0]
    second = rows(again.add(parts[1], 1))
    assert len(first) == 26 and [i for i, _ in second] == list(range(52))
    found = [{label for i, label in second if i in group} - {-1} for group in (range(20), range(20, 52))]
    assert all(found) and not found[0] & found[1]
    # a replayed batch starts from the version before it, and overwrites its own
    assert rows(inc.GrowingClusters("id", "v", path=path, **params).add(parts[1], 1)) == second
    assert again.versions(spark) == [0, 1]
    # a batch that died before its mark is no version: what it left is overwritten
    spark.createDataFrame([(99, 99)], "id long, rep long").write.parquet(f"{path}/members/batch=2")
    assert again.versions(spark) == [0, 1]
    assert rows(again.add(parts[0], 2)) == second  # nothing new


def test_batches_of_a_replay_are_not_sorted_whole(spark, monkeypatch):
    """Batches follow the order column, nulls first; only that column is shuffled into the ranges, not whole rows."""
    steps = []
    monkeypatch.setattr(inc, "materialize", lambda d, name: steps.append(d._jdf.queryExecution().executedPlan().toString()) or materialize(d, name))
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 > 0, F.col("id")).alias("n"), F.lit("x").alias("text")).repartition(5)
    stream = inc.file_stream(spark, df, 2, "n", "replayed", files=3)
    got = {}
    inc.run_to_end(stream, lambda b, i: got.update({i: [r["n"] for r in b.collect()]}), work_path(spark, "ck"))
    assert sorted(got) == [0, 1]
    first, second = got[0], got[1]
    assert len(first) + len(second) == 1000 and None in first and None not in second
    assert max(n for n in first if n is not None) < min(second)
    assert len(steps) == 1 and "rangepartitioning" not in steps[0]
