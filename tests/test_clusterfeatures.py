"""Additive cluster features against a plain pass over all samples."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.session import work_path
from topicloom.streaming import clusterfeatures as cf

SPEC = cf.Cells(side=2.0, half_life=3600.0, threshold=3.0, pane="30 minutes", late="1 hour")
START = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
SCHEMA = "id int, key string, x array<double>, at timestamp, w double"


def rows(n=600, seed=4):
    """Nine of ten rows on one key; a few cells."""
    rng = np.random.default_rng(seed)
    return [(i, "hot" if i % 10 else "cold", [float(v) for v in rng.normal(0, 3, 2)], START + dt.timedelta(seconds=25 * i), float(rng.integers(1, 4))) for i in range(n)]


def twin(data, spec, dim=2):
    """Cell -> (n, weight, center, radius) at the time of the newest sample, straight from the samples."""
    now = max(r[3] for r in data)
    cells = {}
    for _, key, x, at, w in data:
        cells.setdefault((key, tuple(int(np.floor(v / spec.side)) for v in x)), []).append((np.array(x), w * 2 ** (-(now - at).total_seconds() / spec.half_life)))
    out = {}
    for name, members in cells.items():
        x, w = np.array([m[0] for m in members]), np.array([m[1] for m in members])
        center = (x * w[:, None]).sum(0) / w.sum()
        out[name] = (len(w), w.sum(), center, np.sqrt((w * ((x - center) ** 2).sum(1)).sum() / w.sum()))
    return out


def same(found, wanted):
    assert {(r["key"], tuple(r["cell"])) for r in found} == set(wanted) and len(found) == len(wanted)
    for r in found:
        n, weight, center, radius = wanted[r["key"], tuple(r["cell"])]
        assert r["n"] == n and r["weight"] == pytest.approx(weight) and r["center"] == pytest.approx(center.tolist())
        assert r["radius"] == pytest.approx(radius, abs=1e-6)
        assert r["kind"] == ("potential" if weight >= SPEC.threshold else "outlier")


def test_hot_key_over_tasks_equals_one_pass(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    features = cf.cell_features(df, "key", "x", "at", 2, SPEC, "w")
    same(cf.merged(features, 2, SPEC).collect(), twin(data, SPEC))
    # Sums are made before the shuffle, in every task.
    assert features._jdf.queryExecution().executedPlan().toString().count("HashAggregate") >= 2


def test_parts_of_a_key_add_up(spark):
    """Features of separate sites, merged by union, are those of all samples."""
    data = rows()
    sites = [cf.cell_features(spark.createDataFrame(data[i::3], SCHEMA), "key", "x", "at", 2, SPEC, "w") for i in range(3)]
    same(cf.merged(sites[0].unionByName(sites[1]).unionByName(sites[2]), 2, SPEC).collect(), twin(data, SPEC))


def streamed(spark, batches, path, checkpoint, source):
    """One file per micro-batch, in the order given."""
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = cf.keep_features(cf.cell_features(stream, "key", "x", "at", 2, SPEC, "w"), path, checkpoint)
        query.awaitTermination()
    return cf.newest_features(spark, path)


def test_stream_with_restarts_equals_one_pass(spark):
    data = rows(300)
    path = work_path(spark, "cf")
    kept = streamed(spark, [data[:90], data[90:200], data[200:]], path, work_path(spark, "cp"), work_path(spark, "src"))
    same(cf.merged(kept, 2, SPEC).collect(), twin(data, SPEC))


def test_rows_behind_the_watermark_are_refused(spark):
    """Rows within the lateness count, rows of panes closed by the watermark don't."""
    data = rows(900)  # 25 s apart, 6 h 15 in all
    first, second = data[:450], data[450:]
    held = [r for r in first if 380 <= r[0] < 400]  # about 25 minutes before the end: late, but in time
    lost = first[:20]  # hours before the end
    sent = [r for r in first[20:] if r not in held]
    path = work_path(spark, "cf")
    kept = streamed(spark, [sent, held + lost, second], path, work_path(spark, "cp"), work_path(spark, "src"))
    same(cf.merged(kept, 2, SPEC).collect(), twin(sent + held + second, SPEC))


def test_unsound_rows_and_null_keys(spark):
    good = [(1, None, [0.5, 0.5], START, 1.0), (2, None, [0.7, 0.1], START, 1.0), (3, "a", [-0.5, 9.0], START, 2.0)]
    bad = [(4, "a", None, START, 1.0), (5, "a", [1.0], START, 1.0), (6, "a", [1.0, None], START, 1.0),
           (7, "a", [float("nan"), 1.0], START, 1.0), (8, "a", [float("inf"), 1.0], START, 1.0), (9, "a", [1.0, 1.0], None, 1.0)]
    df = spark.createDataFrame(good + bad, SCHEMA)
    same(cf.merged(cf.cell_features(df, "key", "x", "at", 2, SPEC, "w"), 2, SPEC).collect(), twin(good, SPEC))
    empty = cf.merged(cf.cell_features(df.where("false"), "key", "x", "at", 2, SPEC, "w"), 2, SPEC)
    assert empty.collect() == []
    assert cf.cluster_labels(empty, 1.0, 2).collect() == []
    with pytest.raises(ValueError):
        cf.Cells(side=0)


def test_labels_of_separate_groups(spark):
    rng = np.random.default_rng(1)
    data = [(i, "k", [float(v) for v in (0 if i % 2 else 40) + rng.normal(0, 1, 2)], START, 1.0) for i in range(100)] + [(100, "k", [200.0, 0.0], START, 1.0), (101, None, [0.0, 0.0], START, 1.0)]
    df = spark.createDataFrame(data, SCHEMA)
    clusters = cf.merged(cf.cell_features(df, "key", "x", "at", 2, SPEC, "w"), 2, SPEC)
    labels = cf.cluster_labels(clusters, eps=6.0, min_samples=5)
    found = {r["id"]: r["label"] for r in cf.sample_labels(df, "id", "key", "x", labels, SPEC).collect()}
    assert len(found) == 102 and found[100] == -1 and found[101] == -1
    dense = {(r["key"], tuple(r["cell"])) for r in clusters.where("kind = 'potential'").collect()}
    for side in (0, 1):
        inside = {found[i] for i in range(side, 100, 2) if ("k", tuple(int(np.floor(v / 2)) for v in data[i][2])) in dense}
        assert len(inside) == 1 and inside != {-1}
    assert found[0] != found[1] or -1 in (found[0], found[1])
    assert cf.sample_labels(df, "id", "key", "x", labels.where(F.lit(False)), SPEC).where("label <> -1").isEmpty()
