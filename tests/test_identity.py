"""Names of clusters over batches, against a plain greedy matching."""

import collections

import numpy as np

from topicloom.operators import identity as idn


def greedy(labels, percent):
    """{(frame, label): identity} by taking one pair after the other."""
    frame_of = {b: i + 1 for i, b in enumerate(sorted({b for b, _, _ in labels}))}
    at = collections.defaultdict(dict)
    for b, uid, label in labels:
        if uid is not None and label != -1:
            at[frame_of[b]][uid] = min(label, at[frame_of[b]].get(uid, label))
    sizes = {f: collections.Counter(rows.values()) for f, rows in at.items()}
    names = {}
    for f in sorted(at):
        shared = collections.Counter((at[f - 1][u], label) for u, label in at[f].items() if u in at.get(f - 1, {}))
        pairs = sorted((-n, sizes[f - 1][x] + sizes[f][y], x, y) for (x, y), n in shared.items() if 100 * n >= percent * sizes[f - 1][x])
        used_x, used_y = set(), set()
        for _, _, x, y in pairs:
            if x not in used_x and y not in used_y:
                used_x.add(x)
                used_y.add(y)
                names[f, y] = names[f - 1, x]
        for y in sizes[f]:
            names.setdefault((f, y), f"{f}:{y}")
    return names


def test_identities_by_brute_force(spark):
    rng = np.random.default_rng(3)
    # ids that come and go, batch numbers with gaps, noise, ties between small clusters, repeated rows and null ids
    labels = [(b, int(u), int(rng.integers(-1, 9)) if rng.random() < 0.3 else int(u) % 9) for b in (2, 3, 7, 9, 20) for u in rng.integers(0, 120, 100)]
    labels += [(b, None, 4) for b in (2, 3, 7)] + labels[:20]
    df = spark.createDataFrame(labels, "batch_id int, uid long, label int")
    for percent in (0, 30, 60):
        want = greedy(labels, percent)
        got = idn.identities(df, "uid", percent=percent).collect()
        assert {(r["frame"], r["label"]): r["identity"] for r in got} == want and len(got) == len(want)
        assert all((r["before"] is None) == (r["identity"] == f"{r['frame']}:{r['label']}") for r in got)
    rows = idn.identity_frames(df, "uid").collect()
    assert len(rows) == len(labels) and all((r["identity"] is None) == (r["label"] == -1) for r in rows)


def test_split_merge_and_gap(spark):
    first = [(0, u, 5) for u in range(10)] + [(0, u, 6) for u in range(10, 14)]
    split = [(1, u, 0 if u < 7 else 1) for u in range(10)] + [(1, u, 2) for u in range(10, 14)]
    merged = [(2, u, 9) for u in range(10)] + [(2, u, -1) for u in range(10, 14)]
    back = [(3, u, 3) for u in range(14)]
    df = spark.createDataFrame(first + split + merged + back, "batch_id int, uid long, label int")
    got = {(r["frame"], r["label"]): r["identity"] for r in idn.identities(df, "uid").collect()}
    assert got == {(1, 5): "1:5", (1, 6): "1:6", (2, 0): "1:5", (2, 1): "2:1", (2, 2): "1:6", (3, 9): "1:5", (4, 3): "1:5"}
    assert idn.identities(df.limit(0), "uid").collect() == []


def test_only_counts_are_joined(spark):
    df = spark.range(5000).selectExpr("id % 2500 AS uid", "CAST(id DIV 2500 AS int) AS batch_id", "CAST(id % 5 AS int) AS label")
    rows = idn.followed(idn.frames(df), "uid", "label")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(uid") == 1
    sizes, pairs = idn.overlaps(rows, 30)
    assert sizes.count() == 10 and pairs.count() == 5
