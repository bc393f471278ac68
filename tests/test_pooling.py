"""Pooled and SIF vectors against plain loops: words without or with several vectors, nulls, repeated ids, many blocks."""

import random

import pytest
from pyspark.sql import functions as F

from topicloom.operators import features as ft

DIM = 3


def corpus():
    pick = random.Random(4)
    words = [f"w{i}" for i in range(30)] + ["\x1e", "a\x1fb", "", "no vector"]
    texts = [(pick.choice([None, *range(12)]), [pick.choice([*words, None]) for _ in range(pick.randint(0, 25))]) for _ in range(80)] + [(99, None), (98, [None])]
    vectors = [(w, [float(pick.randint(-9, 9)) for _ in range(DIM)]) for w in words[:-1]] + [("w3", [1.0, 2.0, None]), ("w4", None), (None, [5.0] * DIM), ("w29", [None] * DIM)]
    return texts, vectors


def expected(lines, vectors, how):
    """``lines``: (uid, word, weight, count)."""
    out = {}
    for uid, word, weight, n in lines:
        for w, v in vectors:
            if w is not None and w == word:
                got = out.setdefault(uid, ([[] for _ in range(DIM)], []))
                got[1].append(n)
                for d in range(DIM):
                    if v is not None and v[d] is not None:
                        got[0][d].append(v[d] if how == "max" else weight * v[d])
    fold = (lambda x, n: max(x)) if how == "max" else (lambda x, n: sum(x) / n)
    return {u: [fold(x, sum(n)) if x else None for x in sums] for u, (sums, n) in out.items()}


def same(found, want):
    assert found.keys() == want.keys()
    for u, v in want.items():
        assert [x is None for x in found[u]] == [x is None for x in v]
        assert [x for x in found[u] if x is not None] == pytest.approx([x for x in v if x is not None])


@pytest.mark.parametrize("how", ["mean", "max"])
@pytest.mark.parametrize("block", [1 << 13, 16])
def test_pooled_by_blocks(spark, monkeypatch, how, block):
    monkeypatch.setattr(ft, "BLOCK_TEXTS", block)
    monkeypatch.setattr(ft, "TEXTS_AT_ONCE", 5)
    monkeypatch.setattr(ft, "LINES_AT_ONCE", 7)
    texts, vectors = corpus()
    df = spark.createDataFrame(texts, "id long, t array<string>").repartition(3)
    words = spark.createDataFrame(vectors, "word string, vector array<float>")
    found = {r["id"]: r["embedding"] for r in ft.pool_tokens(df, "id", F.col("t"), words, DIM, how).collect()}
    same(found, expected([(u, w, 1, 1) for u, t in texts for w in t or []], vectors, how))


@pytest.mark.parametrize("lines", [1 << 21, 20])
def test_sif_by_blocks(spark, monkeypatch, lines):
    monkeypatch.setattr(ft, "BLOCK_LINES", lines)
    texts, vectors = corpus()
    counts = {}
    for i, (u, t) in enumerate(texts):
        for w in t or []:
            counts[u, i % 2, w] = counts.get((u, i % 2, w), 0) + 1
    df = spark.createDataFrame([(*k, n) for k, n in counts.items()], "id long, side int, term string, n long").repartition(3)
    words = spark.createDataFrame(vectors, "word string, vector array<float>")
    found = {(r["id"], r["side"]): r["sif"] for r in ft.sif_vectors(df, ["id", "side"], words, DIM, 0.5).collect()}
    same(found, expected([((u, s), w, n * 0.5 / (0.5 + n), n) for (u, s, w), n in counts.items()], vectors, "mean"))


def test_vectors_are_not_shuffled_for_every_word_of_a_text(spark):
    texts = spark.createDataFrame([(i, [f"w{(i + j) % 50}" for j in range(40)]) for i in range(400)], "id long, t array<string>")
    words = spark.createDataFrame([(f"w{i}", [float(i), 1.0]) for i in range(50)], "word string, vector array<float>")
    plan = ft.pool_tokens(texts, "id", F.col("t"), words, 2)._jdf.queryExecution().optimizedPlan().toString()
    cogroup = plan[plan.index("FlatMapCoGroupsInArrow"):]
    assert "Join" in cogroup and "Join" not in plan[:plan.index("FlatMapCoGroupsInArrow")]
