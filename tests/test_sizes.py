"""Steps of few rows are few files, whatever the number of shuffle partitions; a distance given as a function stays in the cache."""

import pathlib

import numpy as np
import pytest

from topicloom import session
from topicloom.catalog.similarity import fractional
from topicloom.llm import jaccard
from topicloom.operators.graph import components

HELD = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def wide(spark, tmp_path, monkeypatch):
    """A session of many shuffle partitions, and the folder of its steps."""
    monkeypatch.setattr(session, "shared_dir", lambda s: str(tmp_path))
    before = {k: spark.conf.get(k) for k in HELD}
    for k, v in HELD.items():
        spark.conf.set(k, v)
    yield spark, tmp_path
    for k, v in before.items():
        spark.conf.set(k, v)


def most_files(folder: pathlib.Path) -> dict[str, int]:
    """By name of a step, the files of the largest."""
    found: dict[str, int] = {}
    for step in folder.iterdir():
        name = step.name[:-33]
        found[name] = max(found.get(name, 0), len(list(step.glob("*.parquet"))))
    return found


def test_components_of_few_edges_write_few_files(wide):
    spark, folder = wide
    chain = [(i, i + 1) for i in range(1, 200) if i % 50]
    edges = spark.createDataFrame(chain, "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 202)], "n long")
    got = {r["n"]: r["component"] for r in components(edges, nodes, "n", rows=len(chain)).collect()}
    assert got == {i: i if i == 201 else (i - 1) // 50 * 50 + 1 for i in range(1, 202)}
    files = most_files(folder)
    assert set(files) == {"edges", "paths"}
    assert max(files.values()) <= spark.sparkContext.defaultParallelism


def test_jaccard_steps_of_few_rows_write_few_files(wide):
    spark, folder = wide
    texts = [" ".join(f"w{g}x{i}" for i in range(60)) + f" end{k}" for g in range(20) for k in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs).collect()}
    assert got == {i: i // 6 * 6 for i in range(len(texts))}
    assert {r["doc_id"] for r in jaccard.one_of_each(docs).collect()} == set(range(0, len(texts), 6))
    files = most_files(folder)
    small = {"classes", "nodes", "groups", "links", "wanted", "texts", "edges", "paths", "stays"}
    assert small <= set(files)
    assert max(files[name] for name in small) <= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("rows", [(0, 3), (1, 1), (7, 40_000), (300, 129)])
def test_fractional_is_the_same_number_in_strips(rows, monkeypatch):
    rng = np.random.default_rng(3)
    a, b = (np.round(rng.normal(size=(n, 9)), 1) for n in rows)
    total = np.zeros(rows)
    for x, y in zip(a.T, b.T, strict=True):
        total = total + abs(x[:, None] - y[None, :]) ** 0.5
    largest = [0]
    subtract = np.subtract

    def watched(x, y, out):
        largest[0] = max(largest[0], out.size)
        return subtract(x, y, out=out)

    monkeypatch.setattr(np, "subtract", watched)
    assert np.array_equal(fractional(a, b), total**2)
    if len(a):
        assert 0 < largest[0] <= max(1 << 14, len(b))
