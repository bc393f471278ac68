"""Entities, sources, joins, topics, metrics, pipe."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.functions import entities as en
from topicloom.functions import vectors as vx
from topicloom.operators import features as ft
from topicloom.operators import metrics as mt
from topicloom.operators import relational as rel
from topicloom.operators import topics as tp
from topicloom.operators.ranking import next_in_group, rank_in_group, top_in_group
from topicloom.plans import jobs
from topicloom.plans.pipe import Pipe
from topicloom.plans.plots import points, tree_edges
from topicloom.sources import tables as src


def test_entities(spark):
    j = '[{"entities":[{"name":"Rom","type":"LOCATION"},{"name":"BILD-Zeitung","type":"X"},{"name":"Anna","type":"PERSON"},{"name":"Rom","type":"LOCATION"}]}]'
    rows = spark.createDataFrame([(1, j), (2, None), (3, "kaputt"), (4, "[]"), (5, '[{"entities":[]}]')], "i int, j string")
    one = {r["i"]: [tuple(e) for e in r["e"]] for r in rows.select("i", en.parse_entities(F.col("j")).alias("e")).collect()}
    assert one == {1: [("Anna", "PERSON"), ("Rom", "LOCATION")], 2: [], 3: [], 4: [], 5: []}
    every = rows.where("i = 1").select(en.parse_entities(F.col("j"), deduplicate=False)).first()[0]
    assert [e["text"] for e in every] == ["Rom", "Anna", "Rom"]


def test_day_first_dates(spark):
    values = ["31.10.2020 12:30", "01/02/2020", "2020-03-04", "quatsch"]
    rows = spark.createDataFrame([(v,) for v in values], "t string")
    got = [r[0] and str(r[0]) for r in rows.select(src.day_first(F.col("t"))).collect()]
    assert got == ["2020-10-31 12:30:00", "2020-02-01 00:00:00", "2020-03-04 00:00:00", None]


def test_missing_file(spark, tmp_path, capsys):
    assert src.load_articles_if_present(spark, str(tmp_path / "none.csv")) is None
    assert "Could not find" in capsys.readouterr().out


def test_csv_with_line_breaks(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('article_uid,headline,text,created_at\n1,"A ""q""","x\ny",2.1.2020\n', encoding="utf-8")
    row = src.load_articles(spark, str(path), "article_uid string, headline string, text string, created_at string").first()
    assert (row["headline"], row["text"], str(row["created_at"])) == ('A "q"', "x\ny", "2020-01-02 00:00:00")


def test_ids_argument(spark):
    df = spark.range(5).withColumnRenamed("id", "article_uid")
    assert rel.with_ids(df, None).count() == 5 and rel.with_ids(df, [1, 9]).count() == 1
    assert rel.with_ids(df, df.where("article_uid < 2")).count() == 2
    with pytest.raises(TypeError):
        rel.with_ids(df, "1")
    assert rel.newest(df.withColumn("created_at", F.col("article_uid")), None).count() == 5


@pytest.mark.parametrize("parts", [1, 7])
def test_ranks_do_not_depend_on_partitions(spark, parts):
    rows = [("a" if i % 3 else "b", (i * 37) % 101, i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(parts)
    order = [F.col("v").desc(), F.col("i")]
    got = {r["i"]: r["rank"] for r in rank_in_group(df, ["g"], order).collect()}
    nxt = {r["i"]: r["n"] for r in next_in_group(df, ["g"], order, F.col("i"), "n").collect()}
    for g in "ab":
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in mine] == list(range(1, len(mine) + 1))
        assert [nxt[r[2]] for r in mine] == [r[2] for r in mine[1:]] + [None]


def test_top_in_group_limits_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "id AS v")
    plan = top_in_group(df, ["g"], [F.col("v").desc()], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


TOPICS = [(1, "a", "x x y"), (2, "a", "y z"), (3, "b", "x w"), (4, "b", "x x x")]


def test_c_tf_idf_by_hand(spark):
    df = spark.createDataFrame(TOPICS, "uid int, topic string, text string")
    got = {(r["topic"], r["term"]): r["score"] for r in tp.c_tf_idf(df, "topic", F.split("text", " "), 4).collect()}
    want = {("a", "x"): 2 / 5 * math.log(4 / 6), ("a", "y"): 2 / 5 * math.log(4 / 2), ("a", "z"): 1 / 5 * math.log(4),
            ("b", "x"): 4 / 5 * math.log(4 / 6), ("b", "w"): 1 / 5 * math.log(4)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    top = tp.top_terms(tp.c_tf_idf(df, "topic", F.split("text", " "), 4), "topic", 2)
    assert {r["topic"]: r["label"] for r in tp.topic_label(top, "topic", 2).collect()} == {"a": "y | z", "b": "w | x"}


def test_topic_documents_parts(spark):
    df = spark.createDataFrame([(i, "t", f"w{i}", f"h{i}") for i in range(5)], "uid int, topic string, text string, headline string")
    rows = tp.topic_documents(df, "topic", "uid", rows_per_part=2).orderBy("part").collect()
    assert [r["doc"] for r in rows] == ["w0 w1", "w2 w3", "w4"] and rows[0]["headlines"] == "h0. h1"


def scores_twin(truth, pred):
    def h(counts):
        n = sum(counts)
        return -sum(c / n * math.log(c / n) for c in counts)

    def count(xs):
        return list({x: xs.count(x) for x in set(xs)}.values())

    ht, hp, hj = h(count(truth)), h(count(pred)), h(count(list(zip(truth, pred))))
    mi = ht + hp - hj
    hom, com = (1.0 if ht < 1e-12 else mi / ht), (1.0 if hp < 1e-12 else mi / hp)
    return hom, com, (0.0 if hom + com < 1e-12 else 2 * hom * com / (hom + com))


LABELINGS = [([0, 0, 1, 1], [0, 0, 1, 1]), ([0, 0, 1, 1], [5, 5, 3, 3]), ([0, 0, 1, 1], [0, 0, 0, 0]), ([0, 0, 1, 1], [0, 1, 2, 3]),
             ([0, 0, 0, 0], [0, 1, 1, 1]), ([0, 0, 1, 1, 2, 2], [-1, 0, 0, 1, 1, -1])]


@pytest.mark.parametrize("truth,pred", LABELINGS)
def test_agreement(spark, truth, pred):
    df = spark.createDataFrame(list(zip(truth, pred)), "t int, p int")
    got = mt.agreement(df, "t", "p").first()
    assert np.allclose(list(got), scores_twin(truth, pred), atol=1e-9)
    back = mt.agreement(df, "p", "t").first()
    assert abs(got["homogeneity"] - back["completeness"]) < 1e-9 and abs(got["v_measure"] - back["v_measure"]) < 1e-9


def test_shape_without_outliers(spark):
    got = mt.cluster_shape(spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "t int, p int"), "t", "p").first()
    assert tuple(got) == (0.0, 2, 0.5)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(vx.normalize(F.col("v"))).collect()] == [[0.6, 0.8], None]
    const = ft.standardize(spark.createDataFrame([([1.0, 2.0],), ([1.0, 4.0],)], "v array<double>"), "v", 2)
    assert [r[0] for r in const.collect()] == [[0.0, -1.0], [0.0, 1.0]]


def test_pca_equals_numpy(spark):
    x = np.random.default_rng(1).normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.1]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, v array<double>")
    got = np.array([r[0] for r in ft.reduce_pca(df, "v", ft.fit_pca(df, "v", 2)).orderBy("i").select("reduced").collect()])
    c = x - x.mean(0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    axes = np.array([a * np.sign(a[np.abs(a).argmax()]) for a in vt[:2]])
    assert np.allclose(got, c @ axes.T, atol=1e-8)


def test_word_vectors_and_lda_run(spark):
    docs = spark.createDataFrame([(["a", "b", "c"] * 4,), (["a", "c", "d"] * 4,)], "tokens array<string>")
    assert ft.word_vectors(docs, "tokens", dim=4, min_count=1, epochs=1).count() == 4
    got = ft.topic_model(docs, "tokens", k=2, passes=2, terms=2, min_df=1).collect()
    assert len(got) == 4 and all(r["term"] in "abcd" for r in got)


def test_pipe_is_immutable_and_splits(spark):
    x = spark.createDataFrame([(1, "Hallo Welt"), (2, "ganz anders hier")], "article_uid long, text string")
    y = spark.createDataFrame([(7, "Welt hallo"), (8, "noch etwas neues")], "article_uid long, text string")
    first = Pipe(x, y)
    done = first.clean().embed("text", 64).keep("note", 1)
    assert first.kept == {} and done.kept["note"] == 1 and done.last == "embed" and "embedding" not in first.x.columns
    near = {r["article_uid"]: (r["neighbor"], round(r["distance"], 6)) for r in done.nearest(1).value().collect()}
    assert near[1] == (7, 0.0)
    with pytest.raises(ValueError):
        done.nearest_to_clusters(2)


def test_pipe_recalls_what_it_stored(spark):
    x = spark.createDataFrame([(1, "a"), (2, "b")], "article_uid int, text string")
    y = spark.createDataFrame([(7, "c"), (8, None)], "article_uid int, text string")
    pipe = Pipe(x, y).store("before", "text").together(lambda d: d.withColumn("text", F.upper("text")))
    found = Pipe(spark.createDataFrame([(1, 7), (2, 8), (3, 9)], "article_uid int, neighbor int"), None, pipe.kept)
    rows = found.recall("before").recall("before", "neighbor", "y", "near_").value().orderBy("article_uid").collect()
    assert [tuple(r) for r in rows] == [(1, 7, "a", "c"), (2, 8, "b", None), (3, 9, None, None)]
    with pytest.raises(ValueError):
        found.recall("other")
    with pytest.raises(ValueError):
        Pipe(x).store("one", "text").recall("one", side="y")


def test_score_of_reduced_clusters(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (25, 4)) for c in (0, 6)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    rows, score = jobs.reduce_cluster_score(df, "id", "v", 2, 2, min_cluster_size=10, min_samples=3)
    kept = rows.orderBy("id").collect()
    z, label = np.array([r["reduced"] for r in kept]), np.array([r["label"] for r in kept])
    d = ((z[:, None] - z[None]) ** 2).sum(2)
    wanted = []
    for i in range(len(z)):
        own = label == label[i]
        if own.sum() == 1:
            wanted.append(0.0)
            continue
        a, b = d[i, own].sum() / (own.sum() - 1), min(d[i, label == c].mean() for c in set(label) - {label[i]})
        wanted.append((b - a) / max(a, b))
    r = score.first()
    assert (r["rows"], r["clusters"], r["outliers"]) == (50, len(set(label) - {-1}), int((label < 0).sum())) and r["clusters"] >= 2
    assert r["silhouette"] == pytest.approx(np.mean(wanted))


def test_plot_tables(spark):
    linked = spark.createDataFrame([(1, 0.0, 3, "2020-01-02"), (2, 0.5, -1, "2020-01-01")], "article_uid int, x double, topic_number int, created_at string")
    got = {r["article_uid"]: (r["labels"], r["frame"]) for r in points(linked, "topic_number").collect()}
    assert got == {1: ("3", 2), 2: ("-1", 1)}
    tree = spark.createDataFrame([("r", "a", 1.0, 4), ("r", "p1", 1.0, 1)], "parent string, child string, lambda_val double, child_size long")
    assert [tuple(r) for r in tree_edges(tree).collect()] == [("a", "r", 4)]


def test_entry_survives_a_missing_package(monkeypatch):
    """Without what the training-data operators need, all other queries are still there."""
    import sys

    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("topicloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "topicloom.llm", None)  # importing it is an ImportError
    found = entry.queries()
    assert "pairs_above_score" in found and "op1_url_markov" not in found and "pipeline" not in found
    assert set(entry.oracle_sql()) <= set(found)
