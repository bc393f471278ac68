"""Summaries, clusterings, streams and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.catalog.base import articles, in_list, query, rules_sql, table
from topicloom.catalog.similarity import RAW, raw, unit
from topicloom.catalog.text import SENTENCES_SQL
from topicloom.functions import stopwords as sw
from topicloom.functions import text as tx
from topicloom.operators import density as dn
from topicloom.operators import features as ft
from topicloom.operators import graph as gr
from topicloom.operators import identity as idn
from topicloom.operators import summaries as sm
from topicloom.operators import wordspace as ws
from topicloom.plans import jobs
from topicloom.plans.pipe import Pipe
from topicloom.plans.plots import tree_edges
from topicloom.session import materialize, work_path
from topicloom.sources import tables as src
from topicloom.streaming import clusterfeatures as cf
from topicloom.streaming import incremental as inc
from topicloom.streaming import microclusters as mc

STOP = sw.default_stopwords()


@query("central_sentences", f"""
WITH s AS (SELECT doc_id, source AS topic, CAST(pos - 1 AS INTEGER) AS pos, sentence FROM (
    SELECT doc_id, source, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS pos FROM (SELECT doc_id, source, {SENTENCES_SQL} AS parts FROM documents))),
  n AS (SELECT topic, doc_id, pos, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % 64 AS dim, count(*) AS n
    FROM (SELECT topic, doc_id, pos, unnest(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM s) GROUP BY ALL),
  l AS (SELECT doc_id, pos, sqrt(sum(n * n)) AS len FROM n GROUP BY doc_id, pos),
  v AS (SELECT topic, doc_id, pos, dim, n / len AS v FROM n JOIN l USING (doc_id, pos)),
  t AS (SELECT topic, dim, sum(v) AS t FROM v GROUP BY topic, dim),
  a AS (SELECT topic, sum(t * t) AS total FROM t GROUP BY topic),
  c AS (SELECT topic, count(*) AS cnt FROM (SELECT DISTINCT topic, doc_id, pos FROM v) GROUP BY topic),
  d AS (SELECT topic, doc_id, pos, sum(v * t) AS deg FROM v JOIN t USING (topic, dim) GROUP BY topic, doc_id, pos),
  r AS (SELECT topic, doc_id, pos, round(deg * cnt / total, 9) AS centrality FROM d JOIN a USING (topic) JOIN c USING (topic)),
  k AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY centrality DESC, doc_id, pos) AS rank FROM r)
SELECT k.topic, s.sentence, k.doc_id, k.pos, centrality, CAST(rank AS INTEGER) AS rank FROM k JOIN s USING (doc_id, pos) WHERE rank <= 2""")
def central_sentences(spark, sf):
    """The two most central sentences of each source."""
    parts = table(spark, sf, "documents", "doc_id", "source", "text").select(
        F.col("source").alias("topic"), "doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))
    rows = parts.withColumn("v", ft.hashed_embedding(tx.words(F.col("sentence")), 64)).where(F.col("v").isNotNull())
    return sm.central_sentence(rows, "topic", "sentence", "v", 64, ["doc_id", "pos"], 2, outlier="-1")


def _rank_sql(rounds: int) -> str:
    steps = "".join(f""",
  s{i + 1} AS MATERIALIZED (SELECT n.topic, n.node, 0.15 / n.cnt + 0.85 * coalesce(sum(l.p * s.score), 0) AS score
    FROM nodes n JOIN links l ON l.topic = n.topic AND l.dst = n.node JOIN s{i} s ON s.topic = l.topic AND s.node = l.src GROUP BY n.topic, n.node, n.cnt)"""
                    for i in range(rounds))
    return rf"""
WITH w AS (SELECT source AS topic, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda t: t NOT IN ({in_list(STOP)})) AS w FROM documents),
  p AS (SELECT topic, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: [least(w[i], w[i+1]), greatest(w[i], w[i+1])])) AS p FROM w WHERE len(w) >= 2),
  e AS (SELECT topic, p[1] AS a, p[2] AS b, count(*) AS n FROM p WHERE p[1] <> p[2] GROUP BY ALL),
  both_ AS (SELECT topic, a AS src, b AS dst, n FROM e UNION ALL SELECT topic, b, a, n FROM e),
  o AS (SELECT topic, src, sum(n) AS total FROM both_ GROUP BY topic, src),
  links AS MATERIALIZED (SELECT topic, src, dst, n / total AS p FROM both_ JOIN o USING (topic, src)),
  nodes AS MATERIALIZED (SELECT topic, src AS node, count(*) OVER (PARTITION BY topic) AS cnt FROM o),
  s0 AS (SELECT topic, node, 1 / cnt AS score FROM nodes){steps},
  r AS (SELECT topic, node AS term, round(score, 12) AS score, row_number() OVER (PARTITION BY topic ORDER BY round(score, 12) DESC, node) AS rank, count(*) OVER (PARTITION BY topic) AS cnt FROM s{rounds})
SELECT topic, term, CAST(rank AS BIGINT) AS rank, round(score, 9) AS score FROM r WHERE rank <= greatest(floor(cnt * 0.01), 1)"""


@query("topic_keywords", _rank_sql(10))
def topic_keywords(spark, sf):
    """Best 1 % of the terms of each source by graph rank."""
    docs = table(spark, sf, "documents", "source", "text").withColumnRenamed("source", "topic")
    out = sm.keywords(docs, "topic", sw.drop_stopwords(tx.words(F.col("text")), STOP))
    return out.select("topic", "term", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


@query("core_distances", f"""WITH {RAW}, d AS (SELECT a.vec_id, list_distance(a.e, b.e) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS rk
  FROM u a, u b WHERE a.vec_id <> b.vec_id) SELECT vec_id, round(d, 6) AS core FROM d WHERE rk = 3""")
def core_distances(spark, sf):
    return dn.core_distances(raw(spark, sf), "vec_id", "embedding", 3).withColumn("core", F.round("core", 6))


def _spanning_tree_sql(rounds: int) -> str:
    """Boruvka rounds unrolled over all pairs; joined components are found by recursion over the picked edges."""
    steps = "".join(f""",
  o{i} AS MATERIALIZED (SELECT x.c AS ca, y.c AS cb, min(struct_pack(w := w, lo := lo, hi := hi)) AS e FROM w JOIN c{i} x ON x.id = lo JOIN c{i} y ON y.id = hi WHERE x.c <> y.c GROUP BY x.c, y.c),
  p{i} AS MATERIALIZED (SELECT c, min(e) AS e FROM (SELECT ca AS c, e FROM o{i} UNION ALL SELECT cb, e FROM o{i}) GROUP BY c),
  l{i} AS MATERIALIZED (SELECT x.c AS a, y.c AS b FROM (SELECT DISTINCT e FROM p{i}) JOIN c{i} x ON x.id = e.lo JOIN c{i} y ON y.id = e.hi),
  n{i} AS MATERIALIZED (SELECT a, b FROM l{i} UNION SELECT b, a FROM l{i}),
  r{i} AS (SELECT DISTINCT c AS a, c AS b FROM c{i} UNION SELECT r{i}.a, n{i}.b FROM r{i} JOIN n{i} ON n{i}.a = r{i}.b),
  m{i} AS MATERIALIZED (SELECT a, min(b) AS low FROM r{i} GROUP BY a),
  c{i + 1} AS MATERIALIZED (SELECT id, low AS c FROM c{i} JOIN m{i} ON a = c)""" for i in range(rounds))
    picked = " UNION ".join(f"SELECT e FROM p{i}" for i in range(rounds))
    return f"""WITH RECURSIVE {RAW}, d AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.e, b.e) AS d FROM u a, u b WHERE a.vec_id <> b.vec_id),
  k AS MATERIALIZED (SELECT a AS id, d AS core FROM (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rk FROM d) WHERE rk = 3),
  w AS MATERIALIZED (SELECT greatest(x.core, y.core, d) AS w, a AS lo, b AS hi FROM d JOIN k x ON x.id = a JOIN k y ON y.id = b WHERE a < b),
  c0 AS MATERIALIZED (SELECT vec_id AS id, vec_id AS c FROM u){steps}
SELECT e.lo AS lo, e.hi AS hi, round(e.w, 6) AS w FROM ({picked})"""


@query("spanning_tree", _spanning_tree_sql(9))
def spanning_tree(spark, sf):
    """Minimum spanning tree of the mutual reachability distances."""
    return dn.build_tree(raw(spark, sf), "vec_id", "embedding", 3).edges.withColumn("w", F.round("w", 6))


# Nearest neighbors of the test embeddings are about 1.1 apart, so this radius makes some of them core.
EPS = 1.15


def _dbscan_sql(weight: str, least: float) -> str:
    return f"""WITH RECURSIVE {RAW}, n AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, {weight} AS w FROM u a, u b WHERE list_distance(a.e, b.e) <= {EPS}),
  c AS MATERIALIZED (SELECT a AS id FROM n GROUP BY a HAVING sum(w) >= {least}),
  r AS (SELECT id, id AS low FROM c UNION SELECT n.b, r.low FROM r JOIN n ON n.a = r.id WHERE n.b IN (SELECT id FROM c)),
  comp AS (SELECT id, min(low) AS comp FROM r GROUP BY id), num AS (SELECT comp, dense_rank() OVER (ORDER BY comp) - 1 AS label FROM (SELECT DISTINCT comp FROM comp)),
  adopted AS (SELECT n.a AS id, min(comp) AS comp FROM n JOIN comp ON comp.id = n.b WHERE n.a NOT IN (SELECT id FROM c) GROUP BY n.a),
  every AS (SELECT id, comp, true AS core FROM comp UNION ALL SELECT id, comp, false FROM adopted)
SELECT vec_id, CAST(coalesce(num.label, -1) AS INTEGER) AS label, coalesce(core, false) AS core FROM u LEFT JOIN every ON id = vec_id LEFT JOIN num USING (comp)"""


@query("dbscan_clusters", _dbscan_sql("1", 5))
def dbscan_clusters(spark, sf):
    return dn.dbscan(raw(spark, sf), "vec_id", "embedding", EPS, 5)


@query("weighted_dbscan_clusters", _dbscan_sql("1 + b.label / 4", 9))
def weighted_dbscan_clusters(spark, sf):
    weighted = raw(spark, sf).withColumn("weight", 1 + F.col("label") / 4)
    return dn.dbscan(weighted, "vec_id", "embedding", EPS, 9, "weight")


@query("density_clusters")
def density_clusters(spark, sf):
    return dn.cluster(raw(spark, sf), "vec_id", "embedding")


@query("density_clusters_leaf")
def density_clusters_leaf(spark, sf):
    return dn.cluster(raw(spark, sf), "vec_id", "embedding", **dn.LEAF_DEFAULTS)


@query("density_clusters_normalized")
def density_clusters_normalized(spark, sf):
    return dn.cluster(unit(spark, sf), "vec_id", "embedding", alpha=0.5, allow_single_cluster=False)


@query("density_clusters_graph")
def density_clusters_graph(spark, sf):
    """Density clusters over the neighbor graph by descent."""
    return dn.cluster_graph(raw(spark, sf), "vec_id", "embedding", neighbors=30, descent={"sample": 15}, **dn.LEAF_DEFAULTS)


@query("daily_clusters")
def daily_clusters(spark, sf):
    """Every day clustered on its own, all days in one job."""
    days = raw(spark, sf).withColumn("day", (F.col("vec_id") % 13).cast("int"))
    return dn.cluster(days, "vec_id", "embedding", ["day"], **dn.LEAF_DEFAULTS)


@query("hierarchy_members")
def hierarchy_members(spark, sf):
    tree = dn.condense(dn.build_tree(raw(spark, sf), "vec_id", "embedding", 3), [{"min_cluster_size": 3}])
    return dn.cluster_members(tree).select("c", F.col("rep").alias("vec_id"))


_TRADE = """n AS (SELECT 'w' AS node, CAST(NULL AS VARCHAR) AS parent, 'w' AS path, 0 AS depth
    UNION ALL SELECT 'r' || r_regionkey, 'w', 'w/r' || r_regionkey, 1 FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'w/r' || n_regionkey || '/n' || n_nationkey, 2 FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'w/r' || n_regionkey || '/n' || n_nationkey || '/c' || c_custkey, 3 FROM customer JOIN nation ON n_nationkey = c_nationkey),
  o AS (SELECT *, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS pre, count(*) OVER () AS total FROM n),
  z AS (SELECT a.node, count(*) AS size FROM n a JOIN n b ON b.path = a.path OR starts_with(b.path, a.path || '/') GROUP BY a.node)"""


def trade_tree(spark, sf):
    """World, regions, nations and customers as (node, parent)."""
    name = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    world = spark.range(1).select(F.lit("w").alias("node"), F.lit(None).cast("string").alias("parent"))
    regions = table(spark, sf, "region").select(name("r", "r_regionkey").alias("node"), F.lit("w").alias("parent"))
    nations = table(spark, sf, "nation").select(name("n", "n_nationkey").alias("node"), name("r", "n_regionkey").alias("parent"))
    customers = table(spark, sf, "customer").select(name("c", "c_custkey").alias("node"), name("n", "c_nationkey").alias("parent"))
    return world.unionByName(regions).unionByName(nations).unionByName(customers)


@query("tree_intervals", f"""WITH {_TRADE} SELECT node, 'w' AS root, CAST(2 * total - 2 * pre + depth - 2 * size AS BIGINT) AS low, CAST(2 * total - 1 - 2 * pre + depth AS BIGINT) AS high
FROM o JOIN z USING (node)""")
def tree_intervals(spark, sf):
    """Nested intervals of a tree by list ranking."""
    return gr.tour(trade_tree(spark, sf), [], "node", "parent")


@query("tree_members", f"""WITH {_TRADE} SELECT a.node AS ancestor, b.node FROM n a JOIN n b ON b.path = a.path OR starts_with(b.path, a.path || '/')""")
def tree_members(spark, sf):
    """Every node of the tree with each of its ancestors, from a range join over the intervals."""
    return gr.ancestor_pairs(trade_tree(spark, sf), [], "node", "parent")


@query("plot_tree")
def plot_tree(spark, sf):
    tree = dn.condense(dn.build_tree(raw(spark, sf), "vec_id", "embedding", 3), [{"min_cluster_size": 3}])
    return tree_edges(dn.condensed_rows(tree))


@query("reduced_clusters")
def reduced_clusters(spark, sf):
    """Plot coordinates, reduction and clusters as one job."""
    out = jobs.reduce_and_cluster(raw(spark, sf), "vec_id", "embedding", 3, 16, **{**dn.LEAF_DEFAULTS, "cluster_selection_epsilon": 1.0})
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in "xyz"], "label")


@query("reused_reducers")
def reused_reducers(spark, sf):
    """Fitted reducers stored, loaded and applied before clustering."""
    base, path = raw(spark, sf), work_path(spark, "reducer")
    for name, k in (("plot", 2), ("small", 16)):
        ft.save_reducer(ft.fit_pca(base, "embedding", k), f"{path}/{name}")
    loaded = (ft.load_reducer(f"{path}/plot"), ft.load_reducer(f"{path}/small"))
    out = jobs.reduce_and_cluster(base, "vec_id", "embedding", 2, reducers=loaded, **dn.LEAF_DEFAULTS)
    return out.select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "label")


@query("reduced_silhouette")
def reduced_silhouette(spark, sf):
    """Reduce, cluster, and score the clusters in the reduced space."""
    _, score = jobs.reduce_cluster_score(raw(spark, sf), "vec_id", "embedding", 2, 16, **dn.LEAF_DEFAULTS)
    return score.withColumn("silhouette", F.round("silhouette", 6))


@query("pca_coordinates")
def pca_coordinates(spark, sf):
    base = raw(spark, sf)
    out = ft.reduce_pca(base, "embedding", ft.fit_pca(base, "embedding", 3))
    return out.select("vec_id", *[F.round(F.get("reduced", F.lit(i)), 6).alias(n) for i, n in enumerate("xyz")])


@query("compared_reducers")
def compared_reducers(spark, sf):
    return jobs.compare_reducers(raw(spark, sf), "vec_id", "embedding", "label", [8, 32]).withColumn("silhouette", F.round("silhouette", 6))


@query("parameter_sweep")
def parameter_sweep(spark, sf):
    grid = [{"min_samples": 3, "alpha": 1.0, "min_cluster_size": m, "cluster_selection_method": how, "cluster_selection_epsilon": e, "allow_single_cluster": False}
            for m in (3, 5) for how in ("eom", "leaf") for e in (0.0, 1.1)]
    return jobs.evaluate_runs(raw(spark, sf), "vec_id", "embedding", "label", grid)


@query("trained_word_vectors")
def trained_word_vectors(spark, sf):
    docs = table(spark, sf, "documents", "text").select(tx.words(F.col("text")).alias("tokens"))
    return ft.word_vectors(docs, "tokens", dim=16, epochs=2).select("word", F.round(F.get("vector", F.lit(0)), 6).alias("first"))


def _cooccurrences(spark, sf):
    docs = table(spark, sf, "documents", "text").select(tx.words(F.col("text")).alias("tokens"))
    return ws.cooccurrences(docs, "tokens")


@query("word_cooccurrence", r"""WITH t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents)),
  k AS (SELECT word FROM t GROUP BY word HAVING count(*) >= 5),
  d AS (SELECT doc_id, pos, word, unnest(range(1, 6)) AS d FROM t),
  o AS (SELECT d.word AS a, t.word AS b, count(*) AS n FROM d JOIN t ON t.doc_id = d.doc_id AND t.pos = d.pos + d.d GROUP BY ALL),
  c AS (SELECT a, b, sum(n) AS n FROM (SELECT a, b, n FROM o UNION ALL SELECT b, a, n FROM o) WHERE a IN (FROM k) AND b IN (FROM k) GROUP BY a, b),
  m AS (SELECT a, sum(n) AS na, pow(sum(n), 0.75) AS qa FROM c GROUP BY a), q AS (SELECT sum(qa) AS q FROM m),
  p AS (SELECT c.a, c.b, c.n, ln(c.n * q / (x.na * y.qa)) AS v FROM c JOIN m x ON x.a = c.a JOIN m y ON y.a = c.b, q)
SELECT a, b, CAST(n AS BIGINT) AS n, round(v, 6) AS pmi FROM p WHERE v > 1e-9""")
def word_cooccurrence(spark, sf):
    """How often words stand near each other, with their positive pointwise mutual information."""
    found = ws.positive_pmi(_cooccurrences(spark, sf)).where("v > 1e-9")
    return found.select("a", "b", "n", F.round("v", 6).alias("pmi"))


@query("cooccurrence_word_vectors")
def cooccurrence_word_vectors(spark, sf):
    """Word vectors from co-occurrence, 16 numbers each."""
    docs = table(spark, sf, "documents", "text").select(tx.words(F.col("text")).alias("tokens"))
    return ws.pmi_vectors(docs, "tokens", dim=16).select("word", F.transform("vector", lambda v: F.round(v, 4)).alias("vector"))


@query("topic_model")
def topic_model(spark, sf):
    docs = table(spark, sf, "documents", "text").select(sw.drop_stopwords(tx.words(F.col("text")), STOP).alias("tokens"))
    return ft.topic_model(docs, "tokens", k=10, passes=5)


@query("model_embeddings", "SELECT doc_id, CAST(length(text) AS FLOAT) AS length FROM documents")
def model_embeddings(spark, sf):
    """Batch inference with a plugged-in encoder (here: letter counts)."""

    def make_model():
        import numpy as np

        def predict(texts):
            return np.array([[sum(ch in "aeiou" for ch in t) / max(len(t), 1), float(len(t))] for t in texts], dtype=np.float32)

        return predict

    out = ft.encode(table(spark, sf, "documents", "doc_id", "text"), "text", make_model)
    return out.select("doc_id", F.get("embedding", F.lit(1)).alias("length"))


PARAMS = mc.Fading(lambd=0.1, eps=40.0, beta=0.5, mu=3.0)


def samples(df):
    """Events as (value, hour of day) samples."""
    return mc.checked_weight(df.select(
        "event_id", "event_type", "ts", F.array(F.col("value"), F.hour("ts").cast("double")).alias("x")))


def event_snapshots(spark, sf, lanes: int = 1):
    """Run the events as a stream and return the stored snapshots."""
    stream = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").option("maxBytesPerTrigger", str(256 << 20)).parquet(sf)
    target = work_path(spark, "snapshots")
    found = mc.micro_clusters(samples(stream), "event_type", "x", ["ts", "event_id"], PARAMS, lanes=lanes)
    query = found.writeStream.format("parquet").option("path", target).option("checkpointLocation", work_path(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(target)


@query("event_micro_clusters")
def event_micro_clusters(spark, sf):
    found = mc.latest(event_snapshots(spark, sf), "event_type")
    return found.select("event_type", "t", "kind", "place", F.round(F.get("center", F.lit(0)), 6).alias("value"), F.round("weight", 6).alias("weight"), F.round("radius", 6).alias("radius"))


@query("event_stream_labels")
def event_stream_labels(spark, sf):
    """Each event with the cluster of its nearest potential micro-cluster."""
    snaps = event_snapshots(spark, sf, lanes=4)
    return mc.offline_labels(samples(table(spark, sf, "events")), "event_id", "x", snaps, "event_type", eps=10.0, min_samples=5)


SPEC = cf.Cells(side=8.0, half_life=10 * 86400.0, threshold=2.0, pane="1 day", late="1 day")
CELL_EPS, CELL_MIN = 10.0, 12

_PLACED = """e AS (SELECT event_id, event_type, ts, value AS x, CAST(hour(ts) AS DOUBLE) AS y, CAST(floor(value / 8) AS BIGINT) AS i, CAST(floor(hour(ts) / 8.0) AS BIGINT) AS j,
    date_trunc('day', ts) + INTERVAL 1 DAY AS pane FROM events),
  o AS (SELECT *, x - 8 * i AS dx, y - 8 * j AS dy, pow(2.0, (epoch_us(ts) - epoch_us(CAST(pane AS TIMESTAMP))) / 864e9) AS w FROM e)"""
_MERGED = f"""{_PLACED}, f AS (SELECT event_type, i, j, dx, dy, pow(2.0, (epoch_us(ts) - epoch_us((SELECT max(ts) FROM events))) / 864e9) AS w FROM o),
  m AS (SELECT event_type, i, j, count(*) AS n, sum(w) AS weight, sum(w * dx) / sum(w) AS mx, sum(w * dy) / sum(w) AS my, sum(w * (dx * dx + dy * dy)) / sum(w) AS q FROM f GROUP BY event_type, i, j)"""


def event_features(spark, sf):
    """Additive features of the events, read as a stream; (value, hour) samples per event type."""
    stream = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").option("maxBytesPerTrigger", str(256 << 20)).parquet(sf)
    target = work_path(spark, "features")
    cf.keep_features(cf.cell_features(samples(stream), "event_type", "x", "ts", 2, SPEC), target, work_path(spark, "stream")).awaitTermination()
    return cf.newest_features(spark, target)


@query("event_cell_features", f"""WITH {_PLACED}
SELECT event_type, CAST(pane AS DATE) AS pane, i, j, count(*) AS n, round(sum(w), 6) AS weight, round(sum(w * dx), 6) AS dx, round(sum(w * dy), 6) AS dy, round(sum(w * (dx * dx + dy * dy)), 6) AS square
FROM o GROUP BY event_type, pane, i, j""")
def event_cell_features(spark, sf):
    """Streaming state of the additive micro-clusters: one entry per event type, day and cell."""
    at = lambda c, i: F.get(c, F.lit(i))
    return event_features(spark, sf).select(
        F.col("key").alias("event_type"), F.to_date("pane").alias("pane"), at("cell", 0).alias("i"), at("cell", 1).alias("j"), "n", F.round("weight", 6).alias("weight"),
        F.round(at("offset", 0), 6).alias("dx"), F.round(at("offset", 1), 6).alias("dy"), F.round("square", 6).alias("square"))


@query("event_merged_clusters", f"""WITH {_MERGED}
SELECT event_type, i, j, n, round(weight, 6) AS weight, round(8 * i + mx, 6) AS x, round(8 * j + my, 6) AS y, round(sqrt(greatest(q - mx * mx - my * my, 0)), 5) AS radius,
  CASE WHEN weight >= 2 THEN 'potential' ELSE 'outlier' END AS kind FROM m""")
def event_merged_clusters(spark, sf):
    """Days faded on to the newest event and added up: micro-clusters with center, radius and kind."""
    at = lambda c, i: F.get(c, F.lit(i))
    return cf.merged(event_features(spark, sf), 2, SPEC).select(
        F.col("key").alias("event_type"), at("cell", 0).alias("i"), at("cell", 1).alias("j"), "n", F.round("weight", 6).alias("weight"),
        F.round(at("center", 0), 6).alias("x"), F.round(at("center", 1), 6).alias("y"), F.round("radius", 5).alias("radius"), "kind")


@query("event_cell_labels", f"""WITH RECURSIVE {_MERGED},
  p AS MATERIALIZED (SELECT event_type || '/' || i || '/' || j AS id, event_type, i, j, weight, 8 * i + mx AS x, 8 * j + my AS y FROM m WHERE weight >= 2),
  n AS MATERIALIZED (SELECT a.id AS a, b.id AS b, b.weight AS w FROM p a, p b WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {CELL_EPS}),
  c AS MATERIALIZED (SELECT a AS id FROM n GROUP BY a HAVING sum(w) >= {CELL_MIN}),
  r AS (SELECT id, id AS low FROM c UNION SELECT n.b, r.low FROM r JOIN n ON n.a = r.id WHERE n.b IN (SELECT id FROM c)),
  comp AS (SELECT id, min(low) AS comp FROM r GROUP BY id), num AS (SELECT comp, dense_rank() OVER (ORDER BY comp) - 1 AS label FROM (SELECT DISTINCT comp FROM comp)),
  adopted AS (SELECT n.a AS id, min(comp) AS comp FROM n JOIN comp ON comp.id = n.b WHERE n.a NOT IN (SELECT id FROM c) GROUP BY n.a),
  every AS (SELECT id, comp FROM comp UNION ALL SELECT id, comp FROM adopted)
SELECT event_id, CAST(coalesce(num.label, -1) AS INTEGER) AS label FROM e LEFT JOIN p USING (event_type, i, j) LEFT JOIN every USING (id) LEFT JOIN num USING (comp)""")
def event_cell_labels(spark, sf):
    """Each event with the density cluster of its merged micro-cluster."""
    clusters = materialize(cf.merged(event_features(spark, sf), 2, SPEC), "merged")
    labels = materialize(cf.cluster_labels(clusters, CELL_EPS, CELL_MIN), "labels")
    return cf.sample_labels(samples(table(spark, sf, "events")), "event_id", "event_type", "x", labels, SPEC)


@query("sample_weights", "SELECT event_id, value AS weight FROM events")
def sample_weights(spark, sf):
    return mc.checked_weight(table(spark, sf, "events"), "value").select("event_id", "weight")


@query("incremental_clusters")
def incremental_clusters(spark, sf):
    """Labels of everything seen after each of two batches."""
    stream = inc.file_stream(spark, raw(spark, sf).select("vec_id", "embedding"), 2, "vec_id", "vectors-stream")
    target = work_path(spark, "growing")
    inc.cluster_stream(stream, inc.GrowingClusters("vec_id", "embedding"), target, work_path(spark, "stream"))
    return spark.read.parquet(target)


_MOVING_SQL = """l AS (
    SELECT vec_id, CAST(b AS INTEGER) AS batch_id, CAST(CASE WHEN vec_id % 11 = b THEN -1 ELSE (CASE WHEN b = 3 AND w = 9 AND vec_id % 3 = 0 THEN 10 WHEN b >= 2 AND w = 1 THEN 0 ELSE w END * (b + 1)) % 11 END AS INTEGER) AS label
    FROM (SELECT vec_id, b, (label + CASE WHEN vec_id % 7 = b THEN 1 ELSE 0 END) % 10 AS w FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS b) WHERE vec_id % 4 <= b))"""


def _identities_sql(rounds: int) -> str:
    steps = "".join(f""",
  m{i} AS MATERIALIZED (SELECT * FROM (SELECT *, min(o) OVER (PARTITION BY frame, before) AS x, min(o) OVER (PARTITION BY frame, after) AS y FROM p{i}) WHERE o = x AND o = y),
  p{i + 1} AS MATERIALIZED (SELECT p.* FROM p{i} p ANTI JOIN m{i} USING (frame, before) ANTI JOIN m{i} n ON n.frame = p.frame AND n.after = p.after)""" for i in range(rounds))
    matched = " UNION ALL ".join(f"SELECT frame, before, after, shared FROM m{i}" for i in range(rounds))
    return f"""WITH RECURSIVE {_MOVING_SQL},
  f AS (SELECT *, CAST(dense_rank() OVER (ORDER BY batch_id) AS INTEGER) AS frame FROM l),
  sizes AS (SELECT frame, label, count(*) AS size FROM f WHERE label <> -1 GROUP BY ALL),
  c AS (SELECT y.frame, x.label AS before, y.label AS after, count(*) AS shared FROM f x JOIN f y ON x.vec_id = y.vec_id AND y.frame = x.frame + 1 WHERE x.label <> -1 AND y.label <> -1 GROUP BY ALL),
  p0 AS MATERIALIZED (SELECT c.*, row_number() OVER (PARTITION BY c.frame ORDER BY shared DESC, s.size + t.size, before, after) AS o
    FROM c JOIN sizes s ON s.frame = c.frame - 1 AND s.label = before JOIN sizes t ON t.frame = c.frame AND t.label = after WHERE 100 * shared >= 30 * s.size){steps},
  m AS MATERIALIZED ({matched}),
  t AS (SELECT frame, label, frame || ':' || label AS identity FROM sizes ANTI JOIN (SELECT frame, after AS label FROM m) USING (frame, label)
    UNION ALL SELECT m.frame, m.after, t.identity FROM t JOIN m ON m.frame = t.frame + 1 AND m.before = t.label)"""


def moving_labels(spark, sf):
    """Labels of four growing batches: new numbers every time, rows that move, noise, two clusters that merge and one that splits."""
    rows = table(spark, sf, "embeddings", "vec_id", "label").withColumn("b", F.explode(F.array(*[F.lit(i) for i in range(4)]))).where("vec_id % 4 <= b")
    rows = rows.withColumn("w", F.expr("(label + CASE WHEN vec_id % 7 = b THEN 1 ELSE 0 END) % 10"))
    cluster = F.expr("(CASE WHEN b = 3 AND w = 9 AND vec_id % 3 = 0 THEN 10 WHEN b >= 2 AND w = 1 THEN 0 ELSE w END * (b + 1)) % 11")
    return rows.select("vec_id", F.col("b").alias("batch_id"), F.when(F.expr("vec_id % 11 = b"), -1).otherwise(cluster).cast("int").alias("label"))


@query("cluster_identities", f"""{_identities_sql(8)}
SELECT t.frame, t.label, identity, size, before, shared FROM t JOIN sizes USING (frame, label) LEFT JOIN (SELECT frame, after AS label, before, shared FROM m) USING (frame, label)""")
def cluster_identities(spark, sf):
    """Clusters of every batch under the name they were first seen by."""
    return idn.identities(moving_labels(spark, sf), "vec_id")


@query("identity_frames", f"""{_identities_sql(8)}
SELECT f.frame, f.batch_id, f.vec_id, f.label, t.identity FROM f LEFT JOIN t USING (frame, label)""")
def identity_frames(spark, sf):
    """Frames of an animated plot: every row of every batch with its cluster's lasting name."""
    return idn.identity_frames(moving_labels(spark, sf), "vec_id")


@query("incremental_ingest", "SELECT doc_id AS article_uid FROM documents")
def incremental_ingest(spark, sf):
    """A stream in which every article arrives twice; the table holds it once."""
    base = table(spark, sf, "documents", "doc_id", "text").select(F.col("doc_id").alias("article_uid"), "text")
    twice = base.withColumn("n", F.lit(0)).unionByName(base.withColumn("n", F.lit(1)))
    stream = inc.file_stream(spark, twice, 2, "n", "articles-stream")
    target = work_path(spark, "ingested")
    inc.ingest(stream, "article_uid", lambda d: d.select("article_uid", ft.hashed_embedding(tx.words(F.col("text"))).alias("embedding")), target, work_path(spark, "stream"))
    return spark.read.parquet(target).select("article_uid")


@query("batch_job")
def batch_job(spark, sf):
    """Embed all articles into a table, cluster the table, store the topics."""
    emb, topics = work_path(spark, "job-embeddings"), work_path(spark, "job-topics")
    jobs.embed_job(spark, articles(spark, sf), emb, first_run=True, limit=None)
    jobs.topic_job(spark, emb, topics, cluster_selection_method="leaf")
    return src.read_table(spark, topics)


_ITEM_VECTORS = """{0}n AS (SELECT id, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % 64 AS dim, count(*) AS n FROM (
    SELECT {1} AS id, unnest(regexp_extract_all(lower({2}), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM {3}) GROUP BY ALL),
  {0}v AS (SELECT id, dim, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS v FROM {0}n)"""


def _chain_sql() -> str:
    clean = rules_sql("text", tx.cleaning_rules())
    return f"""WITH {_ITEM_VECTORS.format('x', 'item_id', clean, 'benchmark')}, {_ITEM_VECTORS.format('y', 'doc_id', clean, 'documents')},
  s AS (SELECT x.id AS article_uid, y.id AS neighbor, 1 - sum(x.v * y.v) AS distance FROM xv x JOIN yv y USING (dim) GROUP BY x.id, y.id),
  r AS (SELECT *, row_number() OVER (PARTITION BY article_uid ORDER BY round(distance, 9), neighbor) AS rank FROM s)
SELECT article_uid, neighbor, CAST(rank AS INTEGER) AS rank, abs(round(distance, 6)) AS distance FROM r WHERE rank <= 3"""


@query("fluent_chain", _chain_sql())
def fluent_chain(spark, sf):
    """Benchmark items against documents: clean, embed, normalize, nearest three."""
    x = table(spark, sf, "benchmark").select(F.col("item_id").alias("article_uid"), "text")
    y = table(spark, sf, "documents", "doc_id", "text").select(F.col("doc_id").alias("article_uid"), "text")
    pipe = Pipe(x, y).clean("text").embed("text").normalize()
    found = Pipe(*[d.where(F.col("embedding").isNotNull()) for d in pipe.value()]).nearest(3).value()
    return found.withColumn("distance", F.abs(F.round("distance", 6)))



@query("kept_steps", _chain_sql().replace("SELECT article_uid, neighbor", """SELECT article_uid, neighbor, split_part(b.text, chr(10), 1) AS headline, split_part(d.text, chr(10), 1) AS near_headline,
  md5(""" + rules_sql("d.text", tx.cleaning_rules()) + """) AS near_clean""").replace("FROM r WHERE", "FROM r JOIN benchmark b ON b.item_id = article_uid JOIN documents d ON d.doc_id = neighbor WHERE"))
def kept_steps(spark, sf):
    """The chain with headlines stored before and cleaned texts after cleaning, recalled behind the search."""
    headline = F.split_part("text", F.lit("\n"), F.lit(1)).alias("headline")
    x = table(spark, sf, "benchmark").select(F.col("item_id").alias("article_uid"), "text", headline)
    y = table(spark, sf, "documents", "doc_id", "text").select(F.col("doc_id").alias("article_uid"), "text", headline)
    pipe = Pipe(x, y).store("headlines", "headline").clean("text").store("clean", "text").embed("text").normalize()
    pipe = pipe.together(lambda d: d.where(F.col("embedding").isNotNull())).nearest(3)
    found = pipe.recall("headlines").recall("headlines", "neighbor", "y", "near_").recall("clean", "neighbor", "y", "near_").value()
    return found.select("article_uid", "neighbor", "rank", "headline", "near_headline", F.md5("near_text").alias("near_clean"), F.abs(F.round("distance", 6)).alias("distance"))
