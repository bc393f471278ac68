"""Density clustering as rounds of joins: weighted DBSCAN and hierarchical density clusters.

Hierarchy, in four exact steps:

1. nearest neighbors give core distances (``cells.knn``);
2. Boruvka rounds over mutual reachability build the minimum spanning tree. The neighbor lists
   answer most rounds; a point whose list is too short to be sure searches the cells within the
   weight its component already has;
3. the rounds also order the merges: a tree edge hangs below the first component whose own next
   merge is heavier, so the merge tree comes from one join per round and a sort inside each chain;
4. sizes, stabilities and the selection run up and down that tree by pointer jumping.

Equal vectors are one weighted point throughout.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from topicloom.operators.cells import (
    BLOCK_ROWS, CELL_ROWS, SLACK, Space, build_cells, exact, knn, matrix, pair_distances, probe, rough, rough_error, rough_squared, sortable, sql_type,
)
from topicloom.operators.descent import Distance, neighbor_graph
from topicloom.operators.graph import ancestor_pairs, any_ancestor, components, jump, sum_below
from topicloom.operators.ranking import next_in_group, rank_in_group
from topicloom.session import by_shuffle, materialize, step_scope

NEIGHBORS = 8
OUTLIER = -1

# Default parameters of the clustering calls.
PIPE_DEFAULTS = {
    "min_cluster_size": 3, "min_samples": 3, "alpha": 1.0, "cluster_selection_epsilon": 0.14,
    "allow_single_cluster": True, "cluster_selection_method": "eom",
}
LEAF_DEFAULTS = {
    "min_cluster_size": 3, "min_samples": 2, "alpha": 1.0, "cluster_selection_epsilon": 0.14,
    "allow_single_cluster": False, "cluster_selection_method": "leaf",
}


@dataclass(frozen=True)
class MergeTree:
    """Single-linkage tree of the mutual reachability distances.

    ``points`` (rep, copies, core, parent), ``merges`` (eid, w, parent, size), ``members`` (rep, uid, by).
    """

    points: DataFrame
    merges: DataFrame
    members: DataFrame
    edges: DataFrame
    uid: str
    by: tuple[str, ...]


def _core(groups: DataFrame, lists: DataFrame, min_samples: int) -> DataFrame:
    """(rep, _core, _last, _got): core distance out of the neighbor lists, how far a list reaches, and its length."""
    weights = groups.select(F.col("rep").alias("neighbor"), F.col("copies").alias("_w"))
    running = Window.partitionBy("rep").orderBy("rank")
    counted = lists.select("rep", "neighbor", "distance", "rank").join(weights, "neighbor").withColumn("_sum", F.sum("_w").over(running))
    own = groups.select("rep", F.col("copies").alias("_own"))
    enough = F.col("_own") - 1 + F.col("_sum") >= min_samples
    return counted.join(own, "rep").groupBy("rep").agg(
        F.coalesce(F.min(F.when(enough, F.col("distance"))), F.max("distance")).alias("_core"),
        F.max("distance").alias("_last"), F.count(F.lit(1)).alias("_got"),
    )


def weighted_points(groups: DataFrame, lists: DataFrame, min_samples: int) -> DataFrame:
    """(_y, copies, core) of points (rep, copies), with core distances out of neighbor lists (rep, neighbor, rank, distance)."""
    core = F.when(F.col("copies") > min_samples, 0.0).otherwise(F.coalesce("_core", F.lit(0.0)))
    return groups.join(_core(groups, lists, min_samples), "rep", "left").select(F.col("rep").alias("_y"), "copies", core.alias("core"))


def _neighbors(groups: DataFrame, by: list[str], vec: str, min_samples: int, cell_rows: int, block_rows: int):
    """Indexed points with core distance and list reach, and the neighbor lists."""
    k = max(min_samples, NEIGHBORS)
    source = groups.select(*by, F.col("rep").alias("_y"), vec, "copies")
    cells = build_cells(source, "_y", vec, tuple(by), cell_rows=cell_rows, block_rows=block_rows)
    lists = materialize(knn(groups.select(*by, "rep", vec), cells, "rep", vec, k, same=True), "neighbors")
    core = _core(groups, lists, min_samples)
    points = cells.rows.join(core, cells.rows["_y"] == core["rep"], "left").select(
        *by, "_y", vec, "cell", "copies",
        F.when(F.col("copies") > min_samples, 0.0).otherwise(F.coalesce("_core", F.lit(0.0))).alias("core"),
        # A list shorter than asked for holds every point there is.
        F.when(F.col("_got") >= k, F.col("_last")).otherwise(F.lit(float("inf"))).alias("reach"),
    )
    return cells, materialize(points, "points"), lists


def core_distances(
    df: DataFrame, uid: str, vec: str, min_samples: int = 3, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(uid, core): distance of every row's ``min_samples``-th nearest other row."""
    base = materialize(df.select(uid, vec), "input")
    groups = materialize(base.groupBy(vec).agg(F.min(uid).alias("rep"), F.count(F.lit(1)).alias("copies")), "groups")
    _, points, _ = _neighbors(groups, [], vec, min_samples, cell_rows, block_rows)
    return base.join(points.select(vec, "core"), vec).select(uid, "core")


def _outgoing(schema_uid: str, vec: str, alpha: float):
    """Per probe the lightest edge to another component, at most as heavy as the probe's limit."""

    def search(left: pd.DataFrame, right: pd.DataFrame, seen: dict) -> pd.DataFrame:
        a, b = matrix(left[vec]), matrix(right[vec])
        cx, cy = left["core"].to_numpy(np.float64), right["core"].to_numpy(np.float64)
        w = np.maximum(np.maximum(cx[:, None], cy[None, :]), rough(a, b, "l2") / alpha)
        w[left["comp"].to_numpy()[:, None] == right["comp"].to_numpy()[None, :]] = np.inf
        limit = left["_limit"].to_numpy(np.float64)
        low = np.minimum(w.min(1), limit)
        i, j = np.nonzero((w <= (low * (1 + SLACK) + SLACK)[:, None]) & np.isfinite(w))
        weight = np.maximum(np.maximum(cx[i], cy[j]), exact(a[i], b[j], "l2") / alpha)
        x, y = sortable(left["rep"])[i], sortable(right["_y"])[j]
        lo, hi = np.where(x < y, x, y), np.where(x < y, y, x)
        order = np.lexsort((hi, lo, weight, i))
        first = order[np.r_[True, np.diff(i[order]) > 0]] if len(order) else order
        first = first[weight[first] <= limit[i[first]]]
        return pd.DataFrame({
            "comp": left["comp"].to_numpy()[i[first]], "other": right["comp"].to_numpy()[j[first]],
            "w": weight[first], "lo": lo[first], "hi": hi[first],
        })

    return search


def _lightest(found: pd.DataFrame) -> pd.DataFrame:
    """The lightest edge of every component."""
    order = np.lexsort((sortable(found["hi"]), sortable(found["lo"]), found["w"].to_numpy()))
    return found.iloc[order].drop_duplicates("comp")


def build_tree(
    df: DataFrame, uid: str, vec: str, min_samples: int = 3, alpha: float = 1.0, by: list[str] | None = None,
    cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS,
) -> MergeTree:
    """Exact merge tree of ``df``; with ``by`` one tree per value, all in the same job. Ids are unique overall."""
    by = by or []
    base = materialize(df.select(*by, uid, vec), "input")
    groups = materialize(base.groupBy(*by, vec).agg(F.min(uid).alias("rep"), F.count(F.lit(1)).alias("copies")), "groups")
    owner = groups.select(*by, vec, "rep")
    members = materialize(base.join(owner, [*by, vec]).select("rep", uid, *by), "members")
    cells, points, lists = _neighbors(groups, by, vec, min_samples, cell_rows, block_rows)
    id_type = sql_type(points, "_y")

    core = points.select(F.col("_y").alias("id"), "core")
    listed = (
        lists.select("rep", "neighbor", "distance")
        .join(core.select(F.col("id").alias("rep"), F.col("core").alias("_ca")), "rep")
        .join(core.select(F.col("id").alias("neighbor"), F.col("core").alias("_cb")), "neighbor")
        .select(
            F.least("rep", "neighbor").alias("lo"), F.greatest("rep", "neighbor").alias("hi"),
            F.greatest("_ca", "_cb", F.col("distance") / alpha).alias("w"),
        ).distinct().select("lo", "hi", "w", F.col("lo").alias("ca"), F.col("hi").alias("cb"))
    )
    edges = materialize(listed, "candidates")
    search = _outgoing("rep", vec, alpha)
    schema = f"comp {id_type}, other {id_type}, w double, lo {id_type}, hi {id_type}"

    def look_further(known: DataFrame, comp: DataFrame) -> DataFrame | None:
        """Lighter outgoing edges of points whose neighbor list does not reach as far as the best known edge."""
        tagged = materialize(points.join(comp, "_y"), "tagged")
        limit = F.coalesce(F.col("w"), F.lit(float("inf")))
        unsure = materialize(tagged.join(known.select("comp", "w"), "comp", "left").where(
            F.greatest(F.col("core"), F.col("reach") / alpha) < limit
        ).select(*by, F.col("_y").alias("rep"), vec, "core", "comp", limit.alias("_limit")), "unsure")
        if unsure.isEmpty():
            return None
        whole = {}
        if not by and len(cells.pivots) > 1:
            spans = tagged.groupBy("cell").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a = b").collect()
            whole = {r["cell"]: str(r["a"]) for r in spans}
        return probe(
            unsure, cells, "rep", vec, F.col("_limit") * alpha, search, schema, skip=whole, tag=F.col("comp"),
            rows=tagged.select(*by, "_y", vec, "cell", "core", "comp"), reduce=_lightest,
        )

    levels = _boruvka(points, edges, look_further)
    return _merge_tree(points, levels, members, uid, tuple(by), id_type)


def _boruvka(points: DataFrame, edges: DataFrame, look_further=None) -> list[DataFrame]:
    """Spanning forest by rounds: one table (comp, next, w, lo, hi) per round with the edge every component picked."""
    comp = points.select("_y", F.col("_y").alias("comp"))
    levels: list[DataFrame] = []
    lightest = F.min(F.struct("w", "lo", "hi", "other")).alias("e")
    while True:
        out = edges.select(F.col("ca").alias("comp"), F.col("cb").alias("other"), "w", "lo", "hi").unionByName(
            edges.select(F.col("cb").alias("comp"), F.col("ca").alias("other"), "w", "lo", "hi"))
        known = materialize(out.groupBy("comp").agg(lightest).select("comp", "e.*"), "known")
        with step_scope(points.sparkSession):  # what the search stores goes with it
            found = look_further(known, comp) if look_further else None
            if found is not None:
                known = materialize(known.unionByName(found).groupBy("comp").agg(lightest).select("comp", "e.*"), "known", kept=True)
        if known.isEmpty():
            return levels
        back = known.select(F.col("comp").alias("other"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
        mutual = (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi")) & (F.col("comp") < F.col("other"))
        hooks = known.join(back, "other", "left").select(
            "comp", F.when(F.coalesce(mutual, F.lit(False)), F.col("comp")).otherwise(F.col("other")).alias("next")
        )
        ends = jump(hooks, [], "comp", "next")
        levels.append(materialize(known.join(ends, "comp").select("comp", "next", "w", "lo", "hi"), "level"))
        comp = materialize(comp.join(ends, "comp", "left").select("_y", F.coalesce("next", "comp").alias("comp")), "comp")
        to_a = ends.select(F.col("comp").alias("ca"), F.col("next").alias("_na"))
        to_b = ends.select(F.col("comp").alias("cb"), F.col("next").alias("_nb"))
        edges = materialize(
            edges.join(to_a, "ca", "left").join(to_b, "cb", "left").select(
                "lo", "hi", "w", F.coalesce("_na", "ca").alias("ca"), F.coalesce("_nb", "cb").alias("cb")
            ).where("ca <> cb"), "candidates")


def tree_from_edges(points: DataFrame, edges: DataFrame, members: DataFrame, uid: str, alpha: float = 1.0) -> MergeTree:
    """Merge tree over given candidate edges (lo, hi, distance) and points (_y, copies, core).

    Parts the edges do not connect are joined at infinite distance, that is at density zero.
    """
    id_type = sql_type(points, "_y")
    core = points.select(F.col("_y").alias("id"), "core")
    weighed = materialize(
        edges.join(core.select(F.col("id").alias("lo"), F.col("core").alias("_ca")), "lo")
        .join(core.select(F.col("id").alias("hi"), F.col("core").alias("_cb")), "hi")
        .select("lo", "hi", F.greatest("_ca", "_cb", F.col("distance") / alpha).alias("w"), F.col("lo").alias("ca"), F.col("hi").alias("cb")),
        "candidates")
    levels = _boruvka(points, weighed)
    comp = points.select("_y", F.col("_y").alias("comp"))
    for level in levels:
        comp = comp.join(level.select("comp", "next"), "comp", "left").select("_y", F.coalesce("next", "comp").alias("comp"))
    roots = materialize(comp.select("comp").distinct().withColumn("_all", F.lit(0)), "roots")
    if roots.count() > 1:
        bridges = next_in_group(roots, ["_all"], [F.col("comp")], F.col("comp"), "other").where(F.col("other").isNotNull()).select(
            F.col("comp").alias("lo"), F.col("other").alias("hi"), F.lit(float("inf")).alias("w"), F.col("comp").alias("ca"), F.col("other").alias("cb"))
        levels = _boruvka(points, weighed.unionByName(bridges.select(weighed.columns)))
    return _merge_tree(points, levels, members, uid, (), id_type)


def _merge_tree(points: DataFrame, levels: list[DataFrame], members: DataFrame, uid: str, by: tuple[str, ...], id_type: str) -> MergeTree:
    spark = points.sparkSession
    if not levels:
        none = spark.createDataFrame([], f"eid long, w double, lo {id_type}, hi {id_type}, parent long, size long")
        alone = points.select(F.col("_y").alias("rep"), "copies", "core", F.lit(None).cast("long").alias("parent"))
        return MergeTree(alone, none, members, none.select("lo", "hi", "w"), uid, by)
    picked = None
    for i, level in enumerate(levels):
        part = level.groupBy("w", "lo", "hi").agg(F.min("next").alias("at")).withColumn("start", F.lit(i + 1))
        picked = part if picked is None else picked.unionByName(part)
    merges = materialize(picked.withColumn("eid", F.monotonically_increasing_id()), "merges")
    names = merges.select("lo", "hi", "eid")

    waiting, placed = merges, []
    weight = F.struct("w", "lo", "hi")
    for i in range(1, len(levels) + 1):
        now = waiting.where(F.col("start") <= i)
        later = waiting.where(F.col("start") > i)
        if i == len(levels):
            placed.append(now.select("eid", "w", "lo", "hi", F.lit(i).alias("level"), "at",
                                     F.lit(None).cast(id_type).alias("glo"), F.lit(None).cast(id_type).alias("ghi")))
            break
        step = levels[i].select(F.col("comp").alias("at"), "next", F.col("w").alias("gw"), F.col("lo").alias("glo"), F.col("hi").alias("ghi"))
        met = materialize(now.join(step, "at", "left"), "met")
        below = F.col("gw").isNull() | (F.struct(F.col("gw").alias("w"), F.col("glo").alias("lo"), F.col("ghi").alias("hi")) > weight)
        placed.append(met.where(below).select("eid", "w", "lo", "hi", F.lit(i).alias("level"), "at", "glo", "ghi"))
        above = met.where(~below).select("w", "lo", "hi", F.col("next").alias("at"), "start", "eid")
        waiting = above.unionByName(later.select(above.columns))
    chains = placed[0]
    for part in placed[1:]:
        chains = chains.unionByName(part)
    heads = names.select(F.col("lo").alias("glo"), F.col("hi").alias("ghi"), F.col("eid").alias("_over"))
    chains = chains.join(heads, ["glo", "ghi"], "left")
    hung = next_in_group(chains, ["level", "at"], [F.col("w"), F.col("lo"), F.col("hi")], F.col("eid"), "follower")
    parents = materialize(hung.select("eid", "w", "lo", "hi", F.coalesce("follower", "_over").alias("parent")), "parents")

    first = levels[0].select(F.col("comp").alias("rep"), "lo", "hi").join(names, ["lo", "hi"]).select("rep", F.col("eid").alias("parent"))
    leaves = materialize(points.select(F.col("_y").alias("rep"), "copies", "core").join(first, "rep", "left"), "leaves")
    direct = leaves.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("eid")).agg(F.sum("copies").alias("_n"))
    counted = parents.join(direct, "eid", "left").select("eid", "parent", F.coalesce("_n", F.lit(0)).alias("size"))
    sizes = sum_below(counted, "eid", "parent", "size")
    tree = materialize(parents.join(sizes, "eid"), "tree")
    return MergeTree(leaves, tree.select("eid", "w", "lo", "hi", "parent", "size"), members, merges.select("lo", "hi", "w"), uid, by)


@dataclass(frozen=True)
class Condensed:
    """Condensed trees of several runs: ``clusters`` (run, c, parent, birth, size, stability) and ``exits``
    (run, rep, copies, c, lam): the cluster a point leaves last and the density at which it does.

    Both have rows for every run, and so have the steps to them. On disk these are small enough for a broadcast long after they are too many
    for the driver, so all of them are joined by shuffle."""

    clusters: DataFrame
    exits: DataFrame
    runs: list[dict]


def _lambda(w: Column) -> Column:
    return F.when(w > 0, 1 / w).otherwise(F.lit(float("inf")))


def condense(tree: MergeTree, runs: list[dict]) -> Condensed:
    """Condensed tree for every run's ``min_cluster_size``, all runs in one job with the run as a key."""
    sizes = F.array(*[F.struct(F.lit(i).alias("run"), F.lit(int(r["min_cluster_size"])).alias("m")) for i, r in enumerate(runs)])
    merges = tree.merges.select("eid", "w", "parent", "size", F.explode(sizes).alias("r")).select(
        "r.run", "eid", "w", "parent", "size", ((F.col("size") >= F.col("r.m")) | F.col("parent").isNull()).alias("big"))
    points = tree.points.select("rep", "copies", "core", "parent", F.explode(sizes).alias("r")).select(
        "r.run", "rep", "copies", "core", "parent", (F.col("copies") >= F.col("r.m")).alias("big"))
    big_children = (
        merges.where("big AND parent IS NOT NULL").select("run", "parent")
        .unionByName(points.where("big AND parent IS NOT NULL").select("run", "parent"))
        .groupBy("run", F.col("parent").alias("eid")).agg(F.count(F.lit(1)).alias("_bc"))
    )
    split = materialize(merges.join(by_shuffle(big_children), ["run", "eid"], "left").withColumn(
        "split", F.col("big") & (F.coalesce("_bc", F.lit(0)) == 2)).drop("_bc"), "splits")
    above = split.select("run", F.col("eid").alias("parent"), F.col("split").alias("_ps"), F.col("w").alias("_pw"))
    placed = materialize(split.join(by_shuffle(above), ["run", "parent"], "left").withColumn(
        "top", F.col("big") & (F.col("parent").isNull() | F.col("_ps"))), "placed")

    roof = jump(placed.where("big").select("run", "eid", F.when(F.col("top"), F.col("eid")).otherwise(F.col("parent")).alias("roof")), ["run"], "eid", "roof")
    rest = jump(placed.select("run", "eid", F.when(F.col("big"), F.col("eid")).otherwise(F.col("parent")).alias("floor")), ["run"], "eid", "floor")
    name = lambda c: F.concat(F.lit("e"), F.col(c).cast("string"))

    floors = rest.select("run", F.col("eid").alias("parent"), "floor")
    floor_weight = split.select("run", F.col("eid").alias("floor"), F.col("w").alias("_fw"))
    roofs = roof.select("run", F.col("eid").alias("floor"), "roof")
    own = F.col("big") & F.coalesce("_ps", F.lit(False))
    exits = (
        points.where(F.col("parent").isNotNull()).join(by_shuffle(above), ["run", "parent"]).join(by_shuffle(floors), ["run", "parent"])
        .join(by_shuffle(floor_weight), ["run", "floor"]).join(by_shuffle(roofs), ["run", "floor"])
        .select(
            "run", "rep", "copies", F.when(own, F.concat(F.lit("p"), F.col("rep").cast("string"))).otherwise(name("roof")).alias("c"),
            _lambda(F.when(F.col("big"), F.col("core")).otherwise(F.col("_fw"))).alias("lam"),
            own.alias("own"), name("roof").alias("over"), F.col("_pw"),
        )
    )
    exits = materialize(exits, "exits")
    tops = placed.where("top").join(
        by_shuffle(roof.select("run", F.col("eid").alias("parent"), F.col("roof").alias("_over"))), ["run", "parent"], "left"
    ).select("run", name("eid").alias("c"), F.when(F.col("parent").isNotNull(), name("_over")).alias("parent"),
             F.when(F.col("parent").isNull(), 0.0).otherwise(_lambda(F.col("_pw"))).alias("birth"), "size")
    lone = exits.where("own").select("run", "c", F.col("over").alias("parent"), _lambda(F.col("_pw")).alias("birth"), F.col("copies").alias("size"))
    clusters = materialize(tops.unionByName(lone), "clusters")
    leaving = exits.select("run", "c", F.col("copies").alias("n"), "lam").unionByName(
        clusters.where(F.col("parent").isNotNull()).select("run", F.col("parent").alias("c"), F.col("size").alias("n"), F.col("birth").alias("lam")))
    stable = leaving.join(by_shuffle(clusters.select("run", "c", "birth")), ["run", "c"]).groupBy("run", "c").agg(
        F.sum(F.col("n") * (F.col("lam") - F.col("birth"))).alias("stability"))
    clusters = materialize(clusters.join(by_shuffle(stable), ["run", "c"], "left").withColumn("stability", F.coalesce("stability", F.lit(0.0))), "clusters")
    return Condensed(clusters, exits.select("run", "rep", "copies", "c", "lam"), runs)


def condensed_rows(tree: Condensed) -> DataFrame:
    """Edge list (run, parent, child, lambda_val, child_size); a point's child name is its id."""
    points = tree.exits.select("run", F.col("c").alias("parent"), F.col("rep").cast("string").alias("child"), F.col("lam").alias("lambda_val"), F.col("copies").alias("child_size"))
    inner = tree.clusters.where(F.col("parent").isNotNull()).select("run", "parent", F.col("c").alias("child"), F.col("birth").alias("lambda_val"), F.col("size").alias("child_size"))
    return points.unionByName(inner)


def cluster_members(tree: Condensed) -> DataFrame:
    """(run, c, rep): every point of every cluster of the hierarchy."""
    pairs = ancestor_pairs(tree.clusters, ["run"], "c", "parent")
    return tree.exits.select("run", "rep", "c").join(by_shuffle(pairs), ["run", "c"]).select("run", F.col("ancestor").alias("c"), "rep")


def _subtree_best(clusters: DataFrame) -> DataFrame:
    """(run, c, below): best total stability reachable below each cluster.

    best(c) = max(own, sum over children). Finished children are added up (rake); a cluster with one
    open child is a function max(a, x + b) of it, and runs of such clusters are composed (compress),
    so the rounds are logarithmic even in a chain.
    """
    state = materialize(clusters.select(
        "run", "c", "parent", F.col("stability").alias("own"), F.lit(None).cast("double").alias("best"),
        F.lit(None).cast("string").alias("ptr"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b")), "eom")
    while True:
        kids = state.where(F.col("parent").isNotNull()).groupBy("run", F.col("parent").alias("c")).agg(
            F.sum("best").alias("_done"), F.count_if(F.col("best").isNull()).alias("_open"),
            F.min(F.when(F.col("best").isNull(), F.col("c"))).alias("_only"))
        done = F.coalesce("_done", F.lit(0.0))
        raked = state.join(by_shuffle(kids), ["run", "c"], "left")
        single = F.col("best").isNull() & F.col("ptr").isNull() & (F.col("_open") == 1)
        raked = materialize(raked.select(
            "run", "c", "parent", "own",
            F.when(F.col("best").isNotNull(), F.col("best")).when(F.coalesce("_open", F.lit(0)) == 0, F.greatest("own", done)).alias("best"),
            F.when(single, F.col("_only")).otherwise(F.col("ptr")).alias("ptr"),
            F.when(single, F.col("own")).otherwise(F.col("a")).alias("a"),
            F.when(single, done).otherwise(F.col("b")).alias("b")), "eom")
        ahead = raked.select("run", F.col("c").alias("ptr"), F.col("best").alias("_best"), F.col("ptr").alias("_ptr"), F.col("a").alias("_a"), F.col("b").alias("_b"))
        far = F.col("_ptr").isNotNull() & F.col("_best").isNull()
        state = materialize(raked.join(by_shuffle(ahead), ["run", "ptr"], "left").select(
            "run", "c", "parent", "own",
            F.when(F.col("best").isNotNull(), F.col("best")).when(F.col("_best").isNotNull(), F.greatest(F.col("a"), F.col("_best") + F.col("b"))).alias("best"),
            F.when(far, F.col("_ptr")).otherwise(F.col("ptr")).alias("ptr"),
            F.when(far, F.greatest(F.col("a"), F.col("_a") + F.col("b"))).otherwise(F.col("a")).alias("a"),
            F.when(far, F.col("_b") + F.col("b")).otherwise(F.col("b")).alias("b")), "eom")
        if state.where(F.col("best").isNull()).isEmpty():
            kids = state.where(F.col("parent").isNotNull()).groupBy("run", F.col("parent").alias("c")).agg(F.sum("best").alias("below"))
            return state.select("run", "c").join(by_shuffle(kids), ["run", "c"], "left")


def select_clusters(tree: Condensed) -> DataFrame:
    """(run, c, parent, birth, chosen, eps, allow) with the chosen clusters of each run flagged."""
    given = F.array(*[F.struct(
        F.lit(i).alias("run"), F.lit(float(r.get("cluster_selection_epsilon", 0.0))).alias("eps"),
        F.lit(r.get("cluster_selection_method", "eom")).alias("method"), F.lit(bool(r.get("allow_single_cluster", False))).alias("allow"),
    ) for i, r in enumerate(tree.runs)])
    lookup = F.get(given, F.col("run"))
    nodes = tree.clusters.withColumn("_r", lookup).select(
        "run", "c", "parent", "birth", "stability", F.col("_r.eps").alias("eps"), F.col("_r.method").alias("method"), F.col("_r.allow").alias("allow"))
    kids = nodes.where(F.col("parent").isNotNull()).select("run", F.col("parent").alias("c")).distinct().withColumn("_inner", F.lit(True))
    nodes = materialize(nodes.join(by_shuffle(kids), ["run", "c"], "left").withColumn("inner", F.coalesce("_inner", F.lit(False))).drop("_inner"), "nodes")
    may = F.col("parent").isNotNull() | F.col("allow")
    leaf = nodes.where("method = 'leaf'").withColumn("chosen", ~F.col("inner") & may)
    parts = leaf.drop("stability")
    if any(r.get("cluster_selection_method", "eom") == "eom" for r in tree.runs):
        eom = nodes.where("method = 'eom'")
        below = _subtree_best(eom)
        rated = eom.join(by_shuffle(below), ["run", "c"]).withColumn("_take", may & ~F.coalesce(F.col("below") > F.col("stability"), F.lit(False)))
        rated = materialize(rated.drop("below"), "rated")
        covered = any_ancestor(rated, ["run"], "c", "parent", "_take")
        best = rated.join(by_shuffle(covered), ["run", "c"]).withColumn("chosen", F.col("_take") & ~F.col("below")).drop("_take", "below", "stability")
        parts = parts.unionByName(best)
    parts = materialize(parts, "selected")
    if not any(float(r.get("cluster_selection_epsilon", 0.0)) > 0 for r in tree.runs):
        return parts
    roots = parts.where(F.col("parent").isNull()).select("run", F.col("c").alias("parent"), F.lit(True).alias("_under"))
    size = F.when(F.col("birth") > 0, 1 / F.col("birth")).otherwise(F.lit(float("inf")))
    is_root = F.col("parent").isNull()
    marked = parts.join(by_shuffle(roots), ["run", "parent"], "left").select(
        "run", "c", "parent", "birth", "chosen", "eps", "allow", "inner", "method",
        (is_root | (F.coalesce("_under", F.lit(False)) & ~F.col("allow")) | (size > F.col("eps"))).alias("_stop"),
        (F.col("chosen") & ~is_root & (size < F.col("eps")) & (F.col("eps") > 0)).alias("_small"))
    marked = materialize(marked, "marked")
    lifted = jump(marked.select("run", "c", F.when(F.col("_stop"), F.col("c")).otherwise(F.col("parent")).alias("to")), ["run"], "c", "to")
    final = marked.where("chosen").join(by_shuffle(lifted), ["run", "c"]).select("run", F.when(F.col("_small"), F.col("to")).otherwise(F.col("c")).alias("c")).distinct()
    out = marked.drop("_stop", "_small", "chosen").join(by_shuffle(final.withColumn("_new", F.lit(True))), ["run", "c"], "left").withColumn(
        "chosen", F.coalesce("_new", F.lit(False))).drop("_new")
    out = materialize(out, "selected")
    if any(r.get("allow_single_cluster") for r in tree.runs):
        covered = any_ancestor(out, ["run"], "c", "parent", "chosen")
        out = out.join(by_shuffle(covered), ["run", "c"]).withColumn("chosen", F.col("chosen") & ~F.col("below")).drop("below")
    return out


def label_points(tree: MergeTree, condensed: Condensed) -> DataFrame:
    """(run, uid, by, label): clusters numbered by their smallest member id, outliers -1."""
    nodes = materialize(select_clusters(condensed), "nodes")
    end = jump(nodes.select("run", "c", F.when(F.col("chosen") | F.col("parent").isNull(), F.col("c")).otherwise(F.col("parent")).alias("home")), ["run"], "c", "home")
    info = nodes.select("run", F.col("c").alias("home"), "chosen", F.col("parent").isNull().alias("_root"), "eps")
    rows = condensed.exits.join(by_shuffle(end), ["run", "c"]).join(by_shuffle(info), ["run", "home"]).where("chosen")
    # A lone root keeps the points that stay to its end, or beyond the epsilon density if one is set.
    last = condensed_rows(condensed).groupBy("run", F.col("parent").alias("home")).agg(F.max("lambda_val").alias("_last"))
    needed = F.when(~F.col("_root"), F.lit(0.0)).when(F.col("eps") > 0, 1 / F.col("eps")).otherwise(F.col("_last"))
    kept = materialize(rows.join(by_shuffle(last), ["run", "home"], "left").where(F.col("lam") >= needed).select("run", "rep", "home"), "kept")
    by = list(tree.by)
    place = tree.members.groupBy("rep").agg(*[F.first(b).alias(b) for b in by], F.lit(0).alias("_all"))
    smallest = kept.join(by_shuffle(place), "rep").groupBy("run", *by, "home").agg(F.min("rep").alias("_lead"))
    numbered = rank_in_group(smallest, ["run", *by], [F.col("_lead")]).select("run", "home", (F.col("rank") - 1).cast("int").alias("label"))
    found = kept.join(by_shuffle(numbered), ["run", "home"]).select("run", "rep", "label")
    every = F.explode(F.array(*[F.lit(i) for i in range(len(condensed.runs))])).alias("run")
    return tree.members.select("rep", tree.uid, *by, every).join(by_shuffle(found), ["run", "rep"], "left").select(
        "run", tree.uid, *by, F.coalesce("label", F.lit(OUTLIER)).alias("label"))


def cluster(
    df: DataFrame, uid: str, vec: str, by: list[str] | None = None, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS, **params
) -> DataFrame:
    """(uid, by, label) of hierarchical density clusters; ``params`` override ``PIPE_DEFAULTS``."""
    unknown = set(params) - set(PIPE_DEFAULTS)
    if unknown:
        raise TypeError(f"unknown parameters {sorted(unknown)}")
    run = {**PIPE_DEFAULTS, **params}
    tree = build_tree(df, uid, vec, run["min_samples"], run["alpha"], by, cell_rows, block_rows)
    return label_points(tree, condense(tree, [run])).drop("run")


def cluster_graph(
    df: DataFrame, uid: str, vec: str, distance: Distance = "euclidean", neighbors: int = 15, descent: dict | None = None, **params,
) -> DataFrame:
    """(uid, label) of hierarchical density clusters over the neighbor graph by descent; ``params`` as for ``cluster``.

    Approximate: core distances and edges are those of the graph, whose parts, if it falls apart, meet at density zero. Work per row does
    not grow with the table, and any symmetric distance will do. ``descent`` goes to ``descent.neighbor_graph``.
    """
    unknown = set(params) - set(PIPE_DEFAULTS)
    if unknown:
        raise TypeError(f"unknown parameters {sorted(unknown)}")
    run = {**PIPE_DEFAULTS, **params}
    base = materialize(df.select(uid, vec), "input")
    graph = neighbor_graph(base, uid, vec, max(neighbors, run["min_samples"]), distance, **(descent or {}))
    points = materialize(weighted_points(graph.groups, graph.lists, run["min_samples"]), "points")
    edges = graph.lists.select(F.least("rep", "neighbor").alias("lo"), F.greatest("rep", "neighbor").alias("hi"), "distance").groupBy("lo", "hi").agg(
        F.min("distance").alias("distance"))
    members = materialize(base.join(graph.groups.select(vec, "rep"), vec).select("rep", uid), "members")
    tree = tree_from_edges(points, materialize(edges, "edges"), members, uid, run["alpha"])
    return label_points(tree, condense(tree, [run])).drop("run")


def sweep(df: DataFrame, uid: str, vec: str, runs: list[dict], cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(run, uid, label) for many parameter sets. Runs that share ``min_samples`` and ``alpha`` share one tree and one job."""
    full = [{**PIPE_DEFAULTS, **r} for r in runs]
    out = None
    for ms, alpha in sorted({(r["min_samples"], r["alpha"]) for r in full}):
        mine = [i for i, r in enumerate(full) if (r["min_samples"], r["alpha"]) == (ms, alpha)]
        tree = build_tree(df, uid, vec, ms, alpha, None, cell_rows, block_rows)
        names = F.array(*[F.lit(i) for i in mine])
        part = label_points(tree, condense(tree, [full[i] for i in mine])).withColumn("run", F.get(names, F.col("run")))
        out = part if out is None else out.unionByName(part)
    return out


def dbscan(
    df: DataFrame, uid: str, vec: str, eps: float = 0.3, min_samples: float = 5, weight: str | None = None,
    cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS, distance: Space = "l2",
) -> DataFrame:
    """(uid, label, core) of weighted DBSCAN; outliers -1, clusters numbered by their smallest core id.

    A point is core if the weights within ``eps``, its own included, reach ``min_samples``. A border
    point takes the smallest cluster in reach. ``distance`` may be a symmetric function (matrix, matrix) -> matrix.
    """
    base = materialize(df.select(uid, vec, (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("_w")), "input")
    groups = materialize(base.groupBy(vec).agg(F.min(uid).alias("rep"), F.sum("_w").alias("_w")), "groups")
    id_type = sql_type(groups, "rep")
    cells = build_cells(groups.select(F.col("rep").alias("_y"), vec, "_w"), "_y", vec, space=distance, cell_rows=cell_rows, block_rows=block_rows)

    def within(left: pd.DataFrame, right: pd.DataFrame):
        a, b = matrix(left[vec]), matrix(right[vec])
        if distance == "l2":
            d, error = rough_squared(a, b), rough_error(a, b)[:, None]
            near = d <= (eps * (1 + SLACK) + SLACK) ** 2 + error
            unsure = near & (d >= max(eps * (1 - SLACK) - SLACK, 0.0) ** 2 - error)
        else:
            d = rough(a, b, distance)
            near = d <= eps * (1 + SLACK) + SLACK
            unsure = near
        i, j = np.nonzero(unsure)
        near[i, j] = pair_distances(d, a, b, i, j, distance) <= eps
        return near

    def count(left: pd.DataFrame, right: pd.DataFrame, seen: dict) -> pd.DataFrame:
        return pd.DataFrame({"rep": left["rep"], "_sum": within(left, right) @ right["_w"].to_numpy(np.float64)})

    def total(found: pd.DataFrame) -> pd.DataFrame:
        return found.groupby("rep", as_index=False, sort=False, dropna=False)["_sum"].sum()

    def connect(left: pd.DataFrame, right: pd.DataFrame, seen: dict) -> pd.DataFrame:
        """Connections of these points as stars: one edge per point, not one per pair."""
        near = within(left, right)
        names = np.concatenate([sortable(left["rep"]), sortable(right["_y"])])
        order = names.argsort(kind="stable")
        place = np.empty(len(names), dtype=np.int64)
        place[order] = np.arange(len(names))
        lx, ly = place[: len(left)].copy(), place[len(left):].copy()
        big = len(names)
        while True:
            nx = np.minimum(lx, np.where(near, ly[None, :], big).min(1))
            ny = np.minimum(ly, np.where(near, nx[:, None], big).min(0))
            if (nx == lx).all() and (ny == ly).all():
                break
            lx, ly = nx, ny
        return pd.DataFrame({"a": names, "b": names[order][np.concatenate([lx, ly])]})

    def stars(found: pd.DataFrame) -> pd.DataFrame:
        """Stars of the same parts, one edge per point."""
        names, place = np.unique(np.r_[sortable(found["a"]), sortable(found["b"])], return_inverse=True)
        a, b = place[: len(found)], place[len(found):]
        low = np.arange(len(names))
        while True:
            new = low.copy()
            least_of = np.minimum(low[a], low[b])
            np.minimum.at(new, low[a], least_of)
            np.minimum.at(new, low[b], least_of)
            new = new[new[low]]
            if (new == low).all():
                break
            low = new
        linked = low != np.arange(len(names))
        return pd.DataFrame({"a": names[linked], "b": names[low[linked]]})

    def first_owner(found: pd.DataFrame) -> pd.DataFrame:
        return found.groupby("rep", as_index=False, sort=False, dropna=False)["component"].min()

    def adopt(left: pd.DataFrame, right: pd.DataFrame, seen: dict) -> pd.DataFrame:
        near = within(left, right)
        owner = sortable(right["component"])
        order = owner.argsort(kind="stable")
        hit = near[:, order]
        some = hit.any(1)
        return pd.DataFrame({"rep": left["rep"].to_numpy()[some], "component": owner[order][hit.argmax(1)[some]]})

    points, reach = groups.select("rep", vec), F.lit(eps)
    summed = probe(points, cells, "rep", vec, reach, count, f"rep {id_type}, _sum double", reduce=total).groupBy("rep").agg(F.sum("_sum").alias("_sum"))
    cores = materialize(summed.where(F.col("_sum") >= min_samples).select("rep"), "cores")
    core_rows = cells.rows.join(cores.withColumnRenamed("rep", "_y"), "_y", "left_semi")
    links = probe(points.join(cores, "rep", "left_semi"), cells, "rep", vec, reach, connect, f"a {id_type}, b {id_type}", rows=core_rows, reduce=stars)
    comps = materialize(components(links.distinct(), cores, "rep"), "components")
    owned = core_rows.join(comps.withColumnRenamed("rep", "_y"), "_y")
    border = probe(points.join(cores, "rep", "left_anti"), cells, "rep", vec, reach, adopt, f"rep {id_type}, component {id_type}", rows=owned, reduce=first_owner)
    border = border.groupBy("rep").agg(F.min("component").alias("component")).withColumn("core", F.lit(False))
    every = comps.withColumn("core", F.lit(True)).unionByName(border)
    numbered = rank_in_group(comps.select("component").distinct().withColumn("_all", F.lit(0)), ["_all"], [F.col("component")])
    labels = every.join(numbered.select("component", (F.col("rank") - 1).cast("int").alias("label")), "component").select("rep", "label", "core")
    rows = base.join(groups.select(vec, "rep"), vec).select(uid, "rep")
    return rows.join(labels, "rep", "left").select(uid, F.coalesce("label", F.lit(OUTLIER)).alias("label"), F.coalesce("core", F.lit(False)).alias("core"))
