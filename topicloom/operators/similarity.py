"""Nearest rows, similar pairs, search by a stored row, silhouettes."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions import vectors as vx
from topicloom.operators.cells import BLOCK_ROWS, CELL_ROWS, SLACK, Space, build_cells, knn, matrix, probe, sortable, sql_type
from topicloom.operators.ranking import top_in_group
from topicloom.session import materialize

SPACES = {"cosine": "l2", "angular": "l2", "euclidean": "l2", "sqeuclidean": "l2", "cityblock": "l1"}
QUERY_BLOCK = 1000


def collapse(df: DataFrame, uid: str, vec: str, by: list[str] | None = None) -> DataFrame:
    """One row per distinct vector: (by, rep, vec, copies), ``rep`` being the smallest id.

    Copies of one vector may be a third of all rows. They are counted before the shuffle and
    searched once; comparing them with each other would be quadratic.
    """
    return df.groupBy(*(by or []), vec).agg(F.min(uid).alias("rep"), F.count(F.lit(1)).alias("copies"))


def members(df: DataFrame, groups: DataFrame, uid: str, vec: str, by: list[str] | None = None) -> DataFrame:
    """(rep, id) of every row."""
    return df.select(*(by or []), uid, vec).join(groups.select(*(by or []), vec, "rep"), [*(by or []), vec]).select("rep", uid)


def _space(metric: Space) -> Space:
    if callable(metric):
        return metric
    if metric not in SPACES:
        raise ValueError(f"unknown metric {metric!r}")
    return SPACES[metric]


def nearest(
    x: DataFrame, y: DataFrame, uid: str, vec: str, top_k: int, metric: Space = "cosine", include_self: bool = True,
    probes: int | None = None, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``top_k`` y rows nearest to every x row: (uid, neighbor, rank, distance).

    ``cosine`` is ``1 - x.y`` and ``angular`` is ``acos(x.y)/pi``; both expect unit vectors. The full
    distance matrix of the all-pairs form is never made: ask for the neighbors needed. ``probes``
    searches only that many cells per row, which is approximate. ``metric`` may be a symmetric function
    (matrix, matrix) -> matrix of distances; every row then meets every block of rows.
    """
    space = _space(metric)
    wanted = top_k if include_self else top_k + 1
    x_groups = materialize(collapse(x, uid, vec), "x-groups")
    y_groups = x_groups if y is x else materialize(collapse(y, uid, vec), "y-groups")
    cells = build_cells(y_groups.select(F.col("rep").alias("_y"), vec), "_y", vec, space=space, cell_rows=cell_rows, block_rows=block_rows)
    found = knn(x_groups.select("rep", vec), cells, "rep", vec, wanted, metric, probes=probes).drop("rank")
    return with_copies(found, x, x_groups, y, y_groups, uid, vec, wanted, top_k, include_self)


def with_copies(
    found: DataFrame, x: DataFrame, x_groups: DataFrame, y: DataFrame, y_groups: DataFrame, uid: str, vec: str, wanted: int, top_k: int, include_self: bool,
) -> DataFrame:
    """(uid, neighbor, rank, distance) of all rows, from (rep, neighbor, distance, value) between distinct vectors."""
    some = top_in_group(members(y, y_groups, uid, vec), ["rep"], [F.col(uid)], wanted, "_n").drop("_n")
    some = some.select(F.col("rep").alias("neighbor"), F.col(uid).alias("_member"))
    spread = found.join(some, "neighbor").select("rep", F.col("_member").alias("neighbor"), "distance", "value")
    order = [F.col("distance"), F.col("neighbor")]
    per_group = top_in_group(spread, ["rep"], order, wanted).drop("rank")
    rows = members(x, x_groups, uid, vec).join(per_group, "rep")
    if not include_self:
        rows = rows.where(F.col("neighbor") != F.col(uid))
    return top_in_group(rows, [uid], order, top_k).select(uid, "neighbor", "rank", F.col("value").alias("distance"))


def centroids(df: DataFrame, label: str, vec: str) -> DataFrame:
    """(label, centroid, size): per-dimension means, summed before the shuffle."""
    dim = len(df.select(vec).first()[0])
    return df.groupBy(label).agg(vx.mean_vectors(F.col(vec), dim).alias("centroid"), F.count(F.lit(1)).alias("size"))


def nearest_to_centroids(
    x: DataFrame, y: DataFrame, uid: str, vec: str, label: str, top_k: int, metric: str = "cosine",
    cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """For every cluster of x the ``ceil(size / top_k)`` y rows nearest to its center. Outliers (-1) are no cluster."""
    space = _space(metric)
    middle = materialize(centroids(x.where(F.col(label) >= 0), label, vec), "centroids")
    probe_rows = middle.select(label, F.col("centroid").alias(vec), F.ceil(F.col("size") / top_k).alias("_want"))
    cells = build_cells(y.select(F.col(uid).alias("_y"), vec), "_y", vec, space=space, cell_rows=cell_rows, block_rows=block_rows)
    found = knn(probe_rows, cells, label, vec, F.col("_want"), metric)
    return found.select(label, "neighbor", "rank", F.col("value").alias("distance"))


def similar_pairs(
    df: DataFrame, uid: str, vec: str, per_row: int = 100, at_least: float | None = None, limit: int | None = None,
    cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Best-scoring pairs (score, a, b), a < b, from the ``per_row`` most similar rows of each row.

    A top-k search: pairs beyond the ``per_row`` best of both rows are not looked for, and ``at_least`` only
    filters what was found. It finds every pair above a score if no row has more than ``per_row`` of them.
    """
    found = nearest(df, df, uid, vec, per_row, "cosine", include_self=False, cell_rows=cell_rows, block_rows=block_rows)
    pairs = found.select(
        F.least(uid, "neighbor").alias("a"), F.greatest(uid, "neighbor").alias("b"), (1 - F.col("distance")).alias("score")
    ).groupBy("a", "b").agg(F.max("score").alias("score"))
    if at_least is not None:
        pairs = pairs.where(F.col("score") >= at_least)
    return pairs if limit is None else pairs.orderBy(F.col("score").desc(), "a", "b").limit(limit)


def pairs_above(
    df: DataFrame, uid: str, vec: str, at_least: float, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """All pairs of distinct unit vectors with a cosine of ``at_least``: (a, b, score, copies_a, copies_b), a < b.

    A vector stands for all rows that hold it, under the smallest of their ids: ``copies_*`` are their numbers and ``classes`` names them, so copies
    are never expanded into pairs. The radius that a row searches follows from the score, so only cells within it are visited. No cap: the
    result is as large as there are pairs. Null vectors have no pairs.
    """
    groups = materialize(collapse(df.where(F.col(vec).isNotNull()), uid, vec), "groups")
    kind = sql_type(groups, "rep")
    cells = build_cells(groups.select(F.col("rep").alias("_y"), vec, "copies"), "_y", vec, cell_rows=cell_rows, block_rows=block_rows)
    reach = max(2.0 - 2.0 * at_least, 0.0) ** 0.5

    def above(left: pd.DataFrame, right: pd.DataFrame, seen: dict) -> pd.DataFrame:
        a, b = matrix(left[vec]), matrix(right[vec])
        x, y = sortable(left["rep"]), sortable(right["_y"])
        near = (a @ b.T >= at_least - SLACK) & (x[:, None] < y[None, :])
        i, j = np.nonzero(near)
        score = (a[i] * b[j]).sum(1)
        i, j, score = i[score >= at_least], j[score >= at_least], score[score >= at_least]
        return pd.DataFrame({
            "a": left["rep"].to_numpy()[i], "b": right["_y"].to_numpy()[j], "score": score,
            "copies_a": left["copies"].to_numpy()[i], "copies_b": right["copies"].to_numpy()[j]})

    schema = f"a {kind}, b {kind}, score double, copies_a long, copies_b long"
    return probe(groups.select("rep", vec, "copies"), cells, "rep", vec, F.lit(reach), above, schema)


def classes(df: DataFrame, uid: str, vec: str) -> DataFrame:
    """(uid, rep): the smallest id that holds the same vector, for every row."""
    return members(df, collapse(df, uid, vec), uid, vec).select(uid, "rep")


def search(df: DataFrame, uid: str, vec: str, ids: list, top_k: int) -> DataFrame:
    """Rows most similar to the stored rows ``ids``: (query, uid, score, rank). The ids are taken in blocks, each one scan."""

    def block(some: list) -> DataFrame:
        stored = df.where(F.col(uid).isin(*some)).select(uid, vec).collect()
        queries = F.array(*[F.struct(F.lit(r[0]).alias("query"), F.array(*[F.lit(float(v)) for v in r[1]]).alias("q")) for r in stored])
        return df.select(uid, vec, F.explode(queries).alias("_q")).select(
            F.col("_q.query").alias("query"), uid, vx.dot(F.col(vec), F.col("_q.q")).alias("score"))

    scored = functools.reduce(DataFrame.unionByName, [block(ids[i : i + QUERY_BLOCK]) for i in range(0, len(ids), QUERY_BLOCK)])
    return top_in_group(scored, ["query"], [F.round("score", 9).desc(), F.col(uid)], top_k)


def most_similar_words(words: DataFrame, positive: list[str], top_k: int = 10) -> DataFrame:
    """Words closest to the mean of the unit vectors of the given words, which are left out."""
    given = words.where(F.col("word").isin(*positive)).select(vx.normalize(F.col("vector")).alias("v")).collect()
    if not given:
        raise KeyError(f"none of {positive} has a vector")
    mean = [sum(r["v"][i] for r in given) / len(given) for i in range(len(given[0]["v"]))]
    target = vx.normalize(F.array(*[F.lit(float(v)) for v in mean]))
    score = vx.dot(vx.normalize(F.col("vector")), target)
    rest = words.where(~F.col("word").isin(*positive)).select("word", score.alias("score"))
    return rest.orderBy(F.round("score", 9).desc(), "word").limit(top_k)


def silhouette_rows(df: DataFrame, uid: str, vec: str, label: str, measure: str = "cosine") -> DataFrame:
    """Silhouette of every row for ``cosine`` or ``sqeuclidean`` distance; outliers count as a cluster.

    The mean distance of a row to a cluster needs no pairs: for squared euclidean it is the squared
    distance to the cluster mean plus the cluster's spread, and cosine distance of unit vectors is
    half of that. Written as one more coordinate, the nearest other cluster is a nearest-row search.
    """
    if measure not in ("cosine", "sqeuclidean"):
        raise ValueError("measure must be cosine or sqeuclidean")
    rows = df.select(uid, label, (vx.normalize(F.col(vec)) if measure == "cosine" else F.col(vec).cast("array<double>")).alias("_v"))
    dim = len(rows.select("_v").first()[0])
    square = F.aggregate("_v", F.lit(0.0), lambda s, v: s + v * v)
    stats = rows.groupBy(label).agg(
        vx.mean_vectors(F.col("_v"), dim).alias("_m"), F.avg(square).alias("_q"), F.count(F.lit(1)).alias("_n")
    )
    spread = F.sqrt(F.greatest(F.col("_q") - vx.dot(F.col("_m"), F.col("_m")), F.lit(0.0)))
    centers = materialize(stats.select(F.col(label).alias("_c"), F.concat("_m", F.array(spread)).alias("_v"), "_n"), "centers")
    cells = build_cells(centers.select("_c", "_v"), "_c", "_v")
    points = materialize(rows.select(uid, label, F.concat("_v", F.array(F.lit(0.0))).alias("_v")), "points")
    two = knn(points.select(uid, "_v"), cells, uid, "_v", 2, "sqeuclidean").drop("rank")
    own = points.join(centers.select(F.col("_c").alias(label), F.col("_v").alias("_cv"), "_n"), label).select(
        uid, label, "_n", vx.distance(F.col("_v"), F.col("_cv"), "sqeuclidean").alias("_own")
    )
    other = two.join(own.select(uid, label), uid).where(F.col("neighbor") != F.col(label)).groupBy(uid).agg(F.min("value").alias("_b"))
    a = F.try_divide(F.col("_own") * F.col("_n"), F.col("_n") - 1)
    s = F.when(F.col("_n") > 1, F.coalesce(F.try_divide(F.col("_b") - a, F.greatest(a, F.col("_b"))), F.lit(0.0))).otherwise(0.0)
    return own.join(other, uid).select(uid, label, s.alias("silhouette"))


def silhouette(df: DataFrame, uid: str, vec: str, label: str, measure: str = "cosine") -> DataFrame:
    """Mean silhouette of all rows."""
    return silhouette_rows(df, uid, vec, label, measure).agg(F.avg("silhouette").alias("silhouette"))

