"""Distance search over vectors, cut into cells around pivots.

Every indexed vector belongs to the cell of its nearest pivot. A probing vector visits only the
cells that can hold a vector within its search radius (triangle inequality and bisecting-plane
bounds, both exact). Neighboring cells travel together as a bundle. A bundle is split into blocks, and
its probes into chunks. A vector is shuffled once for every block or chunk it meets: blocks grow with the table,
so that their number stays at ``GRID`` a side, up to ``BLOCK_BYTES`` of vectors, which bounds a task. Inside a
task numpy computes the distances by tiles of at most ``TILE_ROWS`` x ``TILE_ROWS``, only for the cells that a vector
must visit; only results, never pairs, leave it.

A distance may also be a function (matrix, matrix) -> matrix of distances. Nothing is known about its triangles then: there is one
cell, whose blocks meet all chunks of probes.

The number of pivots is bounded by ``MAX_PIVOTS``; they and the cell radii are the only data that go
through the driver and to every task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.operators.ranking import rank_in_group, top_in_group
from topicloom.session import materialize, step_scope

BLOCK_ROWS = 2048  # blocks hold at least as many rows
BLOCK_BYTES = 64 << 20
GRID = 6
TILE_ROWS = 2048
VISIT_ROWS = 4096
PAIRS_AT_ONCE = 1 << 17
CELL_ROWS = 1024
MAX_PIVOTS = 1024
SLACK = 1e-7
#: "l2", "l1" or a function (matrix, matrix) -> matrix of distances.
Space = str | Callable[[np.ndarray, np.ndarray], np.ndarray]


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def sortable(column: pd.Series) -> np.ndarray:
    """Ids as an array numpy can sort; text in code-point order, as Spark sorts it."""
    values = column.to_numpy()
    return values.astype(str) if values.dtype == object else values


def rough_squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared euclidean distances by matrix product; good to about 1e-12 relative to the norms."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0)


def rough_error(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bound of the rounding errors of ``rough_squared`` per row of ``a``."""
    return 1e-12 * ((a * a).sum(1) + (b * b).sum(1).max(initial=0.0))


def rough_l1(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """City-block distances in single precision, and a bound of their errors per row of ``a``."""
    x, y = np.ascontiguousarray(a.T, dtype=np.float32), np.ascontiguousarray(b.T, dtype=np.float32)
    out = np.zeros((len(a), len(b)), np.float32)
    size = max(1, (1 << 16) // max(len(b), 1))  # strips that stay in the processor's cache
    for at in range(0, len(a), size):
        part, step = out[at : at + size], np.empty((min(size, len(a) - at), len(b)), np.float32)
        for d in range(len(x)):
            np.subtract(x[d, at : at + size, None], y[d], out=step)
            np.abs(step, out=step)
            part += step
    return out, 1.2e-7 * (len(x) + 4) * (np.abs(a).sum(1) + np.abs(b).sum(1).max(initial=0.0))


def rough(a: np.ndarray, b: np.ndarray, space: Space) -> np.ndarray:
    if callable(space):
        return np.array(space(a, b), np.float64)
    if space == "l2":
        return np.sqrt(rough_squared(a, b))
    out = np.empty((len(a), len(b)))
    for i in range(len(a)):
        out[i] = np.abs(b - a[i]).sum(1)
    return out


def pair_distances(d: np.ndarray, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, space: Space) -> np.ndarray:
    """Distances of the pairs (i, j) of rows of ``a`` and ``b``; a function's are those of its matrix ``d``."""
    if callable(space):
        return d[i, j]
    out = np.empty(len(i))
    for at in range(0, len(i), PAIRS_AT_ONCE):
        some = slice(at, at + PAIRS_AT_ONCE)
        out[some] = exact(a[i[some]], b[j[some]], space)
    return out


def exact(a: np.ndarray, b: np.ndarray, space: str) -> np.ndarray:
    """Distances of row pairs, the same number whichever side comes first."""
    diff = a - b
    return np.sqrt((diff * diff).sum(1)) if space == "l2" else np.abs(diff).sum(1)


@dataclass(frozen=True)
class Cells:
    """Indexed vectors: columns ``by``, uid, vec, cell and whatever else came along.

    ``bundle[cell]`` numbers the bundle of a cell; ``sizes`` counts the rows of each (by, bundle).
    """

    rows: DataFrame
    sizes: DataFrame
    pivots: np.ndarray
    radii: np.ndarray
    bundle: np.ndarray
    uid: str
    vec: str
    by: tuple[str, ...]
    space: Space
    block_rows: int


def _assign(pivots: np.ndarray, space: str) -> Callable[[Column], Column]:
    shared = pivots

    @F.pandas_udf("struct<cell:int,r:double>")
    def nearest_pivot(v: pd.Series) -> pd.DataFrame:
        d = rough(matrix(v), shared, space)
        cell = d.argmin(1)
        return pd.DataFrame({"cell": cell.astype("int32"), "r": d[np.arange(len(d)), cell]})

    return nearest_pivot


def _near_order(pivots: np.ndarray) -> np.ndarray:
    """Places of the pivots such that near ones follow each other: halves along the widest dimension."""
    if len(pivots) <= 2:
        return np.arange(len(pivots))
    half = pivots[:, np.ptp(pivots, axis=0).argmax()].argsort(kind="stable")
    low, high = half[: len(half) // 2], half[len(half) // 2 :]
    return np.r_[low[_near_order(pivots[low])], high[_near_order(pivots[high])]]


def _bundles(pivots: np.ndarray, sizes: np.ndarray, rows: int) -> np.ndarray:
    """The bundle of every cell: neighbors up to about ``rows`` rows."""
    order = _near_order(pivots)
    before = np.cumsum(sizes[order]) - sizes[order]
    out = np.empty(len(pivots), np.int64)
    out[order] = np.unique(before // rows, return_inverse=True)[1]
    return out


def _bundle_of(bundle: np.ndarray) -> Column:
    """The bundle of the column ``cell``."""
    return F.expr(f"element_at(array({', '.join(map(str, bundle))}), cell + 1)").alias("_bundle")


def build_cells(
    df: DataFrame, uid: str, vec: str, by: tuple[str, ...] = (), space: Space = "l2",
    cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS,
) -> Cells:
    """Index ``df``. Pivots are the rows with the smallest id hashes: a sample that is stable across runs."""
    rows = materialize(df, "vectors")
    count = rows.count()
    wanted = 1 if callable(space) else int(min(MAX_PIVOTS, max(1, -(-count // cell_rows))))
    picked = rows.orderBy(F.xxhash64(uid), uid).limit(wanted).select(vec).toPandas()
    pivots = matrix(picked[vec]) if len(picked) else np.zeros((1, 1))
    groups = rows.select(*by).distinct().count() if by else 1
    # The pairs of blocks of all groups together are about GRID x GRID.
    block = max(block_rows, min(int(count / (GRID * max(groups, 1) ** 0.5)) + 1, BLOCK_BYTES // (8 * pivots.shape[1])))
    bundle = np.zeros(1, np.int64)
    if len(pivots) == 1:
        tagged = rows.withColumn("cell", F.lit(0))
        radii = np.array([np.inf])
    else:
        tagged = materialize(
            rows.withColumn("_at", _assign(pivots, space)(F.col(vec))).select(*rows.columns, "_at.cell", "_at.r"), "cells"
        )
        found = {r["cell"]: r for r in tagged.groupBy("cell").agg(F.max("r").alias("r"), F.count(F.lit(1)).alias("n")).collect()}
        radii = np.array([found[i]["r"] if i in found else -np.inf for i in range(len(pivots))])
        bundle = _bundles(pivots, np.array([found[i]["n"] if i in found else 0 for i in range(len(pivots))]), block * max(groups, 1))
        tagged = tagged.drop("r")
    sizes = tagged.groupBy(*by, _bundle_of(bundle)).agg(F.count(F.lit(1)).alias("rows"))
    return Cells(tagged, sizes, pivots, radii, bundle, uid, vec, tuple(by), space, block)


def visited(cells: Cells, probes: int | None = None, skip: dict[int, object] | None = None, others: bool = False) -> Callable:
    """Function (vectors, radii, tags) -> which cells each vector must visit, and its nearest pivot.

    With ``probes`` these are its nearest cells. ``skip`` maps cells to a tag; a probe carrying that tag has no
    business there. ``others`` leaves out the nearest cell.
    """
    pivots, radii, space = cells.pivots, cells.radii, cells.space
    gaps = np.zeros((1, 1)) if len(pivots) == 1 else rough(pivots, pivots, space)
    live = np.isfinite(radii) | (len(pivots) == 1)

    def visits(a: np.ndarray, radius: np.ndarray, tags: list) -> tuple[np.ndarray, np.ndarray]:
        if len(pivots) == 1:
            return np.ones((len(a), 1), bool), np.zeros(len(a), np.int64)
        d = rough(a, pivots, space)
        own = d.argmin(1)
        if probes is not None:
            order = np.where(live[None, :], d, np.inf).argsort(1, kind="stable")[:, : min(probes, int(live.sum()))]
            keep = np.zeros(d.shape, bool)
            keep[np.arange(len(d))[:, None], order] = True
            return keep, own
        reach = radius * (1 + SLACK) + SLACK
        low = d - radii[None, :]
        if space == "l2":
            gap = gaps[own]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (d**2 - d[np.arange(len(d)), own][:, None] ** 2) / (2 * gap)
            low = np.maximum(low, np.where(gap > 0, plane, 0.0))
        keep = (low <= reach[:, None]) & live[None, :]
        if others:
            keep[np.arange(len(d)), np.where(live[None, :], d, np.inf).argmin(1)] = False
        if skip:
            for cell, value in skip.items():
                keep[:, cell] &= np.array([t != value for t in tags], dtype=bool)
        return keep, own

    return visits


def tiles(keep: np.ndarray, own: np.ndarray, cell: np.ndarray, size: int = TILE_ROWS):
    """Yields per tile of probes (rows, parts): ``parts`` are (rows of that tile, indexed rows) that must meet.

    ``keep`` says which cells a probe visits, ``own`` its nearest one; ``cell`` is that of every indexed row. Indexed rows that the same probes
    visit are taken together.
    """
    right = cell.argsort(kind="stable")
    starts = np.r_[0, np.flatnonzero(np.diff(cell[right])) + 1, len(right)]
    present = cell[right[starts[:-1]]]
    left = own.argsort(kind="stable")
    for at in range(0, len(left), size):
        rows = left[at : at + size]
        groups: dict[bytes, list[int]] = {}
        for c, pattern in enumerate(np.ascontiguousarray(keep[np.ix_(rows, present)].T)):
            if pattern.any():
                groups.setdefault(pattern.tobytes(), []).append(c)
        parts = []
        for pattern, some in groups.items():
            asking = np.flatnonzero(np.frombuffer(pattern, bool))
            met = np.concatenate([right[starts[c] : starts[c + 1]] for c in some])
            parts += [(asking, met[i : i + size]) for i in range(0, len(met), size)]
        if parts:
            yield rows, parts


def probe(
    x: DataFrame, cells: Cells, uid: str, vec: str, radius: Column, fn: Callable, schema: str,
    probes: int | None = None, skip: dict[int, object] | None = None, tag: Column | None = None, rows: DataFrame | None = None,
    others: bool = False, reduce: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
) -> DataFrame:
    """Run ``fn(left, right, seen)`` on every two parts of a chunk of probes and a block that must meet.

    ``rows`` replaces the indexed rows by a version with more columns. ``seen`` is a dict that lasts for the tile of probes from which
    ``left`` is taken; ``left.index`` are the places in it, ``seen["rows"]`` is its length. ``reduce`` shortens the results of a tile and then of a task.
    """
    by, size = list(cells.by), cells.block_rows
    visits = visited(cells, probes, skip, others)
    bundle = cells.bundle
    bundles = int(bundle.max()) + 1

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def to_bundles(v: pd.Series, reach: pd.Series, tags: pd.Series) -> pd.Series:
        keep, _ = visits(matrix(v), reach.to_numpy(dtype=np.float64), tags.tolist())
        hit = np.zeros((len(keep), bundles), bool)
        for b in range(bundles):
            hit[:, b] = keep[:, bundle == b].any(1)
        return pd.Series([np.flatnonzero(h).astype("int32").tolist() for h in hit])

    tag = F.lit(None).cast("string") if tag is None else tag.cast("string")
    asking = x.withColumn("_reach", radius.cast("double")).withColumn("_tag", tag)
    placed = materialize(asking.withColumn("_bundles", to_bundles(F.col(vec), "_reach", "_tag")), "probes")
    routed = placed.withColumn("_bundle", F.explode("_bundles")).drop("_bundles")
    asked = routed.groupBy(*by, "_bundle").agg(F.count(F.lit(1)).alias("_probes"))
    grid = materialize(cells.sizes.join(asked, [*by, "_bundle"]).select(
        *by, "_bundle", F.ceil(F.col("rows") / size).cast("int").alias("_blocks"),
        F.ceil(F.col("_probes") / size).cast("int").alias("_chunks"),
    ), "grid")
    key = [*by, "_bundle", "_block", "_chunk"]
    left = (
        routed.join(grid, [*by, "_bundle"]).withColumn("_chunk", F.pmod(F.xxhash64(uid), "_chunks").cast("int"))
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    )
    right = (
        (cells.rows if rows is None else rows).withColumn("_bundle", _bundle_of(bundle)).join(grid, [*by, "_bundle"])
        .withColumn("_block", F.pmod(F.xxhash64(cells.uid), "_blocks").cast("int"))
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    )
    # Both sides may read the same tables; new column identities keep them apart in the co-group.
    right = right.drop("_blocks", "_chunks")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    left = left.drop("_blocks", "_chunks")
    empty = pd.DataFrame({f.name: [] for f in T._parse_datatype_string(schema).fields})

    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return empty
        vectors, reach, tags = matrix(a[vec]), a["_reach"].to_numpy(dtype=np.float64), a["_tag"].tolist()
        # Distances to all pivots are held for some rows at a time.
        some = [slice(at, at + VISIT_ROWS) for at in range(0, len(a), VISIT_ROWS)]
        keep, own = map(np.concatenate, zip(*[visits(vectors[i], reach[i], tags[i]) for i in some]))
        found = []
        for some, parts in tiles(keep, own, b["cell"].to_numpy()):
            tile, seen = a.iloc[some].reset_index(drop=True), {"rows": len(some)}
            out = pd.concat([fn(tile.iloc[i], b.iloc[j], seen) for i, j in parts], ignore_index=True)
            found.append(out if reduce is None else reduce(out))
        if not found:
            return empty
        out = pd.concat(found, ignore_index=True)
        return out if reduce is None or len(found) == 1 else reduce(out)

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(both, schema)


def sql_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _best(
    left: pd.DataFrame, right: pd.DataFrame, x_uid: str, y_uid: str, x_vec: str, y_vec: str, space: Space, same: bool, cut: np.ndarray,
):
    """The ``_k`` nearest right rows of every left row within ``_radius`` and ``cut``: index arrays, places and distances."""
    a, b = matrix(left[x_vec]), matrix(right[y_vec])
    reach = np.minimum(left["_radius"].to_numpy(dtype=np.float64), cut)
    k = left["_k"].to_numpy(dtype=np.int64)
    slack = lambda x: x * (1 + SLACK) + SLACK
    if callable(space):
        d, error, power = rough(a, b, space), np.zeros(len(a)), 1
    elif space == "l1":
        (d, error), power = rough_l1(a, b), 1
    else:
        d, error, power = rough_squared(a, b), rough_error(a, b), 2
    near = d <= (slack(reach) ** power + error)[:, None]
    want = np.minimum(k + same, len(b))
    most = int(want.max())
    if most < len(b) and np.count_nonzero(near) > 4 * most * len(a):
        limit = np.partition(d, most - 1, axis=1)[:, :most].astype(np.float64)
        limit.sort(axis=1)
        far = limit[np.arange(len(a)), want - 1]
        near &= d <= (slack(far ** (1 / power)) ** power + 2 * error)[:, None]
    i, j = np.nonzero(near)
    finite = np.isfinite(d[i, j])
    if same:
        finite &= left[x_uid].to_numpy()[i] != right[y_uid].to_numpy()[j]
    i, j = i[finite], j[finite]
    dist = pair_distances(d, a, b, i, j, space)
    inside = dist <= reach[i]
    i, j, dist = i[inside], j[inside], dist[inside]
    order = np.lexsort((sortable(right[y_uid])[j], dist, i))
    i, j, dist = i[order], j[order], dist[order]
    first = np.r_[0, np.flatnonzero(np.diff(i)) + 1] if len(i) else np.array([], dtype=int)
    place = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) if len(i) else i
    keep = place < k[i]
    return a, b, i[keep], j[keep], place[keep], dist[keep]


def metric_value(a: np.ndarray, b: np.ndarray, dist: np.ndarray, metric: Space) -> np.ndarray:
    if metric == "cosine":
        return 1.0 - (a * b).sum(1)
    if metric == "angular":
        return np.arccos(np.clip((a * b).sum(1), -1.0, 1.0)) / np.pi
    return dist * dist if metric == "sqeuclidean" else dist


def knn(
    x: DataFrame, cells: Cells, uid: str, vec: str, k: int | Column, metric: Space = "euclidean", same: bool = False,
    probes: int | None = None,
) -> DataFrame:
    """The ``k`` nearest indexed rows of every x row: (by, uid, neighbor, distance, value).

    Exact unless ``probes`` limits the search to the nearest cells. ``same`` leaves out the row
    itself. First each row looks in its own cell, which bounds its radius; then in every other cell
    that radius reaches. ``k`` may be a column.
    """
    fixed = isinstance(k, int)
    space, y_uid, y_vec, by = cells.space, cells.uid, cells.vec, list(cells.by)
    wide = x.select(*by, uid, vec, (F.lit(k) if fixed else k).cast("long").alias("_k"), F.lit(float("inf")).alias("_radius"))
    fields = [f"{c} {sql_type(x, c)}" for c in [*by, uid]]
    schema = ", ".join([*fields, "_k long", f"neighbor {sql_type(cells.rows, y_uid)}", "distance double", "value double"])

    def local(left: pd.DataFrame, right: pd.DataFrame, seen: dict) -> pd.DataFrame:
        right = right.rename(columns={y_uid: "_y", y_vec: "_yv"})
        at, k_here = left.index.to_numpy(), left["_k"].to_numpy(np.int64)
        most = int(k_here.max())
        # The best distances so far narrow the search in the parts to come.
        best = seen.get("best", np.full((seen["rows"], most), np.inf))
        if best.shape[1] < most:
            best = np.c_[best, np.full((seen["rows"], most - best.shape[1]), np.inf)]
        a, b, i, j, place, dist = _best(left, right, uid, "_y", vec, "_yv", space, same, best[at, k_here - 1])
        new = np.full((len(left), best.shape[1]), np.inf)
        new[i, place] = dist
        best[at] = np.sort(np.c_[best[at], new], axis=1)[:, : best.shape[1]]
        seen["best"] = best
        out = left[[*by, uid, "_k"]].iloc[i].reset_index(drop=True)
        out["neighbor"] = right["_y"].to_numpy()[j]
        out["distance"] = dist
        out["value"] = metric_value(a[i], b[j], dist, metric)
        return out

    def nearest_of_tile(found: pd.DataFrame) -> pd.DataFrame:
        """The best ``_k`` of every row."""
        row = pd.factorize(found[uid])[0]
        order = np.lexsort((sortable(found["neighbor"]), found["distance"].to_numpy(), row))
        row = row[order]
        first = np.r_[0, np.flatnonzero(np.diff(row)) + 1] if len(row) else row
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)])) if len(row) else row
        return found.iloc[order[place < found["_k"].to_numpy(np.int64)[order]]]

    order = [F.col("distance"), F.col("neighbor")]

    def kept(found: DataFrame) -> DataFrame:
        if fixed:
            return top_in_group(found, [*by, uid], order, k)
        ranked = rank_in_group(found, [*by, uid], order)
        return ranked.join(x.select(*by, uid, k.cast("long").alias("_k")), [*by, uid]).where("rank <= _k").drop("_k")

    near = lambda: kept(probe(wide, cells, uid, vec, F.col("_radius"), local, schema, probes=probes or 1, reduce=nearest_of_tile).drop("_k"))
    if len(cells.pivots) == 1 or probes is not None:
        return near()
    with step_scope(x.sparkSession):
        first = materialize(near(), "own-cell", kept=True)
    bound = first.groupBy(*by, uid).agg(F.max("distance").alias("_far"), F.count(F.lit(1)).alias("_got"))
    bounded = wide.drop("_radius").join(bound, [*by, uid], "left").withColumn(
        "_radius", F.when(F.col("_got") >= F.col("_k"), F.col("_far")).otherwise(F.lit(float("inf")))
    ).drop("_far", "_got")
    second = probe(bounded, cells, uid, vec, F.col("_radius"), local, schema, others=True, reduce=nearest_of_tile).drop("_k")
    return kept(first.drop("rank").unionByName(second))
