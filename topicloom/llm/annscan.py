"""Approximate nearest neighbours by inner product: probed lists scanned in column blocks, candidates abandoned early.

1. With one more column, sqrt(M^2 - |x|^2) for rows (M the largest norm) and 0 for queries, nearest by distance is nearest by inner
   product. All vectors are turned by one random rotation, after which any d columns tell about the whole distance.
2. Centers, fitted on a bounded sample, cut the rows into lists; every row is in one. A query probes the nearest lists until
   they hold a share of all rows. The share is calibrated on the sample, so that ``target_recall`` of the neighbours found by
   brute force there lie in the probed lists; where lists tell little about nearness, it comes near 1.
3. A list is scanned by column blocks: after d of D columns, a candidate whose partial distance, scaled by D/d, is above
   (1 + eps/sqrt(d)) times the distance of the query's k-th nearest so far fails a test of the hypothesis that it belongs to the
   nearest, and is abandoned. The first bound comes from the sample, whose rows are candidates too.
4. Survivors get their exact inner product in double precision on the original vectors.

Lists are cut into blocks of rows and of queries, so that a crowded list makes many tasks; a task holds one block of each.
Broadcast are the centers and the sample: at most ``sample_rows`` vectors, whatever the table holds.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicloom.llm.common import pick
from topicloom.session import materialize

#: Columns per block, and the width of the test: larger abandons less.
COLUMNS, EPS = 16, 2.1
ROWS_PER_BLOCK, QUERIES_PER_BLOCK = 8192, 1024


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def inner(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the same order wherever a row stands."""
    return (rows * query).sum(axis=1)


def fit_centers(sample: np.ndarray, lists: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centers of the sample by k-means, from distinct rows."""
    rows = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    centers = rows[rng.choice(len(rows), min(lists, len(rows)), replace=False)]
    for _ in range(rounds):
        nearest = nearest_center(sample, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, sample)
        counts = np.bincount(nearest, minlength=len(centers))
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    return centers


def center_distances(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances, less the row's own square."""
    return (centers * centers).sum(axis=1) - 2 * rows @ centers.T


def nearest_center(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return center_distances(rows, centers).argmin(axis=1)


def needed_share(sample: np.ndarray, space: Space, centers: np.ndarray, k: int, target: float, queries: int = 512) -> float:
    """Share of the rows in the nearest lists that holds ``target`` of the ``k`` nearest rows, over the first rows of the sample."""
    lists = nearest_center(space.rows(sample), centers)
    counts = np.bincount(lists, minlength=len(centers))
    order = np.argsort(center_distances(space.queries(sample[:queries]), centers), axis=1)
    reached = np.cumsum(counts[order], axis=1) / len(sample)
    place = np.argsort(order, axis=1)  # of each list in each query's order
    needed = []
    for i in range(len(order)):
        scores = inner(sample, sample[i])
        scores[i] = -np.inf
        nearest = np.argsort(-scores, kind="stable")[: min(k, len(sample) - 1)]
        needed.append(reached[i, place[i, lists[nearest]]])
    needed = np.concatenate(needed) if needed else np.ones(1)
    return float(np.quantile(needed, target)) if len(needed) else 1.0


class Space:
    """Rotation and norm that all tasks share."""

    def __init__(self, dim: int, norm: float, seed: int):
        self.square = norm * norm
        self.rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim + 1, dim + 1)))[0]

    def rows(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.square - (x * x).sum(axis=1)))
        return np.column_stack((x, rest)) @ self.rotation

    def queries(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack((q, np.zeros(len(q)))) @ self.rotation

    def distance(self, q: np.ndarray, score: float) -> float:
        """Squared distance between a query and a row with that inner product."""
        return float(q @ q) + self.square - 2 * score


def scan(query: np.ndarray, rows: list[np.ndarray], bound: float) -> np.ndarray:
    """Numbers of the rows that no test abandons; ``rows``: the list's column blocks, ``bound``: squared distance to beat."""
    dim = sum(b.shape[0] for b in rows)
    alive = np.arange(rows[0].shape[1])
    partial = np.zeros(len(alive))
    done = 0
    for block in rows:
        part = block if len(alive) == block.shape[1] else block[:, alive]
        differ = part - query[done : done + block.shape[0], None]
        partial += np.einsum("ij,ij->j", differ, differ)
        done += block.shape[0]
        # Tests need some slack for rounding where the whole distance is known.
        limit = bound * (1 + 1e-9) + 1e-9 if done == dim else bound * done / dim * (1 + EPS / math.sqrt(done)) ** 2
        keep = partial <= limit
        if not keep.all():
            alive, partial = alive[keep], partial[keep]
        if len(alive) == 0:
            break
    return alive


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def search(
    vectors: DataFrame, k: int = 20, query_mod: int = 20, target_recall: float = 0.96, sample_rows: int = 8192, seed: int = 5,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``query_mod``, nearest first.

    Candidates are all rows with another id. Rows whose vector is null, empty, zero, of another length than the most common one, or
    holds null or non-finite components take no part, nor do null ids. Repeated rows are candidates each; ties go to the
    smaller id. Fewer than k candidates are all returned; an empty table gives no rows. Other columns are ignored.
    """
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    base = pick(vectors, vec_id=id_col, vector=vector_col).withColumn("vec_id", F.col("vec_id").cast("long"))
    base = base.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(~bad & F.exists(v, lambda x: x != 0))
    sizes = base.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return base.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = sizes
    base = base.where(F.size("vector") == dim).select("vec_id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    spark = base.sparkSession
    norm = math.sqrt(base.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).first()[0])
    chosen = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toArrow()  # bounded
    chosen_ids, chosen_rows = chosen.column("vec_id").to_numpy(), matrix(chosen.column("vector"))
    space = Space(dim, norm, seed)
    lists = max(1, min(len(chosen_rows) // 8, math.isqrt(total) // 2))
    centers = fit_centers(space.rows(chosen_rows), lists, seed)
    # As many neighbours of the sample as lie within the k-th neighbour of the whole table.
    probe_share = needed_share(chosen_rows, space, centers, max(1, -(-k * len(chosen_rows) // total)), target_recall)
    shared = spark.sparkContext.broadcast((space, centers, chosen_ids, chosen_rows))

    def placed(batches):
        space, centers, _, _ = shared.value
        for batch in batches:
            if batch.num_rows:
                at = nearest_center(space.rows(matrix(batch.column("vector"))), centers)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch.column("vec_id"), batch.column("vector")], ["list", "vec_id", "vector"])

    rows = materialize(base.mapInArrow(placed, "list int, vec_id long, vector array<double>"), "lists")
    held = rows.groupBy("list").count().collect()  # one number per list
    counts = np.zeros(len(centers), np.int64)
    for r in held:
        counts[r["list"]] = r["count"]
    goal = max(probe_share * total, min(total, 4 * (k + 1)))

    def probed(batches):
        """Per query: the nearest rows of the sample (list -1), then a row for each list to probe with the bound to beat."""
        space, centers, ids, sample = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            q = matrix(batch.column("vector"))
            order = np.argsort(center_distances(space.queries(q), centers), axis=1)
            reached = np.cumsum(counts[order], axis=1)
            for i, query_id in enumerate(batch.column("vec_id").to_numpy()):
                scores = inner(sample, q[i])
                other = np.flatnonzero(ids != query_id)
                top = other[best(ids[other], scores[other], k)]
                bound = space.distance(q[i], scores[top[-1]]) if len(top) == k else math.inf
                probe = order[i, : int(np.searchsorted(reached[i], goal)) + 1]
                probe = probe[counts[probe] > 0]
                n = len(top)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate((np.full(n, -1), probe)).astype(np.int32)), pa.array(np.full(n + len(probe), query_id)),
                    pa.array([None] * n + [q[i]] * len(probe), pa.list_(pa.float64())), pa.array(np.full(n + len(probe), bound)),
                    pa.array(ids[top].tolist() + [None] * len(probe), pa.int64()), pa.array(scores[top].tolist() + [None] * len(probe), pa.float64()),
                ], ["list", "query_id", "query", "bound", "vec_id", "score"])

    # Bounded by the sample: a query asks with its lists, its bound and its first candidates.
    asked = materialize(rows.where(F.col("vec_id") % query_mod == 0).select("vec_id", "vector").mapInArrow(
        probed, "list int, query_id long, query array<double>, bound double, vec_id long, score double"), "asked")
    first = asked.where("list = -1").select("query_id", "vec_id", "score")
    asks = asked.where("list >= 0").select("list", "query_id", "query", "bound")
    busy = {r["list"]: r["count"] for r in asks.groupBy("list").count().collect()}
    cuts = spark.createDataFrame(
        [(r["list"], -(-r["count"] // ROWS_PER_BLOCK), max(1, -(-busy.get(r["list"], 0) // QUERIES_PER_BLOCK))) for r in held], "list int, row_blocks int, query_blocks int")
    cuts = F.broadcast(cuts)  # one row per list
    left = rows.join(cuts, "list").withColumn("row_block", F.pmod(F.xxhash64("vec_id", "vector"), "row_blocks").cast("int"))
    left = left.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1))).select("list", "row_block", "query_block", "vec_id", "vector")
    right = asks.join(cuts, "list").withColumn("query_block", F.pmod(F.xxhash64("query_id"), "query_blocks").cast("int"))
    right = right.withColumn("row_block", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1))).select("list", "row_block", "query_block", "query_id", "query", "bound")

    def scanned(table: pa.Table, questions: pa.Table) -> pa.Table:
        out = [[], [], []]
        if table.num_rows and questions.num_rows:
            space = shared.value[0]
            ids, x, q = table.column("vec_id").to_numpy(), matrix(table.column("vector")), matrix(questions.column("query"))
            turned, asked_for = space.rows(x).T.copy(), space.queries(q)
            blocks = [turned[i : i + COLUMNS] for i in range(0, len(turned), COLUMNS)]
            bounds = questions.column("bound").to_numpy()
            for i, query_id in enumerate(questions.column("query_id").to_numpy()):
                found = scan(asked_for[i], blocks, bounds[i])
                found = found[ids[found] != query_id]
                scores = inner(x[found], q[i])
                top = best(ids[found], scores, k)
                out[0].append(np.full(len(top), query_id))
                out[1].append(ids[found][top])
                out[2].append(scores[top])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.table({"query_id": join(out[0], np.int64), "vec_id": join(out[1], np.int64), "score": join(out[2], np.float64)})

    keys = ["list", "row_block", "query_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scanned, "query_id long, vec_id long, score double")
    return nearest_of(first, found, k)


def nearest_of(first: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The k best of a query. A row of the sample may stand in both inputs; repeated rows count as often as their list has them."""
    both = first.withColumn("side", F.lit(0)).unionByName(found.withColumn("side", F.lit(1)))
    times = both.groupBy("query_id", "vec_id", "score").agg(F.sum(F.lit(1) - F.col("side")).alias("a"), F.sum("side").alias("b"))
    each = times.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("a", "b").cast("int"))))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
