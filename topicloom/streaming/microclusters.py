"""Micro-clusters over an evolving stream, one set of them per key, kept as streaming state.

Weights fade per insertion into a cluster, not with the clock. A sample joins the nearest potential
cluster if that keeps its radius within ``eps``, else the nearest outlier cluster (which becomes
potential above ``beta * mu``), else it starts an outlier cluster. Every ``period`` samples clusters
that stayed too light are dropped.

The update depends on arrival order, so one key is one sequential stream. ``lanes`` deals the rows of
a hot key out to several streams, each with its own micro-clusters; the offline step clusters the
centers of all lanes together. One lane gives the plain recurrence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, inf, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from topicloom.operators.cells import build_cells, knn
from topicloom.operators.density import dbscan
from topicloom.session import materialize

OUTLIER = -1
STATE = ("t long, dim int, p_mean array<double>, p_var array<double>, p_weight array<double>, p_born array<long>, "
         "o_mean array<double>, o_var array<double>, o_weight array<double>, o_born array<long>")


@dataclass(frozen=True)
class Fading:
    """Parameters, checked so that outlier clusters can ever become potential. Samples heavier than ``max_weight`` are refused."""

    lambd: float = 0.1
    eps: float = 1.0
    beta: float = 0.5
    mu: float = 3.0
    max_weight: float = 1.0

    def __post_init__(self):
        if self.lambd < 0 or self.eps < 0:
            raise ValueError("lambd and eps must not be negative")
        if self.beta * self.mu <= 1:
            raise ValueError("beta * mu must be above 1")
        bound = inf if self.lambd == 0 else self.max_weight / (1 - 2.0**-self.lambd)
        if bound <= self.beta * self.mu:
            raise ValueError(f"no cluster can outgrow {bound:.3g}, so none would pass beta * mu = {self.beta * self.mu:.3g}")

    @property
    def threshold(self) -> float:
        return self.beta * self.mu

    @property
    def period(self) -> int | None:
        """Samples between prunings; None with ``lambd = 0``, which never forgets."""
        return None if self.lambd == 0 else ceil(log(self.threshold / (self.threshold - 1)) / self.lambd)


@dataclass
class Pool:
    """Clusters of one kind as parallel arrays."""

    mean: np.ndarray
    var: np.ndarray
    weight: np.ndarray
    born: np.ndarray

    @classmethod
    def empty(cls, dim: int) -> Pool:
        return cls(np.empty((0, dim)), np.empty((0, dim)), np.empty(0), np.empty(0, dtype=np.int64))

    def keep(self, mask: np.ndarray) -> Pool:
        return Pool(self.mean[mask], self.var[mask], self.weight[mask], self.born[mask])

    def add(self, mean, var, weight, born) -> Pool:
        return Pool(np.vstack([self.mean, mean]), np.vstack([self.var, var]), np.append(self.weight, weight), np.append(self.born, born))

    def absorb(self, x: np.ndarray, w: float, fade: float, eps: float) -> int | None:
        """Put the sample into the nearest cluster if its radius stays within ``eps``; its place, or None."""
        if not len(self.weight):
            return None
        i = int(np.linalg.norm(self.mean - x, axis=1).argmin())
        old = self.weight[i]
        if old > 0:
            new = old * fade + w
            step = x - self.mean[i]
            mean = self.mean[i] + step * (w / new)
            var = self.var[i] * ((new - w) / old) + w * (x - mean) * step
        else:  # an empty cluster begins with this sample
            new, mean, var = w, x, self.var[i]
        if not new > 0 or not np.linalg.norm(np.sqrt(var / new)) <= eps:
            return None
        self.mean[i], self.var[i], self.weight[i] = mean, var, new
        return i


@dataclass
class MicroClusters:
    """State of one key."""

    dim: int
    t: int = 0
    potential: Pool = field(default=None)
    outlier: Pool = field(default=None)

    def __post_init__(self):
        self.potential = self.potential or Pool.empty(self.dim)
        self.outlier = self.outlier or Pool.empty(self.dim)

    def learn(self, x: np.ndarray, w: float, p: Fading) -> None:
        if not 0 <= w <= p.max_weight:
            raise ValueError(f"sample weight {w} is not between 0 and max_weight = {p.max_weight}")
        fade = 2.0**-p.lambd
        if self.potential.absorb(x, w, fade, p.eps) is None:
            place = self.outlier.absorb(x, w, fade, p.eps)
            if place is None:
                self.outlier = self.outlier.add(x, np.zeros(self.dim), w, self.t)
            elif self.outlier.weight[place] > p.threshold:
                o = self.outlier
                self.potential = self.potential.add(o.mean[place], o.var[place], o.weight[place], o.born[place])
                self.outlier = o.keep(np.arange(len(o.weight)) != place)
        if p.period is not None and self.t % p.period == 0:
            self.potential = self.potential.keep(self.potential.weight >= p.threshold)
            # One power function above and below, so that a cluster born now has the limit 1 exactly.
            grown = lambda age: 2.0 ** (-p.lambd * age) - 1
            least = np.array([grown(a) / grown(p.period) for a in (self.t - self.outlier.born + p.period).tolist()])
            self.outlier = self.outlier.keep(self.outlier.weight >= least)
        self.t += 1

    def to_row(self) -> tuple:
        def flat(pool: Pool) -> list:
            return [pool.mean.ravel().tolist(), pool.var.ravel().tolist(), pool.weight.tolist(), pool.born.tolist()]

        return (self.t, self.dim, *flat(self.potential), *flat(self.outlier))

    @classmethod
    def from_row(cls, row: tuple) -> MicroClusters:
        t, dim, *parts = row

        def pool(mean, var, weight, born) -> Pool:
            shape = (len(weight), dim)
            return Pool(np.array(mean, dtype=float).reshape(shape), np.array(var, dtype=float).reshape(shape),
                        np.array(weight, dtype=float), np.array(born, dtype=np.int64))

        return cls(dim, t, pool(*parts[:4]), pool(*parts[4:]))

    def snapshot(self) -> pd.DataFrame:
        frames = []
        for kind, pool in (("potential", self.potential), ("outlier", self.outlier)):
            if len(pool.weight):
                radius = np.linalg.norm(np.sqrt(np.maximum(pool.var, 0) / pool.weight[:, None]), axis=1)
                frames.append(pd.DataFrame({
                    "t": self.t, "kind": kind, "place": np.arange(len(pool.weight)), "center": list(pool.mean),
                    "weight": pool.weight, "radius": radius, "born": pool.born}))
        if not frames:
            return pd.DataFrame({"t": [self.t], "kind": ["none"], "place": [-1], "center": [[]], "weight": [0.0], "radius": [0.0], "born": [-1]})
        return pd.concat(frames, ignore_index=True)


def checked_weight(df: DataFrame, weight: str | None = None, out: str = "weight") -> DataFrame:
    """Sample weights: 1 by default; a missing or negative weight stops the job."""
    if weight is None:
        return df.withColumn(out, F.lit(1.0))
    w = F.col(weight).cast("double")
    bad = F.raise_error(F.lit("sample weights must be present and not negative"))
    return df.withColumn(out, F.when(w.isNull() | (w < 0), bad.cast("double")).otherwise(w))


def micro_clusters(
    stream: DataFrame, key: str, features: str, order: list[str], params: Fading, weight: str = "weight", lanes: int = 1
) -> DataFrame:
    """Snapshots (key, lane, t, kind, place, center, weight, radius, born) of every touched key per micro-batch.

    Rows of a micro-batch are taken in ``order`` within a key. Bound the batch with the source's
    trigger options; state is bounded by the pruning.
    """
    key_type = stream.schema[key].dataType.simpleString()
    lane = F.pmod(F.xxhash64(*order), F.lit(lanes)).cast("int") if lanes > 1 else F.lit(0)
    rows = stream.select(key, lane.alias("lane"), F.col(features).alias("_x"), F.col(weight).alias("_w"), *order)
    schema = f"{key} {key_type}, lane int, t long, kind string, place int, center array<double>, weight double, radius double, born long"

    def fold(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(frames)).sort_values(order)
        if batch.empty:
            return
        x = np.array(batch["_x"].tolist(), dtype=float)
        model = MicroClusters.from_row(state.get) if state.exists else MicroClusters(x.shape[1])
        for sample, w in zip(x, batch["_w"].to_numpy(dtype=float)):
            model.learn(sample, float(w), params)
        state.update(model.to_row())
        out = model.snapshot()
        out.insert(0, key, group[0])
        out.insert(1, "lane", group[1])
        yield out

    return rows.groupBy(key, "lane").applyInPandasWithState(fold, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def latest(snapshots: DataFrame, key: str) -> DataFrame:
    """The newest snapshot of every key and lane."""
    newest = snapshots.groupBy(key, "lane").agg(F.max("t").alias("t"))
    return snapshots.join(newest, [key, "lane", "t"]).where("kind <> 'none'")


def offline_labels(
    samples: DataFrame, uid: str, features: str, snapshots: DataFrame, key: str, eps: float = 0.3, min_samples: float = 5
) -> DataFrame:
    """(uid, label): weighted DBSCAN over the potential centers, each sample with its nearest center's label.

    Without potential clusters every sample is an outlier.
    """
    centers = latest(snapshots, key).where("kind = 'potential'").select(
        F.concat_ws("/", F.col(key).cast("string"), "lane", "place").alias("_c"), F.col("center").alias("_v"), "weight")
    centers = materialize(centers, "centers")
    if centers.isEmpty():
        return samples.select(uid, F.lit(OUTLIER).alias("label"))
    labels = materialize(dbscan(centers, "_c", "_v", eps, min_samples, "weight"), "center-labels")
    distinct = materialize(samples.groupBy(features).agg(F.min(uid).alias("_rep")), "distinct")
    cells = build_cells(centers.select("_c", "_v"), "_c", "_v")
    near = knn(distinct.select("_rep", F.col(features).alias("_v")), cells, "_rep", "_v", 1)
    named = near.join(labels.select(F.col("_c").alias("neighbor"), "label"), "neighbor").select("_rep", "label")
    return samples.select(uid, features).join(distinct, features).join(named, "_rep").select(uid, "label")
