"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    An expression used inside a higher-order function is evaluated again for every element; bound to
    a lambda variable it is evaluated once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Unit length; null for the zero vector, which has no direction."""

    def scaled(v: Column) -> Column:
        return let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)))

    return let(a, scaled)


def mean_of(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x.cast("double") + y.cast("double")) / 2)


def distance(a: Column, b: Column, metric: str) -> Column:
    """Distance of two vectors. ``cosine`` and ``angular`` expect unit vectors."""
    if metric == "cosine":
        return 1 - dot(a, b)
    if metric == "angular":
        return F.acos(F.least(F.greatest(dot(a, b), F.lit(-1.0)), F.lit(1.0))) / F.pi()
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    if metric == "cityblock":
        return F.aggregate(diff, F.lit(0.0), lambda s, v: s + F.abs(v))
    squared = F.aggregate(diff, F.lit(0.0), lambda s, v: s + v * v)
    if metric == "sqeuclidean":
        return squared
    if metric == "euclidean":
        return F.sqrt(squared)
    raise ValueError(f"unknown metric {metric!r}")


def sum_vectors(a: Column, dim: int) -> Column:
    """Per-dimension sum as one aggregate: partial sums are made before the shuffle."""
    return F.array(*[F.sum(a[i].cast("double")) for i in range(dim)])


def mean_vectors(a: Column, dim: int) -> Column:
    return F.array(*[F.avg(a[i].cast("double")) for i in range(dim)])


def max_vectors(a: Column, dim: int) -> Column:
    return F.array(*[F.max(a[i].cast("double")) for i in range(dim)])
