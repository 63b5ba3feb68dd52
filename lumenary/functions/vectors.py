"""Vector functions as column expressions; scoring of many vectors by numpy is in ``operators.knn``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def valid(a: Column, size: int) -> Column:
    """Whether a vector has ``size`` finite elements."""
    return F.coalesce((F.size(a) == size) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def normalised(a: Column) -> Column:
    """Unit length; null where the norm is zero or not finite."""
    n = norm(a)
    return F.when((n > 0) & ~F.isnan(n) & (n < float("inf")), F.transform(a, lambda x: x.cast("double") / n))


def distance_score(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 10 * (1 - F.greatest(distance, F.lit(0.0))))
