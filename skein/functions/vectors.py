"""Vector expressions, in double precision and in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if the lengths differ or a vector is zero."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(F.lit(0.0))


def valid(a: Column, sizes: tuple[int, ...] = (64, 384, 1024, 1536)) -> Column:
    """A vector of a known size, all finite, not all zero."""
    return F.coalesce(F.size(a).isin(*sizes) & F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(a, lambda x: x != 0), F.lit(False))
