"""Vector functions over arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle; 0 where a vector is null, empty or zero."""
    scale = norm(a) * norm(b)
    return F.when(F.coalesce(scale, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def fit(v: Column, dimensions: int) -> Column:
    """The first so many dimensions; null if there are fewer."""
    return F.when(F.size(v) >= dimensions, F.slice(v, 1, dimensions))


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def weighted_mean(vectors: Column, weights: Column) -> Column:
    """Element by element, with weights made to sum to 1."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    scaled = F.zip_with(vectors, weights, lambda v, w: F.transform(v, lambda x: x * (w / total)))
    return F.aggregate(
        F.slice(scaled, 2, F.size(scaled)), F.element_at(scaled, 1), lambda s, v: F.zip_with(s, v, lambda x, y: x + y)
    )


def elementwise_max(vectors: Column) -> Column:
    return F.aggregate(
        F.slice(vectors, 2, F.size(vectors)),
        F.element_at(vectors, 1),
        lambda s, v: F.zip_with(s, v, lambda x, y: F.greatest(x, y)),
    )
