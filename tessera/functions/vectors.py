"""Vector functions as Column expressions, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(v: list[float]) -> Column:
    """A vector as a literal."""
    return F.array(*[F.lit(float(x)) for x in v])


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def score_of(distance: Column) -> Column:
    """1 / (1 + distance)."""
    return 1 / (1 + distance)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def normalised(v: Column) -> Column:
    """The unit vector; null for a zero vector."""
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n))


def as_stored(v: Column) -> Column:
    """Narrowed to float, as stores hold it."""
    return v.cast("array<float>")


def hybrid_rank(distance: Column, lexical: Column, vector_weight: float = 0.7, lexical_weight: float = 0.3) -> Column:
    """Ascending rank of weighted distance less weighted lexical score; a null lexical score counts for nothing."""
    return distance * vector_weight - F.coalesce(lexical, F.lit(0.0)) * lexical_weight
