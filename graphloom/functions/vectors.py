"""Vector arithmetic as Column expressions, in double precision (O-65)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_d(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where either vector is all zero; null where lengths differ."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0)))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)
