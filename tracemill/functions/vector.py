"""Vector and number expressions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda x, y: x + y)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Clamped to [-1, 1]; 0 if a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size))).otherwise(0.0)


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def ratio(value: Column, reference: Column) -> Column:
    """Null if either is missing or the reference is 0."""
    return value / F.nullif(reference, F.lit(0))


def checked(score: Column) -> Column:
    """The score; the job fails if it isn't finite."""
    bad = F.isnan(score) | (F.abs(score) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("a score isn't finite"))).otherwise(score)
