"""Vector algebra as column expressions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    """As an array of doubles."""
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Length."""
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def normalised(a: Column) -> Column:
    """Of length one; a zero vector as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(doubles(a), lambda x: x / n)).otherwise(doubles(a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the cosine; 1 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, 1 - dot(a, b) / n).otherwise(F.lit(1.0))


def similarity(distance: Column) -> Column:
    """1 less the distance, not below 0; 0 for null."""
    return F.coalesce(F.greatest(F.lit(0.0), 1 - distance), F.lit(0.0))


def usable(a: Column, dimensions: int) -> Column:
    """True for vectors of the right length without null, NaN or infinite components that are not all zero."""
    good = (F.size(a) == dimensions) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(a, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def combined(a: Column, b: Column) -> Column:
    """Normalised mean of two vectors; the other where one is null or empty."""
    both = normalised(F.zip_with(doubles(a), doubles(b), lambda x, y: (x + y) / 2))
    return F.when(a.isNull() | (F.size(a) == 0), doubles(b)).when(b.isNull() | (F.size(b) == 0), doubles(a)).otherwise(both)
