"""Column builders over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def cosine01(a: Column, b: Column) -> Column:
    """Cosine mapped to [0, 1]; 0.5 where a vector has no length."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine(a, b) + 1.0) / 2.0))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def scaled(v: Column, k: Column) -> Column:
    return F.transform(doubles(v), lambda x: x * k)


def add(a: Column, b: Column, k: Column | float = 1.0) -> Column:
    """a + k * b."""
    k = F.lit(k) if isinstance(k, (int, float)) else k
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + k * y)


def unit(v: Column) -> Column:
    return scaled(v, F.coalesce(F.try_divide(F.lit(1.0), norm(v)), F.lit(0.0)))


def project_out(v: Column, w: Column) -> Column:
    """v without its part along the unit vector w."""
    return add(v, w, -dot(v, w))


def rounded(v: Column, digits: int = 6) -> Column:
    return F.transform(v, lambda x: F.round(x, digits))
