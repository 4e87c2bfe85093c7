"""Vector functions on array<float> or array<double> columns, all in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def length(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_d(a), F.lit(0.0), lambda s, x: s + x * x))


def scaled(a: Column | str, least: float = 1e-12) -> Column:
    """Divided by its length, or by ``least`` where the length is smaller."""
    n = F.greatest(length(a), F.lit(least))
    return F.transform(_d(a), lambda x: x / n)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (length(a) * length(b))


def unit_cosine(a: Column | str, b: Column | str) -> Column:
    """(cosine + 1) / 2 within 0 and 1; 0 where a vector has no length."""
    la, lb = length(a), length(b)
    return F.when((la < 1e-12) | (lb < 1e-12), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dot(a, b) / (la * lb) + 1) / 2)))


def row_support(row: Column | str, evidence: Column | str) -> Column:
    """(row . evidence + 1) / 2 within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dot(row, evidence) + 1) / 2))


def pair_features(a: Column | str, b: Column | str) -> Column:
    """Both vectors, their product and their absolute difference, one behind the other."""
    return F.concat(_d(a), _d(b), F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.zip_with(_d(a), _d(b), lambda x, y: F.abs(x - y)))
