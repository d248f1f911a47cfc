"""Vector arithmetic on ARRAY<DOUBLE> columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """One minus cosine similarity; 1 if either vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, 1 - dot(a, b) / scale).otherwise(F.lit(1.0))


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)
