"""Arithmetic of vectors (arrays of numbers) in double precision, without leaving the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda x: x * x)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of ``value``, which is computed once, also if it is used within a lambda function."""
    return F.element_at(F.transform(F.array(value), use), 1)


def l2_normalize(v: Column) -> Column:
    """Of length 1; a zero vector stays as it is."""
    scaled = lambda xs, size: F.transform(xs, lambda x: x / F.when(size == 0, 1.0).otherwise(size))
    return bound(doubles(v), lambda xs: bound(norm(xs), lambda size: scaled(xs, size)))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def truncate(v: Column, dimensions: int) -> Column:
    """The first ``dimensions`` components, of length 1 again."""
    return l2_normalize(F.slice(v, 1, dimensions))
