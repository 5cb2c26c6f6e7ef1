"""Arithmetic on array columns, in double precision."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms below this count as zero.
EPS = 1e-8


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), operator.add)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), operator.mul))


def norm(v: Column) -> Column:
    """L2 norm."""
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def normalize(v: Column, eps: float = EPS) -> Column:
    """v over its norm; v itself if the norm is below eps."""
    n = norm(v)
    return F.when(n < eps, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / n))


def is_normalized(v: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(norm(v) - 1.0) < tolerance


def is_valid(v: Column, dimension: int | None = None) -> Column:
    """Not null, not empty, every component there and finite, and of the given dimension."""
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & (F.size(v) == dimension) if dimension else fine, F.lit(False))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), operator.add)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), operator.sub)
