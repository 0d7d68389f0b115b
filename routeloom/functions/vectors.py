"""Vector functions over arrays of numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x * x)))


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def fused(semantic: Column, collaborative: Column, share: float) -> Column:
    """sqrt(1 - share) of the unit semantic vector, then sqrt(share) of the unit collaborative one."""
    a, b = (1 - share) ** 0.5, share**0.5
    return F.concat(F.transform(unit(semantic), lambda x: x * a), F.transform(unit(collaborative), lambda x: x * b))


def log_sum_exp(v: Column) -> Column:
    top = F.array_max(v)
    return top + F.log(_sum(F.transform(v, lambda x: F.exp(x - top))))
