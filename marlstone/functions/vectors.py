"""Vector expressions: distances between array columns or between an array column and a literal vector.

With a literal query the sum is unrolled into one expression per dimension, which whole-stage code generation compiles; with
two columns it is a fold, interpreted per element: right for a few rows, while batches take ``operators.knn``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def _terms(a: Column, b: Column | Sequence[float], term) -> Column:
    if isinstance(b, Column):
        pairs = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), term)
        return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)
    return reduce(add, [term(a[i].cast("double"), F.lit(float(x))) for i, x in enumerate(b)], F.lit(0.0))


def dot(a: Column, b: Column | Sequence[float]) -> Column:
    return _terms(a, b, lambda x, y: x * y)


def squared_l2(a: Column, b: Column | Sequence[float]) -> Column:
    """VEC-02."""
    return _terms(a, b, lambda x, y: (x - y) * (x - y))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def cosine_distance(a: Column, b: Column | Sequence[float]) -> Column:
    """1 - cosine; 1 where a norm is zero (VEC-03)."""
    nb = norm(b) if isinstance(b, Column) else F.lit(sum(float(x) ** 2 for x in b) ** 0.5)
    n = norm(a) * nb
    return F.when(n == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / n)


def dot_distance(a: Column, b: Column | Sequence[float]) -> Column:
    """VEC-04."""
    return 1 - dot(a, b)


METRICS = {"cosine": cosine_distance, "l2": squared_l2, "dot": dot_distance}


def metric(name: str = "cosine"):
    """VEC-05."""
    if name not in METRICS:
        raise ValueError(f"no metric {name}")
    return METRICS[name]
