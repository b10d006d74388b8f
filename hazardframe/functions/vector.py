"""Inner products and norms of array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def rrf(rank_a: Column, rank_b: Column, k: int = 60) -> Column:
    return 1.0 / (k + rank_a) + 1.0 / (k + rank_b)
