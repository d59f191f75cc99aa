"""Vectors in arrays; sums are in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, different lengths or a zero norm."""
    whole = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    n = norm(a) * norm(b)
    return F.coalesce(F.when(whole & (n > 0), dot(a, b) / n), F.lit(0.0))


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * by)


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def fused(a: Column, b: Column, share: float = 0.6) -> Column:
    """sqrt(share) * a joined to sqrt(1 - share) * b, at norm 1."""
    return normalised(F.concat(scaled(a, F.lit(share**0.5)), scaled(b, F.lit((1 - share) ** 0.5))))
