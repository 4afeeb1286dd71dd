"""Dense-vector and probability expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 when either is the zero vector."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def rbf(a: Column, b: Column, gamma: float | None = None) -> Column:
    """Gaussian kernel; ``gamma`` defaults to one over the dimension."""
    scale = F.lit(gamma) if gamma is not None else F.lit(1.0) / F.size(a)
    squared = dot(a, a) + dot(b, b) - F.lit(2.0) * dot(a, b)
    return F.exp(-scale * squared)


def proba(margin: Column) -> Column:
    """Probability of the positive class from a log-odds margin."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def dense_labels(classes: Column, q: int) -> Column:
    """Array of positive class ids -> 0/1 array of length ``q``."""
    held = F.coalesce(classes, F.array().cast("array<int>"))
    return F.transform(
        F.sequence(F.lit(0), F.lit(q - 1)),
        lambda k: F.array_contains(held, k).cast("tinyint"),
    )
