"""Arithmetic on dense vectors held in array columns, and on score columns of a group."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

KERNELS = ("cosine", "angular", "tanh", "sigmoid")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero; held in [-1, 1]."""
    value = F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(-1.0), value))


def kernel(name: str, a: Column, b: Column) -> Column:
    """Similarity of two vectors by the named kernel."""
    if name == "cosine":
        return cosine(a, b)
    if name == "angular":
        return 1 - F.acos(cosine(a, b)) / math.pi
    scaled = dot(a, b) / F.sqrt(F.size(a).cast("double"))
    if name == "tanh":
        return F.tanh(scaled)
    if name == "sigmoid":
        return 1 / (1 + F.exp(-scaled))
    raise ValueError(f"no such similarity: {name}")


def masked(similarity: Column, a_valid: Column, b_valid: Column) -> Column:
    """A pair of which either side is padding has similarity 0."""
    return similarity * a_valid.cast("int") * b_valid.cast("int")


def softmax(x: Column, *by: str) -> Column:
    w = Window.partitionBy(*by)
    e = F.exp(x - F.max(x).over(w))
    return e / F.sum(e).over(w)


def min_max(x: Column, *by: str) -> Column:
    """(x - min) / (max - min) in the group; 0 where all are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0))


def l1(x: Column, *by: str) -> Column:
    """x as a share of its group's sum; the same share for all where the sum is 0."""
    w = Window.partitionBy(*by)
    return F.coalesce(F.try_divide(x, F.sum(x).over(w)), 1 / F.count(F.lit(1)).over(w))


def passage_transform(x: Column) -> Column:
    return F.tanh(F.sqrt(x))
