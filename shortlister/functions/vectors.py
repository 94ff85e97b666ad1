"""Vector expressions over arrays of numbers, in double arithmetic."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-8
#: What a prior counts as at least, where scores are multiplied.
EPSILON = 0.05


def dot(a: Column, b: Column) -> Column:
    """Sum of products in array order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot_of(a: Column, b: Column, dims: int) -> Column:
    """``dot`` of vectors of a known length, as one compiled expression; null if one is shorter."""
    terms = [F.get(a, F.lit(i)) * F.get(b, F.lit(i)) for i in range(dims)]
    return reduce(add, terms, F.lit(0.0))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column) -> Column:
    """Each component by the norm, which counts as FLOOR at least."""
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm(v), F.lit(FLOOR)))


def sigmoid(x: Column, temperature: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-x / temperature))


def fused_add(s: Column, mean: Column, std: Column, p: Column, alpha: Column, beta: Column) -> Column:
    return alpha * (s - mean) / std + beta * p


def fused_mult(s: Column, p: Column, lam: Column, epsilon: float = EPSILON) -> Column:
    return s * F.pow(F.greatest(p, F.lit(epsilon)), lam)
