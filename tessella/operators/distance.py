"""Dot products and distances, over columns (aggregates) and over array columns (per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(u: Column | str, v: Column | str) -> Column:
    """Aggregate: the sum of products of two columns."""
    return F.sum(_c(u) * _c(v))


def magnitude(u: Column | str) -> Column:
    return F.sqrt(F.sum(_c(u).cast("double") * _c(u)))


def cosine(u: Column | str, v: Column | str) -> Column:
    """1 - u.v / (|u| |v|); null where a length is 0."""
    return F.lit(1.0) - F.try_divide(dot(_c(u).cast("double"), v), magnitude(u) * magnitude(v))


def euclidean(u: Column | str, v: Column | str) -> Column:
    off = _c(u).cast("double") - _c(v)
    return F.sqrt(F.sum(off * off))


def array_dot(u: Column | str, v: Column | str) -> Column:
    """Per row: arrays of numbers; null if lengths differ."""
    u, v = _c(u), _c(v)
    products = F.zip_with(u, v, lambda a, b: a.cast("double") * b.cast("double"))
    return F.when(F.size(u) == F.size(v), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def array_magnitude(u: Column | str) -> Column:
    return F.sqrt(array_dot(u, u))


def array_cosine(u: Column | str, v: Column | str) -> Column:
    return F.lit(1.0) - F.try_divide(array_dot(u, v), array_magnitude(u) * array_magnitude(v))


def array_euclidean(u: Column | str, v: Column | str) -> Column:
    u, v = _c(u), _c(v)
    off = F.zip_with(u, v, lambda a, b: a.cast("double") - b.cast("double"))
    return F.when(F.size(u) == F.size(v), F.sqrt(F.aggregate(off, F.lit(0.0), lambda s, x: s + x * x)))
