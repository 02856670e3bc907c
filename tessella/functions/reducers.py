"""Named aggregates, the numeric helpers of the array layer, and hashed random numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: name -> aggregate of one column; arg-extremes take the position column too.
REDUCERS: dict[str, Callable[..., Column]] = {
    "sum": F.sum,
    "prod": F.product,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "any": lambda c: F.bool_or(F.col(c).cast("boolean")),
    "all": lambda c: F.bool_and(F.col(c).cast("boolean")),
    "and": F.bit_and,
    "or": F.bit_or,
    "xor": F.bit_xor,
    "count": F.count,
    "nunique": F.countDistinct,
    "unique_approx": F.approx_count_distinct,
    "first": F.first,
    "mode": lambda c: F.mode(c, True),
    "median": F.median,
    "argmin": lambda c, at="idx": F.min_by(at, F.struct(F.col(c), F.col(at))),
    "argmax": lambda c, at="idx": F.min_by(at, F.struct(-F.col(c), F.col(at))),
}


def reducer(name: str) -> Callable[..., Column]:
    if name not in REDUCERS:
        raise ValueError(f"unknown reduction {name!r}; one of {sorted(REDUCERS)}")
    return REDUCERS[name]


def minimum(a: Column, b: Column) -> Column:
    return F.least(a, b)


def maximum(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def uniform(*keys: Column | str, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on keys and seed alone, so that a lost task draws the same again."""
    h = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 11)
    return (h.cast("double") + 0.5) * F.lit(2.0**-53)


def digest_uniform(*keys: Column | str, seed: int = 0) -> Column:
    """As :func:`uniform`, from an MD5 of the keys as text, which other systems have too; slower."""
    text = F.concat_ws(":", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys], F.lit(str(seed)))
    h = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return (h.cast("double") + 0.5) * F.lit(2.0**-52)
