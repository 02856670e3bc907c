"""Partitions of a set and permutations, as tables (idx, label) and (idx, value)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.reducers import uniform
from tessella.plans.rank import with_rank


def canonical_partition(table: DataFrame, idx: str = "idx", label: str = "label") -> DataFrame:
    """Each class named by its lowest index; aggregation and join, so that a large class is not gathered."""
    least = table.groupBy(F.col(label).alias("__l")).agg(F.min(idx).alias("canon"))
    return table.join(least, table[label].eqNullSafe(least["__l"])).select(table[idx], F.col("canon").alias(label))


def is_refinement(table: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: whether each class of ``a`` lies within one class of ``b``."""
    per_class = table.groupBy(a).agg((F.min(b) == F.max(b)).alias("one"))
    return per_class.agg(F.coalesce(F.bool_and("one"), F.lit(True)).alias("refines"))


def random_permutation(spark: SparkSession, n: int, seed: int = 0, draw: Callable[..., Column] = uniform) -> DataFrame:
    """idx, value: the ranks of hashed random numbers."""
    return with_rank(spark.range(n), draw("id", seed=seed), "id", name="value").select(F.col("id").alias("idx"), "value")


def is_permutation(table: DataFrame, value: str = "value") -> DataFrame:
    """One row: whether the values are 0 to n-1, each once."""
    v = F.col(value)
    ok = (F.countDistinct(v) == F.count("*")) & (F.coalesce(F.min(v), F.lit(0)) == 0) & (F.coalesce(F.max(v), F.lit(-1)) == F.count("*") - 1)
    return table.agg(ok.alias("is_perm"))


def reindex(table: DataFrame, value: str = "value") -> DataFrame:
    """Dense ranks of the values, from 0."""
    ranks = with_rank(table.select(F.col(value).alias("__v")).distinct(), "__v")
    return table.join(ranks, table[value] == ranks["__v"]).select(*[table[c] for c in table.columns], "rank")
