"""Global ranks and running sums without gathering the rows in one task.

The rows are dealt by range into ordered partitions and written; the counts
(sums) of the partitions, one row each, give every partition its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.plans.store import Scratch

PART = "__part"


def _columns(order: tuple[str | Column, ...]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _ranged(df: DataFrame, order: list[Column], scratch: Scratch) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scratch.keep(df.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id()))


def _offsets(dealt: DataFrame, values: dict[str, Column]) -> DataFrame:
    """PART, and for each name its value summed over all earlier partitions; as many rows as partitions."""
    per_part = dealt.groupBy(PART).agg(*[v.alias(n) for n, v in values.items()])
    before = W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    return F.broadcast(per_part.select(PART, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in values]))


def with_rank(df: DataFrame, *order: str | Column, name: str = "rank", scratch: Scratch | None = None) -> DataFrame:
    """Adds the row's place in the order, from 0."""
    keys = _columns(order)
    dealt = _ranged(df, keys, scratch or Scratch(df.sparkSession, "rank"))
    place = F.row_number().over(W.partitionBy(PART).orderBy(*keys)) - 1
    return dealt.join(_offsets(dealt, {"offset": F.count("*")}), PART).withColumn(name, (place + F.col("offset")).cast("long")).drop(PART, "offset")


def with_running_sums(df: DataFrame, values: dict[str, str], *order: str | Column, scratch: Scratch | None = None) -> DataFrame:
    """Adds, by name, the sums of columns up to and with the row; the order must be total."""
    keys = _columns(order)
    dealt = _ranged(df, keys, scratch or Scratch(df.sparkSession, "running"))
    upto = W.partitionBy(PART).orderBy(*keys).rowsBetween(W.unboundedPreceding, 0)
    offset = {name: f"__{name}_offset" for name in values}
    met = dealt.join(_offsets(dealt, {offset[n]: F.sum(c) for n, c in values.items()}), PART)
    sums = {n: F.sum(c).over(upto) + F.col(offset[n]) for n, c in values.items()}
    return met.withColumns(sums).drop(PART, *offset.values())


def with_running_sum(df: DataFrame, value: str, *order: str | Column, name: str = "total", scratch: Scratch | None = None) -> DataFrame:
    """As :func:`with_running_sums`, of one column."""
    return with_running_sums(df, {name: value}, *order, scratch=scratch)
