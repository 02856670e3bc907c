"""Arrays addressed by place, as tables (idx, value): what positional array code does, as joins, windows and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.plans.rank import PART, _ranged, with_rank, with_running_sum
from tessella.plans.store import Scratch


def gather(values: DataFrame, index: DataFrame) -> DataFrame:
    """index (idx, at) -> (idx, value): values at the given places.  A place that does not exist is an error when rows are read."""
    found = index.join(values.select(F.col("idx").alias("at"), "value", F.lit(True).alias("hit")), "at", "left")
    lost = F.raise_error(F.concat(F.lit("no place "), F.coalesce(F.col("at").cast("string"), F.lit("null"))))
    kind = dict(values.dtypes)["value"]
    return found.select("idx", F.when(F.col("hit"), F.col("value")).otherwise(lost.cast(kind)).alias("value"))


def scatter(spark: SparkSession, n: int, placed: DataFrame, default=0) -> DataFrame:
    """placed (at, value) written into n places of ``default``; of several values for a place the greatest counts."""
    last = placed.groupBy(F.col("at").alias("idx")).agg(F.max("value").alias("value"))
    return spark.range(n).withColumnRenamed("id", "idx").join(last, "idx", "left").select("idx", F.coalesce("value", F.lit(default)).alias("value"))


def where(test: Column, a: Column, b: Column) -> Column:
    return F.when(test, a).otherwise(b)


def in1d(a: DataFrame, b: DataFrame) -> DataFrame:
    """idx, found: whether each value of ``a`` occurs in ``b``."""
    known = b.select("value").distinct().withColumn("found", F.lit(True))
    return a.join(known, "value", "left").select("idx", F.coalesce("found", F.lit(False)).alias("found"))


def concatenate(*arrays: DataFrame) -> DataFrame:
    """Places run on from one array to the next; lengths are counted first."""
    out, start = None, 0
    for a in arrays:
        part = a.select((F.col("idx") + start).alias("idx"), "value")
        out = part if out is None else out.unionByName(part)
        start += a.count()
    return out


def union1d(a: DataFrame, b: DataFrame) -> DataFrame:
    """value: those of either, each once."""
    return a.select("value").union(b.select("value")).distinct()


def coargsort(table: DataFrame, *keys: str) -> DataFrame:
    """place, idx: where each row stands in the order of the keys, ties by idx."""
    return with_rank(table, *keys, "idx", name="place").select("place", "idx")


def cumsum(values: DataFrame) -> DataFrame:
    return with_running_sum(values, "value", "idx", name="total").select("idx", F.col("total").alias("value"))


def neighbour_diff(values: DataFrame) -> DataFrame:
    """idx, diff: value minus the one before; none for the first.

    The value before a partition's first row comes from the partitions before
    it, so that no task sees all rows.
    """
    dealt = _ranged(values, [F.col("idx")], Scratch(values.sparkSession, "diff"))
    last = dealt.groupBy(PART).agg(F.max_by("value", "idx").alias("v"))
    before = F.broadcast(last.select(PART, F.last("v", ignorenulls=True).over(W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)).alias("earlier")))
    inside = F.lag("value").over(W.partitionBy(PART).orderBy("idx"))
    return dealt.join(before, PART).select("idx", (F.col("value") - F.coalesce(inside, "earlier")).alias("diff")).where("diff is not null")


def is_sorted(values: DataFrame) -> DataFrame:
    """One row: whether values do not fall along idx."""
    return neighbour_diff(values).agg(F.coalesce(F.bool_and(F.col("diff") >= 0), F.lit(True)).alias("is_sorted"))


def index_in_group(table: DataFrame, group: str, *order: str) -> DataFrame:
    """Each row with its place in its group, from 0."""
    return table.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order)) - 1)
