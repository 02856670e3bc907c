"""The data behind plots: histograms, quartiles, filtered views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.plans.rank import with_rank


def numeric_columns(df: DataFrame, least: int = 1) -> list[str]:
    """Columns of whole numbers (64 bits) and doubles; an error if there are fewer than ``least``."""
    out = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.LongType, T.DoubleType))]
    if len(out) < least:
        raise ValueError(f"{least} numeric columns are needed, there are {len(out)}")
    return out


def _bin(value: Column, lo: float, hi: float, bins: int) -> Column:
    """0 to bins - 1; the last bin is closed; one bin holds all if lo = hi."""
    if lo == hi:
        return F.lit(0).cast("long")
    return F.least(F.floor((value - F.lit(lo)) / F.lit((hi - lo) / bins)), F.lit(bins - 1)).cast("long")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """bin, lo, hi, n of equal widths between least and greatest value; empty bins have 0, nulls are left out."""
    lo, hi = df.agg(F.min(F.col(column).cast("double")), F.max(F.col(column).cast("double"))).first()
    spark = df.sparkSession
    if lo is None:
        return spark.range(0).select(F.col("id").alias("bin"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), F.lit(0).cast("long").alias("n"))
    counts = df.where(F.col(column).isNotNull()).groupBy(_bin(F.col(column).cast("double"), lo, hi, bins).alias("bin")).agg(F.count("*").alias("n"))
    width = (hi - lo) / bins
    edges = spark.range(bins).select(F.col("id").alias("bin"), (F.lit(lo) + F.col("id") * width).alias("lo"), (F.lit(lo) + (F.col("id") + 1) * width).alias("hi"))
    return edges.join(counts, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def histogram2d(df: DataFrame, x: str, y: str, x_bins: int = 10, y_bins: int = 10, x_range: tuple[float, float] | None = None, y_range: tuple[float, float] | None = None) -> DataFrame:
    """x_bin, y_bin, n of the rows within both ranges (by default all); cells without rows are left out."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.where(a.isNotNull() & b.isNotNull())
    rows = rows.where(a.between(*x_range)) if x_range else rows
    rows = rows.where(b.between(*y_range)) if y_range else rows
    x_lo, x_hi, y_lo, y_hi = rows.agg(F.min(a), F.max(a), F.min(b), F.max(b)).first()
    if x_lo is None:
        return rows.select(F.lit(0).cast("long").alias("x_bin"), F.lit(0).cast("long").alias("y_bin"), F.lit(0).cast("long").alias("n")).where("false")
    return rows.groupBy(_bin(a, x_lo, x_hi, x_bins).alias("x_bin"), _bin(b, y_lo, y_hi, y_bins).alias("y_bin")).agg(F.count("*").alias("n"))


def box_whisker(df: DataFrame, *columns: str) -> DataFrame:
    """column, low, q1, median, q3, high: the values at places int(n * q) of the sorted column, not interpolated."""
    out = None
    for c in columns or numeric_columns(df):
        values = df.where(F.col(c).isNotNull()).select(F.col(c).cast("double").alias("v"))
        ranked = with_rank(values, "v")
        total = values.count()
        at = lambda q: F.max(F.when(F.col("rank") == int(total * q), F.col("v")))
        row = ranked.agg(F.min("v").alias("low"), at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"), F.max("v").alias("high")).select(F.lit(c).alias("column"), "low", "q1", "median", "q3", "high")
        out = row if out is None else out.unionByName(row)
    return out


def area(df: DataFrame, bins: int = 10) -> DataFrame:
    """Histograms of all numeric columns: column, bin, lo, hi, n."""
    parts = [histogram(df, c, bins).withColumn("column", F.lit(c)) for c in numeric_columns(df)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def zscore_filter(df: DataFrame, column: str, most: float) -> DataFrame:
    """Rows whose value lies within ``most`` (population) standard deviations of the mean; all if the deviation is 0."""
    stats = F.broadcast(df.agg(F.avg(column).alias("__mean"), F.stddev_pop(column).alias("__sd")))
    near = F.abs(F.col(column) - F.col("__mean")) <= F.lit(most) * F.col("__sd")
    return df.crossJoin(stats).where(near).drop("__mean", "__sd")
