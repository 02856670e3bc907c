"""Event-time windows over (ts, key, value) rows, the same for batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _aggregate(df: DataFrame, window: Column, keys: tuple[str, ...], value: str) -> DataFrame:
    out = df.groupBy(window.alias("win"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("win.start").alias("start"), F.col("win.end").alias("end"), *keys, "n", "total")


def timed(df: DataFrame, ts: str = "ts", late: str | None = None) -> DataFrame:
    """The time column as a timestamp, with a watermark if ``late`` is given: watermarks take no timestamps without zone."""
    out = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, late) if late else out


def tumbling(df: DataFrame, size: str, *keys: str, ts: str = "ts", value: str = "value", late: str | None = None) -> DataFrame:
    return _aggregate(timed(df, ts, late), F.window(ts, size), keys, value)


def sliding(df: DataFrame, size: str, slide: str, *keys: str, ts: str = "ts", value: str = "value", late: str | None = None) -> DataFrame:
    return _aggregate(timed(df, ts, late), F.window(ts, size, slide), keys, value)


def sessions(df: DataFrame, gap: str, *keys: str, ts: str = "ts", value: str = "value", late: str | None = None) -> DataFrame:
    return _aggregate(timed(df, ts, late), F.session_window(ts, gap), keys, value)


def late_rows(df: DataFrame, allowed: str, ts: str = "ts", *order: str) -> DataFrame:
    """Batch view of lateness: rows that lie more than ``allowed`` behind the latest time of the rows before them by ``order``.

    The running latest is taken block by block (a block is a range of order),
    so that no task sees all rows.
    """
    from pyspark.sql.window import Window as W

    from tessella.plans.rank import PART, _ranged
    from tessella.plans.store import Scratch

    dealt = _ranged(df.withColumn(ts, F.col(ts).cast("timestamp")), [F.col(c) for c in order], Scratch(df.sparkSession, "late"))
    per = dealt.groupBy(PART).agg(F.max(ts).alias("m"))
    before = F.broadcast(per.select(PART, F.max("m").over(W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)).alias("earlier")))
    within = F.max(ts).over(W.partitionBy(PART).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    seen = dealt.join(before, PART).withColumn("latest", F.greatest(within, "earlier"))
    return seen.where(F.col(ts) < F.col("latest") - F.expr(f"interval {allowed}")).drop(PART, "earlier", "latest")
