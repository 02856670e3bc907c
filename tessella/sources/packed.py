"""Strings as one run of bytes with offsets, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.rank import with_running_sum


def pack_strings(df: DataFrame, column: str, key: str, encoding: str = "UTF-8") -> DataFrame:
    """key, bytes (with a closing zero byte), offset of each string when they follow each other by key; null is the empty string."""
    raw = F.encode(F.coalesce(F.col(column), F.lit("")), encoding)
    rows = df.select(F.col(key).alias("key"), F.concat(raw, F.lit(b"\x00")).alias("bytes")).withColumn("n", F.octet_length("bytes").cast("long"))
    return with_running_sum(rows, "n", "key").select("key", "bytes", (F.col("total") - F.col("n")).cast("long").alias("offset"))


def unpack_strings(packed: DataFrame, encoding: str = "UTF-8") -> DataFrame:
    """key, value."""
    body = F.expr("substring(bytes, 1, octet_length(bytes) - 1)")
    return packed.select("key", F.decode(body, encoding).alias("value"))


def slice_strings(blob: DataFrame, offsets: DataFrame, encoding: str = "UTF-8", piece: int = 1 << 20) -> DataFrame:
    """blob: start, values (binary) of consecutive parts of one run of bytes, or one row (values) that is all of it; offsets: key, offset, n -> key, value.

    The run is cut into pieces of at most ``piece`` bytes, and each string
    meets the pieces that it lies in by their number, so that no task holds
    more than a piece and its strings; offsets may exceed 2 GiB.
    """
    parts = blob if "start" in blob.columns else blob.limit(1).withColumn("start", F.lit(0).cast("long"))
    size = F.octet_length("values").cast("long")
    cuts = parts.withColumn("no", F.explode(F.sequence(F.floor(F.col("start") / piece), F.floor((F.col("start") + size) / piece)))).withColumn("lo", F.greatest("start", F.col("no") * piece)).withColumn("hi", F.least(F.col("start") + size, (F.col("no") + 1) * piece))
    cuts = cuts.where("lo < hi").select("no", "lo", F.expr("substring(values, cast(lo - start as int) + 1, cast(hi - lo as int))").alias("bytes"))
    body = offsets.select("key", F.col("offset").cast("long").alias("a"), (F.col("offset") + F.col("n") - 1).cast("long").alias("b"))
    wanted = body.where("b > a").withColumn("no", F.explode(F.sequence(F.floor(F.col("a") / piece), F.floor((F.col("b") - 1) / piece))))
    met = wanted.join(cuts, "no").where("lo < b and lo + octet_length(bytes) > a")
    part = F.expr("substring(bytes, cast(greatest(a - lo, 0) as int) + 1, cast(least(b, lo + octet_length(bytes)) - greatest(a, lo) as int))")
    found = met.select("key", "a", "lo", part.alias("part")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("lo", "part"))).alias("parts"))
    whole = F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["part"]))
    out = body.join(found.select("key", whole.alias("bytes")), "key", "left")
    return out.select("key", F.decode(F.coalesce("bytes", F.lit(b"")), encoding).alias("value"))
