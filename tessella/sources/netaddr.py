"""IP addresses as two 64-bit numbers."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.plans.ship import ship

V4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"


def ipv4_number(text: Column) -> Column:
    """The number of an IPv4 address; null for anything else."""
    parts = [F.regexp_extract(text, V4, k).try_cast("long") for k in range(1, 5)]
    ok = F.coalesce(text.rlike(V4), F.lit(False))
    for p in parts:
        ok = ok & F.coalesce(p <= 255, F.lit(False))
    return F.when(ok, parts[0] * (1 << 24) + parts[1] * (1 << 16) + parts[2] * (1 << 8) + parts[3])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def halves(texts: pd.Series) -> pd.DataFrame:
    """hi, lo of each address."""
    out = []
    for t in texts:
        try:
            a = ipaddress.ip_address(t)
            n = int(a)
            out.append((n, 0) if a.version == 4 else (_signed(n >> 64), _signed(n & (1 << 64) - 1)))
        except ValueError:
            out.append((None, None))
    # column by column: beside a missing one, numbers in a plain frame would turn into doubles
    return pd.DataFrame({c: pd.array([x[k] for x in out], dtype="Int64") for k, c in enumerate(("hi", "lo"))})


def split_ip(df: DataFrame, columns: list[str], suffix1: str = "", suffix2: str = "2", v6: bool = True) -> DataFrame:
    """Each address column as two numbers: IPv4 in the first and 0, IPv6 as its two halves, signed; nulls where there is no address.

    The family is that of the parsed address.  With ``v6`` false nothing but
    built-in functions runs.
    """
    if v6:
        ship(df.sparkSession)
        address = F.pandas_udf(halves, "hi long, lo long", F.PandasUDFType.SCALAR)
    for c in columns:
        if v6:
            df = df.withColumn("__ip", address(F.col(c)))
            hi, lo = F.col("__ip.hi"), F.col("__ip.lo")
        else:
            hi = ipv4_number(F.col(c))
            lo = F.when(hi.isNotNull(), F.lit(0).cast("long"))
        df = df.withColumns({f"__hi_{c}": hi, f"__lo_{c}": lo}).drop("__ip", c)
        df = df.withColumnsRenamed({f"__hi_{c}": c + suffix1, f"__lo_{c}": c + suffix2})
    return df
