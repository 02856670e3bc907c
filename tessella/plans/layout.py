"""Edges laid out once for the rounds of an iterative operator.

A round joins the edges with a table of values by one of their ends.  The
edges are written as a table bucketed and sorted by that end, so that rounds
read them where they lie and only values move.  A node with more edges than a
bucket should hold has them dealt over several slots, and its value goes to
each of them.  Where most rounds need few of the edges, they are packed: one
row a node and slot with its edges as an array, of which only the rows that
meet a value are opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.store import Scratch

#: A node with at most so many edges stays in one slot, however small the buckets are.
LIGHT = 100_000


class Layout:
    """Edges (src, dst, ...) by the end ``at``.

    A heavy node has more than one bucket's share of the edges, so that there
    are at most as many heavy nodes as buckets; that bounds their broadcast.
    """

    def __init__(self, edges: DataFrame, at: str, scratch: Scratch, light: int = LIGHT, packed: bool = False):
        self.at = at
        self.packed = packed
        rest = [c for c in edges.columns if c != at]

        def pack(dealt: DataFrame) -> DataFrame:
            return dealt.groupBy(*self.keys).agg(F.collect_list(F.struct(*rest)).alias("packed")) if packed else dealt

        other = "dst" if at == "src" else "src"
        buckets = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        counts = edges.groupBy(F.col(at).alias("node")).agg(F.count("*").alias("n"))
        fair = max(light, -(-edges.count() // buckets))
        heavy = scratch.keep(counts.where(F.col("n") > fair).select("node", F.ceil(F.col("n") / fair).cast("int").alias("slots")))
        self.heavy = None if heavy.isEmpty() else heavy
        if self.heavy is None:
            self.keys = [at]
            self.edges = scratch.bucketed(edges, buckets, at, then=pack)
            return
        self.keys = [at, "slot"]
        spread = edges.join(F.broadcast(heavy), F.col(at) == F.col("node"), "left")
        slot = F.coalesce(F.pmod(F.xxhash64(other), F.col("slots")), F.lit(0)).cast("int")
        self.edges = scratch.bucketed(spread.withColumn("slot", slot).select(*edges.columns, "slot"), buckets, at, "slot", then=pack)

    def join(self, values: DataFrame, how: str = "inner") -> DataFrame:
        """The edges with the values (id, ...) of their end; the columns of both but id."""
        values = values.withColumnRenamed("id", self.at)
        if self.heavy is not None:
            values = values.join(F.broadcast(self.heavy), F.col(self.at) == F.col("node"), "left")
            values = values.withColumn("slot", F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1))).drop("node", "slots")
        out = self.edges.join(values, self.keys, how)
        if self.packed:
            out = out.withColumn("packed", F.explode("packed")).select("*", "packed.*").drop("packed")
        return out.drop("slot")
