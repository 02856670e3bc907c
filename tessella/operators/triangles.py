"""Triangles of a symmetric graph and the centrality they give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.degree import degree
from tessella.operators.edges import node_labels
from tessella.plans.store import Scratch


def triangle_list(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b, c of each triangle once.

    Edges point from lower to higher degree, which bounds the pairs that a
    node's edges make by the square root of the number of edges each.
    """
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("s"), F.greatest("src", "dst").alias("t")).distinct()
    both = pairs.select(F.col("s").alias("src"), F.col("t").alias("dst")).unionByName(pairs.select(F.col("t").alias("src"), F.col("s").alias("dst")))
    deg = degree(both, symmetric=True)
    a, b = deg.select(F.col("id").alias("s"), F.col("degree").alias("ds")), deg.select(F.col("id").alias("t"), F.col("degree").alias("dt"))
    low = F.struct("ds", "s") < F.struct("dt", "t")
    arcs = pairs.join(a, "s").join(b, "t").select(F.when(low, F.col("s")).otherwise(F.col("t")).alias("u"), F.when(low, F.col("t")).otherwise(F.col("s")).alias("v"))
    arcs = scratch.keep(arcs)
    wedge = arcs.alias("x").join(arcs.alias("y"), F.col("x.u") == F.col("y.u")).where("x.v < y.v").select(F.col("x.u").alias("a"), F.col("x.v").alias("b"), F.col("y.v").alias("c"))
    return scratch.keep(wedge.join(pairs.select(F.col("s").alias("b"), F.col("t").alias("c")), ["b", "c"], "left_semi").select("a", "b", "c"))


def count_triangles(edges: DataFrame) -> tuple[int, DataFrame]:
    """(triangles, (id, triangles)); nodes without any count 0."""
    scratch = Scratch(edges.sparkSession, "triangles")
    found = triangle_list(edges, scratch)
    per = found.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return found.count(), node_labels(edges).join(per, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("triangles"))


def triangle_centrality(edges: DataFrame) -> DataFrame:
    """id, centrality: (a third of the triangles at the node and at its neighbours in triangles, plus those at its other neighbours) / all triangles; 0 without any."""
    scratch = Scratch(edges.sparkSession, "triangles")
    edges = scratch.keep(edges.select("src", "dst").where("src <> dst").distinct())
    found = triangle_list(edges, scratch)
    total = found.count()
    per = found.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    per = scratch.keep(node_labels(edges).join(per, "id", "left").select("id", F.coalesce("t", F.lit(0)).alias("t")))
    if total == 0:
        return per.select("id", F.lit(0.0).alias("centrality"))
    ends = [F.struct(F.col(x).alias("src"), F.col(y).alias("dst")) for x in "abc" for y in "abc" if x != y]
    close = found.select(F.explode(F.array(*ends)).alias("e")).select("e.*").distinct().withColumn("close", F.lit(True))
    near = edges.join(close, ["src", "dst"], "left").join(per.select(F.col("id").alias("dst"), "t"), "dst")
    sums = near.groupBy(F.col("src").alias("id")).agg(F.sum(F.when(F.col("close"), F.col("t")).otherwise(0)).alias("inner"), F.sum(F.when(F.col("close"), 0).otherwise(F.col("t"))).alias("outer"))
    value = ((F.col("t") + F.coalesce("inner", F.lit(0))) / 3.0 + F.coalesce("outer", F.lit(0))) / float(total)
    return per.join(sums, "id", "left").select("id", value.alias("centrality"))
