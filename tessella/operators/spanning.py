"""Minimum spanning forests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.edges import node_labels
from tessella.operators.stars import star_components
from tessella.plans.store import Scratch


def msf_boruvka(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, component), (src < dst, w)): in each round every component takes its least edge outwards.

    Edges are ordered by (w, lower end, upper end), a total order, so that
    equal weights close no cycle.  Tables of components are joined by merging:
    their files are small, but the tables would not be, as one at every task.
    """
    scratch = Scratch(edges.sparkSession, "msf")
    sides = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "w")
    live = scratch.keep(sides.groupBy("a", "b").agg(F.min("w").alias("w")).select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")))
    labels = scratch.keep(node_labels(edges).withColumn("component", F.col("id")))
    forest = scratch.keep(live.where("false").select("a", "b", "w"))
    while not live.isEmpty():
        key = F.struct("w", "a", "b")
        out = live.select("ca", key.alias("e"), F.struct("ca", "cb").alias("c")).unionByName(live.select(F.col("cb").alias("ca"), key.alias("e"), F.struct("ca", "cb").alias("c")))
        best = scratch.keep(out.groupBy("ca").agg(F.min_by(F.struct("e", "c"), "e").alias("m")).select("m.e.*", F.col("m.c.ca").alias("x"), F.col("m.c.cb").alias("y")).distinct())
        forest = scratch.keep(forest.unionByName(best.select("a", "b", "w")))
        joined = scratch.keep(star_components(best.select(F.col("x").alias("src"), F.col("y").alias("dst")), scratch, spread=True))
        labels = scratch.keep(labels.join(joined.select(F.col("id").alias("component"), "label").hint("merge"), "component", "left").select("id", F.coalesce("label", "component").alias("component")))
        ca, cb = joined.select(F.col("id").alias("ca"), F.col("label").alias("la")), joined.select(F.col("id").alias("cb"), F.col("label").alias("lb"))
        moved = live.join(ca.hint("merge"), "ca", "left").join(cb.hint("merge"), "cb", "left").select("a", "b", "w", F.coalesce("la", "ca").alias("ca"), F.coalesce("lb", "cb").alias("cb"))
        live = scratch.keep(moved.where("ca <> cb"))
    return labels, forest.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")
