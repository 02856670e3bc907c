"""Maximal independent sets of a symmetric graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.reducers import uniform
from tessella.operators.edges import node_labels
from tessella.plans.rank import with_rank
from tessella.plans.store import Scratch


def maximal_independent_set(edges: DataFrame, order: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """id, member: the set that a walk through the nodes by ``order`` (id, place) gives, else by a random permutation.

    In each round all nodes that come before all their open neighbours enter,
    and their neighbours leave; in a random order there are about as many
    rounds as the logarithm of the nodes.  An order must give each node one
    place, and no two nodes the same.
    """
    scratch = Scratch(edges.sparkSession, "mis")
    edges = scratch.keep(edges.where("src <> dst").select("src", "dst"))
    nodes = node_labels(edges)
    if order is None:
        placed = scratch.keep(with_rank(nodes, uniform("id", seed=seed), "id", name="place", scratch=scratch))
    else:
        placed = scratch.keep(nodes.join(order.select("id", "place"), "id", "left"))
        n, known, places = placed.agg(F.count("*"), F.count("place"), F.countDistinct("place")).first()
        if n != known or n != places or n != nodes.count():
            raise ValueError("the order is no permutation of the nodes")
    a, b = placed.select(F.col("id").alias("src"), F.col("place").alias("ps")), placed.select(F.col("id").alias("dst"), F.col("place").alias("pd"))
    live = scratch.keep(edges.join(a, "src").join(b, "dst"))
    open_nodes, inside = placed.select("id"), None
    while True:
        blocked = live.where("pd < ps").select(F.col("src").alias("id")).distinct()
        roots = scratch.keep(open_nodes.join(blocked, "id", "left_anti"))
        if roots.isEmpty():
            break
        inside = roots if inside is None else scratch.keep(inside.unionByName(roots))
        out = live.join(roots.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        gone = scratch.keep(out.unionByName(roots))
        open_nodes = scratch.keep(open_nodes.join(gone, "id", "left_anti"))
        live = scratch.keep(live.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "ps", "pd"))
    members = inside if inside is not None else open_nodes
    return placed.select("id").join(members.withColumn("member", F.lit(True)), "id", "left").select("id", F.coalesce("member", F.lit(False)).alias("member"))


def valid_mis(edges: DataFrame, members: DataFrame) -> DataFrame:
    """One row: whether exactly one of "is a member" and "has a member as neighbour" holds for every node of members (id, member)."""
    near = edges.join(members.select(F.col("id").alias("dst"), "member"), "dst").groupBy(F.col("src").alias("id")).agg(F.bool_or("member").alias("near"))
    ok = F.col("member") != F.coalesce("near", F.lit(False))
    return members.join(near, "id", "left").agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("valid"))
