"""Connected components of a symmetric graph, three ways; a component's label is its least node."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.reducers import uniform
from tessella.operators.edges import node_labels
from tessella.operators.stars import star_components
from tessella.plans.layout import Layout
from tessella.plans.rank import with_rank
from tessella.plans.store import Scratch

__all__ = ["bfs_lp", "bfs_lp_rs", "fast_sv", "lps", "star_components", "component_count"]


def _loop(state: DataFrame, step, max_steps: int, scratch: Scratch, what: str) -> tuple[int, DataFrame]:
    """Until the sum over all labels stays the same: labels never rise."""
    now, before = scratch.keep(state), None
    k = 0
    while True:
        total = now.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return k, now
        if k == max_steps:
            warnings.warn(f"{what} has not settled after {max_steps} steps; it goes on", stacklevel=3)
        before = total
        fresh = scratch.keep(step(now))
        scratch.drop(now)
        now, k = fresh, k + 1


def _neighbours(by_dst: Layout, labels: DataFrame) -> DataFrame:
    """id, near: the least label among the neighbours."""
    return by_dst.join(labels.select("id", "label")).groupBy(F.col("src").alias("id")).agg(F.min("label").alias("near"))


def bfs_lp(edges: DataFrame, randomize: bool = False, shortcut: bool = False, max_steps: int = 100) -> tuple[int, DataFrame]:
    """Label propagation: (steps, (id, label)).

    shortcut: all nodes of a label follow where any of them goes.  randomize:
    labels start as a permutation, which evens out long paths; the result is
    named by least nodes all the same.
    """
    scratch = Scratch(edges.sparkSession, "lp")
    edges = scratch.keep(edges.select("src", "dst"))
    nodes, by_dst = node_labels(edges), Layout(edges, "dst", scratch)
    state = with_rank(nodes, uniform("id", seed=1), "id", name="label", scratch=scratch).select("id", "label") if randomize else nodes.withColumn("label", F.col("id"))

    def step(now: DataFrame) -> DataFrame:
        out = now.join(_neighbours(by_dst, now), "id", "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("fresh"))
        if not shortcut:
            return out.select("id", F.col("fresh").alias("label"))
        least = out.groupBy("label").agg(F.min("fresh").alias("least"))
        return out.join(least, "label").select("id", F.col("least").alias("label"))

    k, labels = _loop(state, step, max_steps, scratch, "label propagation")
    if randomize:
        least = labels.groupBy("label").agg(F.min("id").alias("least"))
        labels = labels.join(least, "label").select("id", F.col("least").alias("label"))
    return k, labels


def bfs_lp_rs(edges: DataFrame, max_steps: int = 100) -> tuple[int, DataFrame]:
    return bfs_lp(edges, True, True, max_steps)


def fast_sv(edges: DataFrame, max_steps: int = 100) -> tuple[int, DataFrame]:
    """Hooking and pointer jumping: each node and its parent take the least grandparent among the neighbours, then jump to their parent's parent."""
    scratch = Scratch(edges.sparkSession, "sv")
    edges = scratch.keep(edges.select("src", "dst"))
    by_dst = Layout(edges, "dst", scratch)

    def step(now: DataFrame) -> DataFrame:
        up = now.join(now.select(F.col("id").alias("label"), F.col("label").alias("grand")), "label").select("id", "label", "grand")
        near = by_dst.join(up.select("id", "grand")).groupBy(F.col("src").alias("id")).agg(F.min("grand").alias("near"))
        own = up.join(near, "id", "left").select("id", "label", F.least("label", "grand", F.coalesce("near", "grand")).alias("m"))
        hooked = own.select("id", "m").unionByName(own.select(F.col("label").alias("id"), "m")).groupBy("id").agg(F.min("m").alias("label"))
        return hooked.join(hooked.select(F.col("id").alias("label"), F.col("label").alias("next")), "label").select("id", F.least("label", "next").alias("label"))

    return _loop(node_labels(edges).withColumn("label", F.col("id")), step, max_steps, scratch, "hooking")


def lps(edges: DataFrame, max_steps: int = 100) -> tuple[int, DataFrame]:
    """Label propagation that rewrites the edges towards the labels as it goes, so that paths get shorter by half."""
    scratch = Scratch(edges.sparkSession, "lps")
    first = scratch.keep(edges.select("src", "dst"))
    held = {"edges": first}

    def step(now: DataFrame) -> DataFrame:
        near = held["edges"].join(now.select(F.col("id").alias("dst"), F.col("label").alias("near")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("near").alias("near"))
        out = now.join(near, "id", "left").select("id", F.least("label", F.coalesce("near", "label")).alias("label"))
        out = scratch.keep(out)
        to = out.select(F.col("id").alias("src"), F.col("label").alias("a")), out.select(F.col("id").alias("dst"), F.col("label").alias("b"))
        moved = first.join(to[0], "src").join(to[1], "dst").where("a <> b")
        jumps = out.where("id <> label").select(F.col("id").alias("src"), F.col("label").alias("dst"))
        bridge = moved.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(jumps)
        held["edges"] = scratch.keep(bridge.unionByName(bridge.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
        return out

    return _loop(node_labels(edges).withColumn("label", F.col("id")), step, max_steps, scratch, "label propagation")


def component_count(labels: DataFrame) -> DataFrame:
    return labels.agg(F.countDistinct("label").alias("components"))
