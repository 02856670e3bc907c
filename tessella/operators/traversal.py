"""Breadth-first search and shortest paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.degree import dense, node_count
from tessella.operators.edges import node_labels
from tessella.plans.fixpoint import fixpoint
from tessella.plans.layout import Layout
from tessella.plans.store import Scratch

COMPACT = 16


def _sources(spark, source) -> DataFrame:
    if isinstance(source, DataFrame):
        return source.select(F.col(source.columns[0]).cast("long").alias("id")).distinct()
    many = source if isinstance(source, (list, tuple, set)) else [source]
    return spark.createDataFrame([(int(x),) for x in sorted(set(many))], "id long")


def _levels(edges: DataFrame, source, depth_limit: int | None, scratch: Scratch) -> DataFrame:
    """id, dist, parent of the nodes reached; of several parents on the level before, the greatest.

    Only the frontier is joined with the edges, which lie by source; what was
    seen before is excluded by an anti-join.
    """
    by_src = Layout(scratch.keep(edges.select("src", "dst")), "src", scratch)
    frontier = scratch.keep(_sources(edges.sparkSession, source).select("id", F.lit(0).cast("long").alias("dist"), F.col("id").alias("parent")))
    levels, depth = [frontier], 0
    while depth_limit is None or depth < depth_limit:
        depth += 1
        seen = reduce(DataFrame.unionByName, levels)
        fresh = by_src.join(frontier.select("id")).groupBy(F.col("dst").alias("id")).agg(F.max("src").alias("parent"))
        frontier = scratch.keep(fresh.join(seen, "id", "left_anti").select("id", F.lit(depth).cast("long").alias("dist"), "parent"))
        if frontier.isEmpty():
            break
        levels.append(frontier)
        if len(levels) > COMPACT:
            levels = [scratch.keep(reduce(DataFrame.unionByName, levels))]
    return reduce(DataFrame.unionByName, levels)


def _spread(edges: DataFrame, found: DataFrame, full: bool, **defaults) -> DataFrame:
    """Found values for all labels that occur, or for all from 0 to the greatest if ``full``."""
    if full:
        return dense(found, node_count(edges), **defaults)
    return node_labels(edges).join(found, "id", "left").select("id", *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()])


def bfs_reachable(edges: DataFrame, source, depth_limit: int | None = None, full: bool = True) -> DataFrame:
    """id, reached."""
    found = _levels(edges, source, depth_limit, Scratch(edges.sparkSession, "bfs")).select("id", F.lit(True).alias("reached"))
    return _spread(edges, found, full, reached=False)


def bfs_distance(edges: DataFrame, source, depth_limit: int | None = None, full: bool = True) -> DataFrame:
    """id, dist: number of edges from the nearest source; -1 where none leads."""
    return _spread(edges, _levels(edges, source, depth_limit, Scratch(edges.sparkSession, "bfs")).select("id", "dist"), full, dist=-1)


def bfs_forest(edges: DataFrame, source, depth_limit: int | None = None, full: bool = True) -> DataFrame:
    """id, parent: sources are their own parents, -1 where none leads."""
    return _spread(edges, _levels(edges, source, depth_limit, Scratch(edges.sparkSession, "bfs")).select("id", "parent"), full, parent=-1)


def sssp_bf(edges: DataFrame, source: int | DataFrame | None, full: bool = True, parents: bool = True) -> DataFrame:
    """id, parent, dist by Bellman-Ford over non-negative weights; -1 where no path leads.

    Of the nodes whose distance fell and was not passed on yet, a round passes
    on those within a third of the greatest weight of the nearest one; farther
    ones wait, as most of them fall again.  Of equally short ways one of the
    fewest edges counts, and of these the one over the least parent.  Without
    ``parents`` there is no such column, and ties need no care.  No source: the
    least label is one.
    """
    scratch = Scratch(edges.sparkSession, "sssp")
    edges = scratch.keep(edges.select("src", "dst", F.col("w").cast("double").alias("w")))
    by_src = Layout(edges, "src", scratch, packed=True)
    known = ["dist", "hops", "parent"] if parents else ["dist"]
    most, count, least = edges.agg(F.max("w"), F.count("*"), F.min(F.least("src", "dst"))).first()
    source = source if source is not None else [] if least is None else least
    start = _sources(edges.sparkSession, source).select("id", F.lit(0.0).alias("dist"), F.lit(0).cast("long").alias("hops"), F.col("id").alias("parent"))
    width, limit = (most or 0.0) / 3, 0.0

    def key(columns: list[str]) -> Column:
        found = [F.col(c) for c in columns]
        return found[0] if len(found) == 1 else F.struct(*found)

    def relax(state: DataFrame, _: int) -> DataFrame:
        lead = F.col("fresh") & (F.col("dist") <= limit)
        ways = by_src.join(state.where(lead).select("id", *[F.col(c).alias(f"from_{c}") for c in known if c != "parent"]))
        step = {"dist": F.col("from_dist") + F.col("w"), "hops": F.col("from_hops") + 1, "parent": F.col("src")}
        ways = ways.select(F.col("dst").alias("id"), *[step[c].alias(c) for c in known], F.lit(True).alias("fresh"))
        old = state.select("id", *known, (F.col("fresh") & ~lead).alias("fresh"))
        length = [c for c in known if c != "parent"]
        met = old.unionByName(ways).groupBy("id").agg(F.min(key(known)).alias("b"), F.min(F.when(~F.col("fresh"), key(length))).alias("passed"))
        met = met.select("id", *([f"b.{c}" for c in known] if parents else [F.col("b").alias("dist")]), "passed")
        return met.select("id", *known, (F.col("passed").isNull() | (key(length) < F.col("passed"))).alias("fresh"))

    def done(state: DataFrame, _: int) -> bool:
        nonlocal limit
        nearest = state.where("fresh").agg(F.min("dist")).first()[0]
        if nearest is None:
            return True
        limit = nearest + width
        return False

    # the nearest one is settled when it is passed on: as many rounds as nodes at most
    state, _, _ = fixpoint(start.select("id", *known, F.lit(True).alias("fresh")), relax, done, count + 2, scratch)
    found = state.select("id", "parent", "dist") if parents else state.select("id", "dist")
    return _spread(edges, found, full, **({"parent": -1} if parents else {}), dist=-1.0)
