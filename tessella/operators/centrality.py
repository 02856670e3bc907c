"""Centralities by power iteration.  Each round is one written table and one aggregate."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.degree import node_count
from tessella.operators.edges import node_labels, weighted
from tessella.plans.layout import Layout
from tessella.plans.store import Scratch


def _edges(edges: DataFrame, scratch: Scratch) -> DataFrame:
    w = F.col("w").cast("double") if weighted(edges) else F.lit(1.0)
    return scratch.keep(edges.select("src", "dst", w.alias("w")))


def _nodes(edges: DataFrame, full: bool) -> tuple[DataFrame, int]:
    if full:
        n = node_count(edges)
        return edges.sparkSession.range(n), n
    nodes = node_labels(edges)
    return nodes, nodes.count()


def _product(edges: Layout, x: DataFrame, by: str) -> DataFrame:
    """id, y: the sum of w * x over a node's edges, x being of their other end; nodes without edges left out.  Sums are begun where the edges lie."""
    return edges.join(x.select("id", "x")).groupBy(F.col(by).alias("id")).agg(F.sum(F.col("w") * F.col("x")).alias("y"))


def eigenvector_centrality(edges: DataFrame, max_iter: int = 100, tol: float = 1e-8, full: bool = True) -> tuple[float, DataFrame]:
    """(eigenvalue, (id, x)): x <- A x, of length 1, from equal values on; ends when the sum of changes is below tol * n."""
    scratch = Scratch(edges.sparkSession, "eigen")
    edges = _edges(edges, scratch)
    nodes, n = _nodes(edges, full)
    by_dst = Layout(edges, "dst", scratch)
    now = scratch.keep(nodes.select("id", F.lit(1.0 / math.sqrt(max(1, n))).alias("x")))
    value = 0.0
    for _ in range(max_iter):
        raw = scratch.keep(now.join(_product(by_dst, now, "src"), "id", "left").select("id", F.col("x").alias("old"), F.coalesce("y", F.lit(0.0)).alias("y")))
        value, square = raw.agg(F.sum(F.col("old") * F.col("y")), F.sum(F.col("y") * F.col("y"))).first()
        size = math.sqrt(square or 0.0) or 1.0
        scratch.drop(now)
        now = raw.select("id", (F.col("y") / size).alias("x"))
        if tol > 0 and raw.agg(F.sum(F.abs(F.col("y") / size - F.col("old")))).first()[0] < tol * n:
            break
    else:
        warnings.warn(f"no convergence in {max_iter} rounds", stacklevel=2)
    return value, now


def hub_auth(edges: DataFrame, max_iter: int = 100, tol: float = 1e-8, full: bool = True) -> DataFrame:
    """id, hub, authority: h <- A a, a <- At h, both of length 1; ends when the authorities' sum of changes is below tol * n."""
    scratch = Scratch(edges.sparkSession, "hits")
    edges = _edges(edges, scratch)
    nodes, n = _nodes(edges, full)
    by_src, by_dst = Layout(edges, "src", scratch), Layout(edges, "dst", scratch)
    now = scratch.keep(nodes.select("id", F.lit(0.0).alias("h"), F.lit(1.0 / math.sqrt(max(1, n))).alias("x")))
    for _ in range(max_iter):
        hubs = scratch.keep(_product(by_dst, now, "src"))
        fresh = _product(by_src, hubs.select("id", F.col("y").alias("x")), "dst")
        raw = now.select("id", F.col("x").alias("old")).join(hubs.withColumnRenamed("y", "h"), "id", "left").join(fresh, "id", "left")
        raw = scratch.keep(raw.select("id", "old", F.coalesce("h", F.lit(0.0)).alias("h"), F.coalesce("y", F.lit(0.0)).alias("a")))
        hh, aa = raw.agg(F.sum(F.col("h") * F.col("h")), F.sum(F.col("a") * F.col("a"))).first()
        hs, as_ = math.sqrt(hh or 0.0) or 1.0, math.sqrt(aa or 0.0) or 1.0
        now = raw.select("id", (F.col("h") / hs).alias("h"), (F.col("a") / as_).alias("x"))
        if tol > 0 and raw.agg(F.sum(F.abs(F.col("a") / as_ - F.col("old")))).first()[0] < tol * n:
            break
    else:
        warnings.warn(f"no convergence in {max_iter} rounds", stacklevel=2)
    return now.select("id", F.col("h").alias("hub"), F.col("x").alias("authority"))


def pagerank(edges: DataFrame, p_vec: DataFrame | None = None, x_start: DataFrame | None = None, max_iter: int = 100, alpha: float = 0.85, tol: float = 1e-8, full: bool = True, warn: bool = True) -> DataFrame:
    """id, rank.  Weights count as parts of their source's sum; the rank of nodes without edges out is dealt by ``p_vec`` (id, x), by default evenly.

    p_vec and x_start must have a value for every node; they are scaled to sum 1.
    """
    scratch = Scratch(edges.sparkSession, "pagerank")
    edges = _edges(edges, scratch)
    nodes, n = _nodes(edges, full)

    def vector(given: DataFrame | None, name: str) -> DataFrame:
        if given is None:
            return nodes.select("id", F.lit(1.0 / max(1, n)).alias(name))
        size, total = given.agg(F.count("x"), F.sum("x")).first()
        if size != n:
            raise ValueError(f"a vector of {size} values for {n} nodes")
        return given.select("id", (F.col("x") / float(total)).alias(name))

    out = edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("out"))
    parts = Layout(edges.join(out.select(F.col("id").alias("src"), "out"), "src").select("src", "dst", (F.col("w") / F.col("out")).alias("w")), "src", scratch)
    base = nodes.join(vector(p_vec, "p"), "id", "left").join(out.select("id", F.lit(False).alias("dangling")), "id", "left")
    base = scratch.keep(base.select("id", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("dangling", F.lit(True)).alias("dangling")))
    now = scratch.keep(vector(x_start, "x"))
    lost = now.join(base, "id").agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("x"))), F.lit(0.0))).first()[0]
    for _ in range(max_iter):
        got = _product(parts, now, "dst")
        y = F.coalesce("y", F.lit(0.0)) * alpha + F.lit(alpha * lost) * F.col("p") + F.lit(1 - alpha) * F.col("p")
        raw = scratch.keep(base.join(now, "id").join(got, "id", "left").select("id", "dangling", F.col("x").alias("old"), y.alias("y")))
        # y sums to 1 but for rounding, so that the changes can be summed before it is scaled
        total, lost, moved = raw.agg(F.sum("y"), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("y"))), F.lit(0.0)), F.sum(F.abs(F.col("y") - F.col("old")))).first()
        lost /= total
        now = raw.select("id", (F.col("y") / total).alias("x"))
        if moved < tol * n:
            break
    else:
        if warn:
            warnings.warn(f"no convergence in {max_iter} rounds", stacklevel=2)
    return now.select("id", F.col("x").alias("rank"))
