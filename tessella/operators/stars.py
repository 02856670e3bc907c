"""Connected components by alternating large-star and small-star steps.

Each step rewrites every edge towards the least neighbour of its ends.  A step
is one aggregation with map-side combine and one equi-join, whose hot keys the
adaptive skew join splits; nothing is gathered per component.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.ship import ship
from tessella.plans.store import Scratch

#: Some MB in a worker's memory.
SMALL = 100_000


def _towards_least(pairs: DataFrame, both: bool, spread: bool = False) -> DataFrame:
    """pairs (u, v): for every u the edges (v, m) and, for small stars, (u, m); m is the least of u and its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    joined = pairs.join(least.hint("merge") if spread else least, pairs["u"] == F.col("k"))
    if both:  # large star: only the larger neighbours move
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    moved = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))


def _in_one_task(batches):
    """Union by least id over all edges of a small graph."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch["src"].tolist(), batch["dst"].tolist(), strict=True):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    yield pd.DataFrame({"id": list(parent), "label": [find(x) for x in parent]}, dtype="int64")


def star_components(edges: DataFrame, scratch: Scratch | None = None, max_rounds: int = 64, small: int = SMALL, spread: bool = False) -> DataFrame:
    """edges (src, dst) -> (id, label): the least id of each end's component.

    Up to ``small`` edges, which are counted first, one task joins them; more
    edges go through the steps.  Both ways give the same labels.

    spread: no round's table goes through the driver to every task, however
    small its files make it look; compressed ids are far larger in memory.

    Loops, repeated edges and both directions are allowed; rows with a null
    end are ignored.  An empty table gives an empty table.
    """
    scratch = scratch or Scratch(edges.sparkSession, "stars")
    known = edges.where("src is not null and dst is not null")
    known = scratch.keep(known.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")))
    if known.count() <= small:
        ship(scratch.spark)
        return known.repartition(1).mapInPandas(_in_one_task, "id long, label long")
    ids = known.select(F.col("src").alias("id")).union(known.select("dst")).distinct()
    now = known.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now, before = scratch.keep(now), None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        large = _towards_least(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), True, spread)
        small = _towards_least(large.where("u > v"), False, spread).where("u <> v").distinct()
        fresh = scratch.keep(small)
        scratch.drop(now)
        now = fresh
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    found = now.select(F.col("u").alias("id"), F.col("v").alias("label"))
    return ids.join(found.hint("merge") if spread else found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
