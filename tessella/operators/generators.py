"""Graph generators.  Random ones draw by hash of row and seed, so that a lost task draws the same again; ``draw`` is the function that does."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.reducers import uniform
from tessella.operators.edges import standardize_edges, symmetrize_edges
from tessella.operators.partition import random_permutation

Draw = Callable[..., Column]

# The friendships of a karate club of 34 members, and the side that each member took.
KARATE = """
0-1 0-2 0-3 0-4 0-5 0-6 0-7 0-8 0-10 0-11 0-12 0-13 0-17 0-19 0-21 0-31 1-2 1-3 1-7 1-13 1-17 1-19 1-21 1-30
2-3 2-7 2-8 2-9 2-13 2-27 2-28 2-32 3-7 3-12 3-13 4-6 4-10 5-6 5-10 5-16 6-16 8-30 8-32 8-33 9-33 13-33 14-32
14-33 15-32 15-33 18-32 18-33 19-33 20-32 20-33 22-32 22-33 23-25 23-27 23-29 23-32 23-33 24-25 24-27 24-31 25-31
26-29 26-33 27-33 28-31 28-33 29-32 29-33 30-32 30-33 31-32 31-33 32-33
"""
SIDES = [1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 1, 1, 1, 1, 0, 0, 1, 1, 0, 1, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]


def complete_graph(spark: SparkSession, n: int) -> DataFrame:
    """All ordered pairs of different nodes, by arithmetic on one range."""
    i, rest = F.col("id"), max(1, n - 1)
    src, k = F.floor(i / rest).cast("long"), i % rest
    return spark.range(n * (n - 1)).select(src.alias("src"), (k + (k >= src).cast("long")).alias("dst"))


def gnp(spark: SparkSession, n: int, p: float, seed: int = 0, draw: Draw = uniform) -> DataFrame:
    """As many random pairs as a binomial draw says, in standard form."""
    m = int(np.random.default_rng(seed).binomial(n * (n - 1) // 2, p))
    pick = lambda k: F.floor(draw("id", F.lit(k), seed=seed) * n).cast("long")
    return standardize_edges(spark.range(m).select(pick(0).alias("src"), pick(1).alias("dst")))


def karate_club_graph(spark: SparkSession) -> DataFrame:
    pairs = [tuple(map(int, x.split("-"))) for x in KARATE.split()]
    return spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src long, dst long")


def karate_club_sides(spark: SparkSession) -> DataFrame:
    """id, community: the side of each member when the club split."""
    return spark.createDataFrame(list(enumerate(SIDES)), "id long, community int")


def random_tree(spark: SparkSession, n: int, seed: int = 0, draw: Draw = uniform) -> DataFrame:
    """Each node but the first linked to one before it, both directions."""
    up = F.floor(draw("id", seed=seed) * F.col("id")).cast("long")
    return symmetrize_edges(spark.range(1, n).select(F.col("id").alias("src"), up.alias("dst")))


def rmat(spark: SparkSession, scale: int, edge_factor: int = 16, p: float | tuple = 0.57, weighted: bool = False, permute: bool = True, standardize: bool = True, seed: int = 0, draw: Draw = uniform) -> DataFrame:
    """2**scale nodes and edge_factor times as many edges; each bit of both ends falls into a quadrant with the chances ``p``."""
    if isinstance(p, float) and 0 <= p <= 1:
        a, b, c, d = p, *[(1 - p) / 3] * 3
    elif isinstance(p, tuple) and len(p) == 4 and all(0 <= x <= 1 for x in p) and abs(sum(p) - 1) < 1e-9:
        a, b, c, d = p
    else:
        raise ValueError(f"{p} are no chances of quadrants")
    top = spark.range(2**scale * edge_factor)
    r = lambda bit: draw("id", F.lit(bit), seed=seed)
    src = dst = F.lit(0).cast("long")
    for bit in range(scale):
        src = src + F.when(r(bit) >= a + b, 1 << bit).otherwise(0).cast("long")
        dst = dst + F.when(((r(bit) >= a) & (r(bit) < a + b)) | (r(bit) >= a + b + c), 1 << bit).otherwise(0).cast("long")
    out = top.select(src.alias("src"), dst.alias("dst"), *([draw("id", F.lit(-1), seed=seed).alias("w")] if weighted else []))
    if permute:
        new = random_permutation(spark, 2**scale, seed, draw)
        out = out.join(new.select(F.col("idx").alias("src"), F.col("value").alias("s")), "src").join(new.select(F.col("idx").alias("dst"), F.col("value").alias("t")), "dst")
        out = out.select(F.col("s").alias("src"), F.col("t").alias("dst"), *(["w"] if weighted else []))
    return standardize_edges(out) if standardize else out


def path_graph(spark: SparkSession, n: int) -> DataFrame:
    return symmetrize_edges(spark.range(max(0, n - 1)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))


def watts_strogatz_graph(spark: SparkSession, n: int, k: int, p: float, seed: int = 0, draw: Draw = uniform) -> DataFrame:
    """Each node linked to its k nearest on a ring; an edge's end is drawn anew with chance ``p``."""
    offset = F.col("id") % k - k // 2
    offset = offset + (offset >= 0).cast("long")
    v = F.floor(F.col("id") / k).cast("long")
    ring = F.pmod(v + offset, F.lit(n))
    far = F.floor(draw("id", F.lit(1), seed=seed) * n).cast("long")
    rows = spark.range(n * k).select(v.alias("src"), F.when(draw("id", F.lit(0), seed=seed) < p, far).otherwise(ring).alias("dst"))
    return standardize_edges(rows)
