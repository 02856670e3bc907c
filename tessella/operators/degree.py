"""Degrees and the order of nodes by degree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.operators.edges import weighted
from tessella.plans.rank import with_rank
from tessella.plans.store import Scratch

#: Ends of edges in one part where different neighbours are counted.
PART = 1 << 20


def node_count(edges: DataFrame) -> int:
    """1 + the greatest label; 0 without edges."""
    return (edges.agg(F.max(F.greatest("src", "dst"))).first()[0] or -1) + 1 if not edges.isEmpty() else 0


def dense(values: DataFrame, n: int, **defaults) -> DataFrame:
    """A row for each id from 0 to n-1, with defaults where ``values`` (id, ...) has none."""
    out = values.sparkSession.range(n).join(values, "id", "left")
    return out.select("id", *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()])


def _share(df: DataFrame, normalize: bool) -> DataFrame:
    """Degrees as parts of their sum; the sum is one row, broadcast."""
    if not normalize:
        return df
    total = F.broadcast(df.agg(F.sum("degree").alias("total")))
    return df.crossJoin(total).select("id", F.try_divide(F.col("degree").cast("double"), F.col("total")).alias("degree"))


def _one_sided(edges: DataFrame, by: str, normalize: bool) -> DataFrame:
    value: Column = F.sum("w") if weighted(edges) else F.count("*")
    counted = edges.groupBy(F.col(by).alias("id")).agg(value.alias("degree"))
    zero = 0.0 if weighted(edges) and dict(edges.dtypes)["w"] in ("double", "float") else 0
    return _share(dense(counted, node_count(edges), degree=zero), normalize)


def in_degree(edges: DataFrame, normalize: bool = False, symmetric: bool = False) -> DataFrame:
    """id, degree for all labels from 0 to the greatest: number of edges (or sum of weights) that end there."""
    return degree(edges, normalize, True) if symmetric else _one_sided(edges, "dst", normalize)


def out_degree(edges: DataFrame, normalize: bool = False, symmetric: bool = False) -> DataFrame:
    """As :func:`in_degree`, for edges that begin there."""
    return degree(edges, normalize, True) if symmetric else _one_sided(edges, "src", normalize)


def degree(edges: DataFrame, normalize: bool = False, symmetric: bool = False) -> DataFrame:
    """id, degree for the labels that occur: different neighbours, or the sum of the weights of all edges at the node.

    symmetric: the table holds both directions, so that one side is enough.
    """
    if symmetric:
        value = F.sum("w") if weighted(edges) else F.count("*")
        return _share(edges.groupBy(F.col("src").alias("id")).agg(value.alias("degree")), normalize)
    if not weighted(edges):
        # tasks stay of one size: each end moves once, to its pair of nodes, and counts move from there
        edges = Scratch(edges.sparkSession, "degree").keep(edges.select("src", "dst"))
        parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * edges.count() // PART)
    both = F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other"))))
    ends = edges.select(both.alias("e"), *([F.col("w")] if weighted(edges) else [])).select("e.*", *(["w"] if weighted(edges) else []))
    if weighted(edges):
        return _share(ends.groupBy("id").agg(F.sum("w").alias("degree")), normalize)
    pairs = ends.repartition(parts, "id", "other").distinct()
    return _share(pairs.groupBy("id").agg(F.count("other").alias("degree")), normalize)


def degree_order(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of a symmetric graph ranked by (degree, id): the table (id, rank), and each edge once as ranks (x < y)."""
    ranks = with_rank(degree(edges, symmetric=True), "degree", "id").select("id", "rank")
    x, y = ranks.select(F.col("id").alias("src"), F.col("rank").alias("x")), ranks.select(F.col("id").alias("dst"), F.col("rank").alias("y"))
    return ranks, edges.join(x, "src").join(y, "dst").where("x < y").select("x", "y")


def per_group_total(edges: DataFrame, by: str = "src") -> DataFrame:
    """Each edge with the sum of weights at its ``by`` end."""
    return edges.withColumn("total", F.sum("w").over(W.partitionBy(by)))
