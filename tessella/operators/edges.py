"""Edge lists: tables (src, dst[, w]) and the steps that bring them into standard form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.reducers import reducer
from tessella.plans.rank import with_rank


def weighted(edges: DataFrame) -> bool:
    return "w" in edges.columns


def _with_w(edges: DataFrame, *columns: Column) -> list[Column]:
    return [*columns, *([F.col("w")] if weighted(edges) else [])]


def remove_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def remove_duplicates(edges: DataFrame) -> DataFrame:
    """One row for each (src, dst), with the least of its weights."""
    return edges.groupBy("src", "dst").agg(F.min("w").alias("w")) if weighted(edges) else edges.select("src", "dst").distinct()


def node_labels(edges: DataFrame) -> DataFrame:
    """id: all labels that occur."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def relabel_nodes(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with labels 0 to n-1 in the order of the old ones, and the table (id, label)."""
    labels = with_rank(node_labels(edges), "id", name="new").select(F.col("new").alias("id"), F.col("id").alias("label"))
    a = labels.select(F.col("id").alias("s"), F.col("label").alias("src"))
    b = labels.select(F.col("id").alias("d"), F.col("label").alias("dst"))
    out = edges.join(a, "src").join(b, "dst")
    return out.select(*_with_w(edges, F.col("s").alias("src"), F.col("d").alias("dst"))), labels


def symmetrize_edges(edges: DataFrame) -> DataFrame:
    """All edges and their reverses."""
    return edges.unionByName(edges.select(*_with_w(edges, F.col("dst").alias("src"), F.col("src").alias("dst"))))


def sort_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("src", "dst")


def standardize_edges(edges: DataFrame, weight_reduce: str | None = None, symmetric: bool = False, sort: bool = False, return_labels: bool = False):
    """Loop-free, unique edges with labels 0 to n-1.

    symmetric: an edge and its reverse are one, and both are returned.
    weight_reduce: how the weights of equal edges are combined; None takes the
    least, 'count' their number (also without weights), else a named reduction.
    """
    out = edges.select(*_with_w(edges, F.col("src"), F.col("dst")))
    if symmetric:
        out = out.select(*_with_w(out, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")))
    out = remove_loops(out)
    if weight_reduce == "count":
        out = out.groupBy("src", "dst").agg(F.count("*").alias("w"))
    elif weight_reduce is None:
        out = remove_duplicates(out)
    elif not weighted(out):
        raise ValueError("a reduction of weights needs weights")
    else:
        out = out.groupBy("src", "dst").agg(reducer(weight_reduce)("w").alias("w"))
    out, labels = relabel_nodes(out)
    if symmetric:
        out = symmetrize_edges(out)
    if sort:
        out = sort_edges(out)
    return (out, labels) if return_labels else out


def edges_from_dataframe(df: DataFrame, source: str, target: str, weight: str | None = None, **options):
    """Columns of any table as a standard edge list; options as for :func:`standardize_edges`."""
    picked = [F.col(source).cast("long").alias("src"), F.col(target).cast("long").alias("dst")]
    return standardize_edges(df.select(*picked, *([F.col(weight).alias("w")] if weight else [])), **options)


def subgraph(edges: DataFrame, nodes: DataFrame, one_hop: bool = False) -> DataFrame:
    """Edges with both ends in ``nodes`` (id), or at least one if ``one_hop``."""
    ids = nodes.select("id").distinct()
    if not one_hop:
        return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns)
    s, d = ids.select(F.col("id").alias("src"), F.lit(True).alias("has_s")), ids.select(F.col("id").alias("dst"), F.lit(True).alias("has_d"))
    return edges.join(s, "src", "left").join(d, "dst", "left").where("has_s or has_d").select(edges.columns)


def pack_edges(edges: DataFrame, forward_only: bool = False, sort: bool = False) -> DataFrame:
    """packed: both labels in one number; labels need 32 bits at most."""
    out = edges.where("src < dst") if forward_only else edges
    ok = F.col("src").between(0, 0xFFFFFFFF) & F.col("dst").between(0, 0xFFFFFFFF)
    checked = F.when(ok, F.shiftleft("src", 32).bitwiseOR(F.col("dst"))).otherwise(F.raise_error(F.lit("labels of packed edges need 32 bits at most")).cast("long"))
    out = out.select(checked.alias("packed"))
    return out.orderBy(F.shiftrightunsigned("packed", 32), F.col("packed").bitwiseAND(0xFFFFFFFF)) if sort else out


def unpack_edges(packed: DataFrame, symmetric: bool = False, sort: bool = False) -> DataFrame:
    out = packed.select(F.shiftrightunsigned("packed", 32).alias("src"), F.col("packed").bitwiseAND(F.lit(0xFFFFFFFF)).alias("dst"))
    out = symmetrize_edges(out) if symmetric else out
    return sort_edges(out) if sort else out
