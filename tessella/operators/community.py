"""Communities by label propagation (CDLP)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.reducers import uniform
from tessella.operators.degree import node_count
from tessella.plans.rank import with_rank
from tessella.plans.store import Scratch


def cdlp(edges: DataFrame, initial_labels: DataFrame | None = None, immune_nodes: DataFrame | None = None, randomize: bool = True, max_iter: int | None = 20, full: bool = True) -> tuple[int, int, bool, DataFrame]:
    """(rounds, communities, converged, (id, label)).

    In each round every node takes the most frequent label among its
    in-neighbours, the least of equally frequent ones; immune nodes (id) keep
    theirs.  It ends when labels are those of the round before or of the one
    before that, or one is left.  initial_labels: (id, label); else the ids, or
    a permutation of them if ``randomize``.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "cdlp")
    edges = scratch.keep(edges.select("src", "dst"))
    if initial_labels is not None:
        start = initial_labels.select("id", "label")
    else:
        nodes = spark.range(node_count(edges)) if full else edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        start = with_rank(nodes, uniform("id", seed=2), "id", name="label", scratch=scratch).select("id", "label") if randomize else nodes.withColumn("label", F.col("id"))
    immune = immune_nodes.select("id", F.lit(True).alias("immune")) if immune_nodes is not None else None
    now = scratch.keep(start.withColumn("old", F.lit(None).cast("long")))
    k, converged = 0, False
    communities = now.select("label").distinct().count()
    while not converged and (max_iter is None or k < max_iter):
        k += 1
        votes = edges.join(now.select(F.col("id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("id"), "label").agg(F.count("*").alias("n"))
        chosen = votes.groupBy("id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("fresh"))
        out = now.join(chosen, "id", "left")
        fresh = F.coalesce("fresh", "label")
        if immune is not None:
            out = out.join(immune, "id", "left")
            fresh = F.when(F.col("immune"), F.col("label")).otherwise(fresh)
        state = scratch.keep(out.select("id", fresh.alias("label"), F.col("label").alias("old"), (fresh == F.col("label")).alias("same"), fresh.eqNullSafe(F.col("old")).alias("back")))
        same, back, communities = state.agg(F.bool_and("same"), F.bool_and("back"), F.countDistinct("label")).first()
        converged = bool(same or back or communities == 1)
        scratch.drop(now)
        now = state.select("id", "label", "old")
    return k, communities, converged, now.select("id", "label")
