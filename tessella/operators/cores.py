"""k-cores and core numbers of a symmetric graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.degree import dense, node_count
from tessella.operators.edges import node_labels
from tessella.plans.layout import Layout
from tessella.plans.ship import ship
from tessella.plans.store import Scratch


class _Peeling:
    """Degrees that fall as nodes are taken away; the edges stay where they lie, and each round only the nodes that it takes away meet them."""

    def __init__(self, edges: DataFrame, scratch: Scratch):
        self.scratch = scratch
        self.by_src = Layout(edges, "src", scratch)
        self.state = scratch.keep(edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")))
        self.rounds = 0

    def down_to(self, k: int) -> bool:
        """Takes away nodes of degree below ``k`` until there is none; whether any node is left."""
        while True:
            self.rounds += 1
            weak = self.state.where(F.col("degree") < k).select("id")
            if weak.isEmpty():
                return not self.state.isEmpty()
            lost = self.by_src.join(weak).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("lost"))
            kept = self.state.where(F.col("degree") >= k).join(lost, "id", "left").select("id", (F.col("degree") - F.coalesce("lost", F.lit(0))).alias("degree"))
            fresh = self.scratch.keep(kept)
            self.scratch.drop(self.state)
            self.state = fresh


def k_core(edges: DataFrame, k: int, full: bool = True) -> DataFrame:
    """id, in_core: for all labels from 0 to the greatest, or those that occur."""
    scratch = Scratch(edges.sparkSession, "core")
    start = scratch.keep(edges.select("src", "dst"))
    peeling = _Peeling(start, scratch)
    peeling.down_to(k)
    found = peeling.state.select("id", F.lit(True).alias("in_core"))
    if full:
        return dense(found, node_count(start), in_core=k <= 0)
    return node_labels(start).join(found, "id", "left").select("id", F.coalesce("in_core", F.lit(k <= 0)).alias("in_core"))


def k_core_decomp(edges: DataFrame, k_max: int = 0) -> tuple[int, int, DataFrame]:
    """(rounds, last k, (id, core)): peels for k = 1, 2, ... until nothing is left or k passes ``k_max``."""
    scratch = Scratch(edges.sparkSession, "core")
    start = scratch.keep(edges.select("src", "dst"))
    peeling = _Peeling(start, scratch)
    core, k = scratch.keep(node_labels(start).withColumn("core", F.lit(1).cast("long"))), 1
    while True:
        if not peeling.down_to(k + 1):
            return peeling.rounds, k, core
        k += 1
        if k_max and k > k_max:
            return peeling.rounds, k, core
        alive = peeling.state.select("id", F.lit(True).alias("alive"))
        fresh = scratch.keep(core.join(alive, "id", "left").select("id", F.when(F.col("alive"), F.lit(k).cast("long")).otherwise(F.col("core")).alias("core")))
        scratch.drop(core)
        core = fresh


#: Nodes or edges in one part of the core numbers' state, about.
PART = 1 << 20
STATE = "part int, ids binary, cores binary, counts binary, id long, old long, new long"


def _settle(part: int, ids: np.ndarray, was: np.ndarray, counts: np.ndarray) -> pa.Table:
    """A row with the part's state after a fall to the h-index, and one for each node that fell.

    ``counts`` holds was + 1 counts a node: of its neighbours by their number,
    cut at the node's own.
    """
    start = np.cumsum(was + 1) - (was + 1)
    level = np.arange(len(counts)) - np.repeat(start, was + 1)
    upto = np.cumsum(counts)
    atleast = np.repeat(upto[start + was], was + 1) - upto + counts
    now = np.maximum.reduceat(np.where(atleast >= level, level, 0), start)
    cut = np.repeat(now, was + 1)
    counts = np.where(level == cut, atleast, counts)[level <= cut]
    fell = np.flatnonzero(now < was)
    none = [None] * len(fell)
    columns = [np.full(len(fell) + 1, part, "int32")]
    columns += [pa.array([x.astype("int64").tobytes(), *none], pa.binary()) for x in (ids, now, counts)]
    columns += [pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(x[fell].astype("int64"))]) for x in (ids, was, now)]
    return pa.table([pa.array(columns[0]), *columns[1:]], names=["part", "ids", "cores", "counts", "id", "old", "new"])


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[name].to_numpy() for name in names]


def _first(key: tuple, told: pa.Table) -> pa.Table:
    ids, new, n = _numbers(told, "id", "new", "n")
    ids, place = np.unique(ids, return_inverse=True)
    degree = np.bincount(place, n).astype("int64")
    start = np.cumsum(degree + 1) - (degree + 1)
    counts = np.bincount(start[place] + np.minimum(new, degree[place]), n, int((degree + 1).sum())).astype("int64")
    return _settle(key[0].as_py(), ids, degree, counts)


def _next(key: tuple, state: pa.Table, told: pa.Table) -> pa.Table:
    ids, cores, counts = (np.frombuffer(state[c][0].as_py(), "int64") for c in ("ids", "cores", "counts"))
    if told.num_rows:
        to, old, new, n = _numbers(told, "id", "old", "new", "n")
        place = np.searchsorted(ids, to)
        own = cores[place]
        old, new = np.minimum(old, own), np.minimum(new, own)
        start = (np.cumsum(cores + 1) - (cores + 1))[place]
        counts = counts + (np.bincount(start + new, n, len(counts)) - np.bincount(start + old, n, len(counts))).astype("int64")
    return _settle(key[0].as_py(), ids, cores, counts)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, cores in zip(batch["ids"], batch["cores"], strict=True):
            yield pa.record_batch([np.frombuffer(x.as_py(), "int64") for x in (ids, cores)], names=["id", "core"])


def core_number(edges: DataFrame, max_iter: int | None = None) -> DataFrame:
    """id, core: each node's number falls to the h-index of its neighbours' numbers until none changes.

    Only nodes whose number fell tell it to their neighbours, which keep counts
    of the numbers they know, cut at their own.  The counts lie in parts of
    about ``PART`` edges; what nodes tell a hub is added up before it moves.
    """
    spark = edges.sparkSession
    ship(spark)
    scratch = Scratch(spark, "core")
    edges = scratch.keep(edges.select("src", "dst"))
    degrees = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("core"))
    if max_iter is not None and max_iter < 1:
        return degrees
    by_dst = Layout(edges, "dst", scratch, packed=True)
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), edges.count() // PART)

    def told(values: DataFrame) -> DataFrame:
        """What the neighbours (id) of nodes get to know of their values."""
        news = by_dst.join(values).drop("dst").withColumnRenamed("src", "id")
        one = F.lit(1).cast("long").alias("n")
        if by_dst.heavy is None:
            news = news.select("*", one)
        else:
            named = news.columns
            hub = news.join(F.broadcast(by_dst.heavy), F.col("id") == F.col("node"), "left")
            news = hub.where("node is null").select(*named, one).unionByName(hub.where("node is not null").groupBy(*named).agg(F.count("*").alias("n")))
        return news.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))

    now = scratch.keep(told(degrees.withColumnRenamed("core", "new")).groupBy("part").applyInArrow(_first, STATE))
    k = 1
    while max_iter is None or k < max_iter:
        fell = now.where("id is not null").select("id", "old", "new")
        if fell.isEmpty():
            break
        k += 1
        state = now.where("ids is not null").select("part", "ids", "cores", "counts")
        fresh = scratch.keep(state.groupBy("part").cogroup(told(fell).groupBy("part")).applyInArrow(_next, STATE))
        scratch.drop(now)
        now = fresh
    return now.where("ids is not null").select("ids", "cores").mapInArrow(_opened, "id long, core long")
