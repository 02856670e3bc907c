"""Exact top-k by inner product: dual-tree search over cover trees.

Rows are dealt to the nearest of a few pivots and so into blocks of bounded
size.  A query first searches its own block, which gives it a k-th score to
beat; it goes on only to blocks whose bound passes that.  In a task the
queries and the data are both indexed by cover trees (in the simplified form
of Izbicki and Shelton, 2015): a node of level i covers its rows within
BASE**i, has itself among its children, and its children, of a lower level j,
lie more than BASE**j apart.  For a pair of nodes no inner product exceeds
<cq, cr> + Rq |cr| + Rr |cq| + Rq Rr, R being the true radii, so that the pair
is dropped if this is below the worst k-th score of the query node's queries.
Vectors are integers; scores are exact; of equal scores the smaller vec_id is
better.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.plans.ship import ship
from tessella.plans.store import Scratch

K = 10
BASE = 1.5
LEAF_Q, LEAF_R, BATCH = 8, 64, 256
DATA_BLOCK, QUERY_BLOCK = 4_096, 2_048
PIVOTS, SAMPLE = 256, 2_048  # of the rows, by a hash of their ids, so many are looked at for pivots
LONG = (-(1 << 63), (1 << 63) - 1)


def _distances(x: np.ndarray, squares: np.ndarray, row: int) -> np.ndarray:
    return np.sqrt(np.maximum(0, squares + squares[row] - 2 * (x @ x[row])))


class Node:
    """A node over ``rows`` of ``x``; its centre is the first of them.

    level: the least i with all rows within BASE**i (None if all are equal).
    Nodes of few rows have no children.  What the children share is kept as
    arrays, so that their bounds are computed together.
    """

    __slots__ = ("centre", "radius", "norm", "rows", "level", "children", "centres", "radii", "norms")

    def __init__(self, x: np.ndarray, rows: np.ndarray, leaf: int, squares: np.ndarray | None = None, off: np.ndarray | None = None):
        squares = (x * x).sum(axis=1) if squares is None else squares
        self.rows, self.children = rows, []
        self.centre, self.norm = x[rows[0]], float(np.sqrt(squares[rows[0]]))
        own, size = x[rows], squares[rows]
        off = _distances(own, size, 0) if off is None else off
        self.radius = float(off.max()) * (1 + 1e-9) + 1e-6  # above all rounding
        top = float(off.max())
        self.level = math.ceil(math.log(top, BASE)) if top > 1e-6 else None
        if len(rows) <= leaf or self.level is None:
            return
        # itself, then the farthest row each time, until all are covered by the lower level's radius
        low = self.level - 1
        while BASE**low >= top:
            low -= 1
        near, owner, centres = off, np.zeros(len(rows), np.int64), [0]
        while near.max() > BASE**low:
            far = int(near.argmax())
            d = _distances(own, size, far)
            closer = d < near
            owner[closer] = len(centres)
            near = np.where(closer, d, near)
            centres.append(far)
        order = np.argsort(owner, kind="stable")
        edge = np.searchsorted(owner[order], np.arange(len(centres) + 1))
        for c, far in enumerate(centres):
            mine = order[edge[c] : edge[c + 1]]
            mine = np.r_[far, mine[mine != far]]
            self.children.append(Node(x, rows[mine], leaf, squares, near[mine]))
        self.centres = np.array([c.centre for c in self.children])
        self.radii = np.array([c.radius for c in self.children])
        self.norms = np.array([c.norm for c in self.children])


def bounds(q: Node, centres: np.ndarray, radii: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """What no inner product of a row of ``q`` with one of the others can exceed."""
    slack = q.radius * norms + radii * q.norm + q.radius * radii
    most = centres @ q.centre + slack
    return most + 1e-9 * (np.abs(most) + slack + q.norm * norms) + 1e-6


class Search:
    """The k best data rows of each query; of equal scores the smaller id is better.  ``least``: scores that a query's results must reach."""

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, r: np.ndarray, r_ids: np.ndarray, k: int, least: np.ndarray | None = None):
        self.q, self.q_ids, self.r, self.r_ids, self.k = q, q_ids, r, r_ids, k
        self.score = np.full((len(q), k), -np.inf)
        self.ids = np.full((len(q), k), np.iinfo(np.int64).max)
        self.least = np.full(len(q), -np.inf) if least is None else least
        self.products = 0
        if len(q) and len(r):
            root = Node(r, np.arange(len(r)), LEAF_R)
            self.visit(Node(q, np.arange(len(q)), LEAF_Q), root)

    def worst(self, node: Node) -> float:
        return float(np.maximum(self.score[node.rows, -1], self.least[node.rows]).min())

    def visit(self, q: Node, r: Node) -> None:
        if float(bounds(q, r.centre[None], np.array([r.radius]), np.array([r.norm]))[0]) < self.worst(q):
            return
        if q.children and (q.radius > r.radius / 2 or not r.children):  # small query groups have tight bounds
            for child in q.children:
                self.visit(child, r)
        elif not r.children:
            self.leaf(q, r.rows)
        else:
            most = bounds(q, r.centres, r.radii, r.norms)
            order = np.argsort(-most, kind="stable")
            single = [i for i in order.tolist() if not r.children[i].children]
            at = 0
            while at < len(single) and most[single[at]] >= self.worst(q):  # leaves of like bounds together
                some, held = [], 0
                while at < len(single) and held < BATCH:
                    some.append(r.children[single[at]].rows)
                    held += len(some[-1])
                    at += 1
                self.leaf(q, np.concatenate(some))
            for i in order.tolist():
                if r.children[i].children:
                    if most[i] < self.worst(q):
                        break
                    self.visit(q, r.children[i])

    def leaf(self, q: Node, rows: np.ndarray) -> None:
        if q.children:
            for child in q.children:
                self.leaf(child, rows)
            return
        ids = self.r_ids[rows]
        self.products += len(q.rows) * len(rows)
        got = self.q[q.rows] @ self.r[rows].T
        got[self.q_ids[q.rows][:, None] == ids[None, :]] = -np.inf
        floor = np.maximum(self.score[q.rows, -1], self.least[q.rows])
        for i in np.flatnonzero(got.max(axis=1) >= floor).tolist():
            row = q.rows[i]
            may = np.flatnonzero((got[i] >= floor[i]) & (got[i] > -np.inf))
            score, name = np.r_[self.score[row], got[i, may]], np.r_[self.ids[row], ids[may]]
            best = np.lexsort((name, -score))[: self.k]
            self.score[row], self.ids[row] = score[best], name[best]


def _by_hand(q, q_ids, r, r_ids, k) -> list[tuple[int, int, int]]:
    """For components so large that a double can't hold a score: whole numbers of any size, cut to 64 bits at the end."""
    out = []
    rows = [(int(i), [int(c) for c in v]) for i, v in zip(r_ids, r, strict=True)]
    for i, v in zip(q_ids, q, strict=True):
        whole = [int(c) for c in v]
        scored = sorted((-sum(a * b for a, b in zip(whole, w, strict=True)), j) for j, w in rows if j != i)
        out += [(int(i), j, min(max(-s, LONG[0]), LONG[1])) for s, j in scored[:k]]
    return out


FOUND = "query_id long, vec_id long, score long"


def _found(q: np.ndarray, q_ids: np.ndarray, r: np.ndarray, r_ids: np.ndarray, k: int, least: np.ndarray | None = None) -> pd.DataFrame:
    names = [x.split()[0] for x in FOUND.split(",")]
    if not len(q) or not len(r):
        return pd.DataFrame([], columns=names)
    if _large(q, r):
        return pd.DataFrame(_by_hand(q, q_ids, r, r_ids, k), columns=names)
    found = Search(q.astype(np.float64), q_ids, r.astype(np.float64), r_ids, k, least)
    real = found.score > -np.inf
    return pd.DataFrame({"query_id": np.repeat(q_ids, k)[real.ravel()], "vec_id": found.ids[real], "score": found.score[real].astype(np.int64)}, columns=names)


def _large(q: np.ndarray, r: np.ndarray) -> bool:
    """Whether a double may not hold a score."""
    top = lambda x: max(float(np.abs(x.astype(np.float64)).max(initial=0)), 1)
    return top(q) * top(r) * max(1, q.shape[1]) >= 2**53


def _own_block(k: int):
    """The best rows of each query's own block."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, ids, asks = np.stack(rows["v"].to_numpy()), rows["vec_id"].to_numpy(np.int64), rows["asks"].to_numpy(bool)
        return _found(x[asks], ids[asks], x, ids, k)

    return run


def _other_block(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=[x.split()[0] for x in FOUND.split(",")])
        q, r = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        return _found(q, left["vec_id"].to_numpy(np.int64), r, right["vec_id"].to_numpy(np.int64), k, left["least"].to_numpy(np.float64))

    return run


def _pivots(sample: list[np.ndarray], most: int) -> np.ndarray:
    """Of the sampled vectors so many that lie far apart: the farthest from all before each time."""
    x = np.array(sample, np.float64)
    squares = (x * x).sum(axis=1)
    near, centres = _distances(x, squares, 0), [0]
    while len(centres) < min(most, len(x)) and near.max() > 0:
        centres.append(int(near.argmax()))
        near = np.minimum(near, _distances(x, squares, centres[-1]))
    return x[centres]


def _dealt(pivots: dict[int, np.ndarray]):
    """The nearest pivot of each row, and the distance to it."""

    def run(batches):
        for batch in batches:
            out = []
            for dim, part in batch.groupby("dim"):
                x = np.stack(part["v"].to_numpy()).astype(np.float64).reshape(len(part), dim)
                c = pivots.get(dim, np.zeros((1, dim)))
                square = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)
                near = square.argmin(axis=1)
                off = np.sqrt(((x - c[near]) ** 2).sum(axis=1))
                out.append(part.assign(pivot=near, off=off))
            if out:
                yield pd.concat(out)[["dim", "vec_id", "v", "asks", "pivot", "off"]]

    return run


def _visits(pivots: dict[int, np.ndarray], radii: dict[tuple[int, int], tuple[float, int]]):
    """A row for each block but its own that a query must look into: where the bound reaches its k-th score."""

    def run(batches):
        for batch in batches:
            out = []
            for dim, part in batch.groupby("dim"):
                x = np.stack(part["v"].to_numpy()).astype(np.float64).reshape(len(part), dim)
                c = pivots.get(dim, np.zeros((1, dim)))
                norms = np.sqrt((x * x).sum(axis=1))
                for p in range(len(c)):
                    radius, salts = radii.get((dim, p), (0.0, 0))
                    if not salts:
                        continue
                    most = x @ c[p] + norms * radius
                    most += 1e-9 * (np.abs(most) + norms * (radius + np.linalg.norm(c[p]))) + 1e-6
                    reach = most >= part["least"].to_numpy(np.float64)
                    for s in range(salts):
                        go = reach & ~((part["pivot"].to_numpy() == p) & (part["salt"].to_numpy() == s))
                        if go.any():
                            out.append(part[go][["dim", "vec_id", "v", "least"]].assign(pivot=p, salt=s))
            if out:
                yield pd.concat(out)

    return run


def whole_numbers(vector: Column) -> Column:
    """floor(1024 x) of each component as double; null for a vector that is null or holds a null or non-finite component."""
    x = F.transform(vector, lambda c: c.cast("double"))
    ok = vector.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(ok, F.transform(x, lambda c: F.floor(c * 1024).cast("long")))


def top_k(vectors: DataFrame, queries: Column, k: int = K) -> DataFrame:
    """vec_id, embedding -> query_id, rank (from 1), vec_id, score, for the rows that satisfy ``queries``.

    Rows with a null id, a null vector or a null or non-finite component take
    no part; so may a query be null, which is no query.  Ties of the score go
    to the smaller vec_id.  Vectors of different lengths have no product and
    never meet.  Rows repeated with the same id and vector count once; of rows
    with one id and different vectors none is a candidate of another.  Other
    columns are ignored; an empty table gives an empty table.

    The pivots come from a sample of at most SAMPLE rows; they decide only
    where a row is searched.  The driver holds them and a radius and a number
    of blocks for each.  A pivot's rows are dealt over as many blocks as
    DATA_BLOCK asks for, so that a hot cluster is no larger a task.  Scores
    beyond 64 bits are cut to them.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "topk")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding")).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = scratch.keep(rows.where("vec_id is not null and v is not null").dropDuplicates(["vec_id", "v"]).withColumn("dim", F.size("v")))
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("dim", "v").limit(SAMPLE).collect()
    by_dim: dict[int, list[np.ndarray]] = {}
    for dim, v in sample:
        by_dim.setdefault(dim, []).append(np.array(v, np.float64))
    most = min(PIVOTS, max(1, -(-n // DATA_BLOCK)))
    pivots = {dim: _pivots(x, most) for dim, x in by_dim.items()}
    near = scratch.keep(rows.mapInPandas(_dealt(pivots), "dim int, vec_id long, v array<long>, asks boolean, pivot int, off double"))
    found = near.groupBy("dim", "pivot").agg(F.max("off").alias("radius"), F.count("*").alias("n")).collect()
    radii = {(r["dim"], r["pivot"]): (r["radius"] * (1 + 1e-9) + 1e-6, -(-r["n"] // DATA_BLOCK)) for r in found}
    counts = spark.createDataFrame([(d, p, s) for (d, p), (_, s) in radii.items()], "dim int, pivot int, salts int")
    data = scratch.keep(near.drop("off").join(F.broadcast(counts), ["dim", "pivot"]).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int")).drop("salts"))
    block = ["dim", "pivot", "salt"]
    first = scratch.keep(data.groupBy(*block).applyInPandas(_own_block(k), FOUND))
    worst = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("worst"))
    # a score that was cut to 64 bits is no bound
    least = F.when((F.col("n") >= k) & (F.abs("worst") < 2.0**52), F.col("worst")).otherwise(F.lit(float("-inf")))
    asking = data.where("asks").join(worst.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").withColumn("least", least).drop("n", "worst", "asks")
    go = scratch.keep(asking.mapInPandas(_visits(pivots, radii), "dim int, vec_id long, v array<long>, least double, pivot int, salt int"))
    chunks = go.groupBy(*block).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("chunks"))
    ask = go.join(F.broadcast(chunks), block).withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("chunks")).cast("int")).drop("chunks")
    held = data.select(*block, "vec_id", "v").join(F.broadcast(chunks), block).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    later = ask.groupBy(*block, "chunk").cogroup(held.groupBy(*block, "chunk")).applyInPandas(_other_block(k), FOUND)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return first.unionByName(later).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
