"""Sparse matrices as tables (row, col, val) with a shape of (rows, columns)."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.reducers import reducer
from tessella.plans.rank import with_rank, with_running_sum
from tessella.plans.ship import ship
from tessella.plans.store import Scratch

#: Products from which spgemm warns before it expands them.
MANY_PRODUCTS = 10**10
#: Inner indices of one range of a product, and how many ranges at most.
RANGE, MANY_RANGES = 1 << 15, 2000
#: Entries of one part where duplicates are summed.
PART = 1 << 19
#: Rows up to which their sizes are sent to every task.
FEW_ROWS = 1 << 20


def _runs(batches):
    """Each batch (row, col, val, rank) as lists, one row for each run of ranks that follow each other."""
    for batch in batches:
        if batch.num_rows:
            rank = batch.column("rank").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(rank) != 1) + 1, [len(rank)]])
            ends = pa.array(cuts, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(rank[cuts[:-1]]), *[pa.ListArray.from_arrays(ends, batch.column(c)) for c in ("row", "col", "val")]], names=["start", "row", "col", "val"])


def _products(a: DataFrame, b: DataFrame, inner: int) -> DataFrame:
    """(row, k, a) and (k, col, b) -> row, col, a, b for each pair of the same k.

    Entries lie by ranges of ``RANGE`` inner indices, both sides in one shuffle,
    so that pairs of near inner indices are added up where they are made and
    only sums move; sums of ranges are as many as cells that the ranges reach.
    """
    spark = a.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(inner // RANGE, MANY_RANGES))
    left = a.select("k", F.struct("row", "a").alias("left"))
    right = b.select("k", F.struct("col", "b").alias("right"))
    both = left.unionByName(right, allowMissingColumns=True).where("k is not null").repartitionByRange(parts, "k")
    lists = both.groupBy("k").agg(F.collect_list("left").alias("ls"), F.collect_list("right").alias("rs")).where("size(ls) > 0 and size(rs) > 0")
    return lists.select(F.explode("ls").alias("l"), "rs").select("l", F.explode("rs").alias("r")).select("l.row", "r.col", "l.a", "r.b")


@dataclass(eq=False)
class SparseMatrix:
    """layout: 'coo', 'csr' (ordered by row) or 'csc' (by column); it says how entries are ordered when they are listed, not how they are computed with."""

    entries: DataFrame
    shape: tuple[int, int]
    layout: str = "coo"

    @classmethod
    def from_coo(cls, entries: DataFrame, shape: tuple[int, int] | None = None, sum_duplicates: bool = False) -> SparseMatrix:
        """Any table with row, col and val (default 1).  Without a shape, the least that holds all entries."""
        val = F.col("val") if "val" in entries.columns else F.lit(1).cast("long")
        rows = entries.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), val.alias("val"))
        lo, r, c, n = rows.agg(F.min(F.least("row", "col")), F.max("row"), F.max("col"), F.count("*")).first()
        if lo is not None and lo < 0:
            raise ValueError("indices must not be negative")
        least = (0 if r is None else r + 1, 0 if c is None else c + 1)
        if shape is not None and (shape[0] < least[0] or shape[1] < least[1]):
            raise ValueError(f"entries up to {least} do not fit into {shape}")
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        if sum_duplicates and n // PART > parts:  # tasks stay of one size; sums and joins by cell keep these parts
            rows = rows.repartition(n // PART, "row", "col")
        out = cls(rows, tuple(shape) if shape else least)
        return out.sum_duplicates() if sum_duplicates else out

    @classmethod
    def from_dense(cls, rows: DataFrame, shape: tuple[int, int]) -> SparseMatrix:
        """Rows (i, vals): the values that are not 0."""
        cells = rows.select(F.col("i").alias("row"), F.posexplode("vals").alias("col", "val")).where("val <> 0")
        return cls(cells.select("row", F.col("col").cast("long").alias("col"), "val"), shape)

    @property
    def spark(self) -> SparkSession:
        return self.entries.sparkSession

    def _with(self, entries: DataFrame, shape: tuple[int, int] | None = None) -> SparseMatrix:
        return replace(self, entries=entries, shape=shape or self.shape)

    def sum_duplicates(self) -> SparseMatrix:
        return self._with(self.entries.groupBy("row", "col").agg(F.sum("val").alias("val")))

    # layouts

    def to_coo(self) -> SparseMatrix:
        return replace(self, layout="coo")

    def to_csr(self) -> SparseMatrix:
        return replace(self, layout="csr")

    def to_csc(self) -> SparseMatrix:
        return replace(self, layout="csc")

    def _order(self) -> tuple[str, str]:
        return ("col", "row") if self.layout == "csc" else ("row", "col")

    def listed(self) -> DataFrame:
        """Entries in the order of the layout."""
        return self.entries.orderBy(*self._order())

    def indptr(self, axis: str = "row") -> DataFrame:
        """i, ptr for i from 0 to the number of rows (columns): how many entries lie before row i."""
        n = self.shape[0 if axis == "row" else 1]
        counts = self.entries.groupBy((F.col(axis) + 1).alias("i")).agg(F.count("*").alias("n"))
        every = self.spark.range(n + 1).withColumnRenamed("id", "i").join(counts, "i", "left").select("i", F.coalesce("n", F.lit(0)).alias("n"))
        return with_running_sum(every, "n", "i", name="ptr").select("i", F.col("ptr").cast("long").alias("ptr"))

    def transpose(self) -> SparseMatrix:
        turned = {"csr": "csc", "csc": "csr"}.get(self.layout, "coo")
        out = self.entries.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")
        return SparseMatrix(out, (self.shape[1], self.shape[0]), turned)

    def from_matrix(self, values: Column | str) -> SparseMatrix:
        """The same pattern with new values, an expression over row, col and val."""
        value = F.col(values) if isinstance(values, str) else values
        return self._with(self.entries.select("row", "col", value.alias("val")))

    # element by element

    def map_scalar(self, fn: Callable[[Column], Column]) -> SparseMatrix:
        """Applied to stored entries only."""
        return self._with(self.entries.withColumn("val", fn(F.col("val"))))

    def map_vector(self, vector: DataFrame, fn: Callable[[Column, Column], Column]) -> SparseMatrix:
        """Each stored entry with vector (id, x) at its column."""
        self._check(vector)
        met = self.entries.join(vector.select(F.col("id").alias("col"), "x"), "col")
        return self._with(met.select("row", "col", fn(F.col("val"), F.col("x")).alias("val")))

    def _check(self, vector: DataFrame) -> None:
        n = vector.count()
        if n != self.shape[1]:
            raise ValueError(f"a vector of {n} values for {self.shape[1]} columns")

    def _same_shape(self, other: SparseMatrix) -> None:
        if self.shape != other.shape:
            raise ValueError(f"shapes {self.shape} and {other.shape} differ")

    def add(self, other: SparseMatrix, sign: int = 1) -> SparseMatrix:
        self._same_shape(other)
        turned = other.entries if sign > 0 else other.entries.withColumn("val", -F.col("val"))
        return self._with(self.entries.unionByName(turned)).sum_duplicates()

    def hadamard(self, other: SparseMatrix) -> SparseMatrix:
        self._same_shape(other)
        met = self.entries.alias("a").join(other.entries.withColumnRenamed("val", "other"), ["row", "col"])
        return self._with(met.select("row", "col", (F.col("val") * F.col("other")).alias("val")))

    def _binop(self, other, scalar: Callable[[Column], Column], vector: Callable[[Column, Column], Column] | None, matrix: Callable[[SparseMatrix], SparseMatrix] | None) -> SparseMatrix:
        if isinstance(other, (int, float)):
            return self.map_scalar(scalar)
        if isinstance(other, DataFrame) and vector is not None:
            return self.map_vector(other, vector)
        if isinstance(other, SparseMatrix) and matrix is not None:
            return matrix(other)
        raise TypeError(f"no such operation with {type(other).__name__}")

    def __add__(self, other):
        return self._binop(other, lambda v: v + other, lambda v, x: v + x, self.add)

    def __radd__(self, other):
        return self + other

    def __sub__(self, other):
        return self._binop(other, lambda v: v - other, lambda v, x: v - x, lambda m: self.add(m, -1))

    def __rsub__(self, other):
        return self._binop(other, lambda v: F.lit(other) - v, lambda v, x: x - v, None)

    def __mul__(self, other):
        return self._binop(other, lambda v: v * other, lambda v, x: v * x, self.spgemm)

    def __rmul__(self, other):
        return self._binop(other, lambda v: v * other, lambda v, x: v * x, None)

    def __truediv__(self, other):
        if isinstance(other, (int, float)) and other == 0:
            raise ZeroDivisionError("matrix / 0")
        return self._binop(other, lambda v: v / other, lambda v, x: F.try_divide(v, x), None)

    def __matmul__(self, other):
        return self.spgemm(other) if isinstance(other, SparseMatrix) else self.dot(other)

    # products

    def dot(self, vector: DataFrame, full: bool = False) -> DataFrame:
        """id, y of the product with vector (id, x); rows without entries left out, or 0 if ``full``."""
        self._check(vector)
        met = self.entries.join(vector.select(F.col("id").alias("col"), "x"), "col")
        out = met.groupBy(F.col("row").alias("id")).agg(F.sum(F.col("val") * F.col("x")).alias("y"))
        if not full:
            return out
        zero = F.lit(0).cast(out.schema["y"].dataType)
        return self.spark.range(self.shape[0]).join(out, "id", "left").select("id", F.coalesce("y", zero).alias("y"))

    def product_size(self, other: SparseMatrix) -> int:
        """How many products the matrix product expands to, from the counts of inner indices alone."""
        a = self.entries.groupBy("col").agg(F.count("*").alias("a"))
        b = other.entries.groupBy(F.col("row").alias("col")).agg(F.count("*").alias("b"))
        return a.join(b, "col").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0))).first()[0]

    def spgemm(self, other: SparseMatrix, mult: Callable[[Column, Column], Column] | None = None, add: str = "sum", check: bool = False) -> SparseMatrix:
        """The matrix product; ``mult`` and ``add`` (a named reduction) may stand in for times and plus.  ``check`` counts the products first."""
        if self.shape[1] != other.shape[0]:
            raise ValueError(f"shapes {self.shape} and {other.shape} do not fit")
        if check and (n := self.product_size(other)) > MANY_PRODUCTS:
            warnings.warn(f"the product expands to {n} terms", stacklevel=2)
        a = self.entries.select("row", F.col("col").alias("k"), F.col("val").alias("a"))
        b = other.entries.select(F.col("row").alias("k"), "col", F.col("val").alias("b"))
        term = mult(F.col("a"), F.col("b")) if mult else F.col("a") * F.col("b")
        met = _products(a, b, self.shape[1]).select("row", "col", term.alias("t"))
        return SparseMatrix(met.groupBy("row", "col").agg(reducer(add)("t").alias("val")), (self.shape[0], other.shape[1]), self.layout)

    def jaccard(self) -> SparseMatrix:
        """Similarity of each pair of rows that share a column; the matrix must hold ones only, and no empty row."""
        kept = Scratch(self.spark, "jaccard").keep(self.entries.select("row", "col", "val"))
        other, filled = kept.agg(F.count_if(F.col("val") != 1), F.countDistinct("row")).first()
        if other:
            raise ValueError("a matrix of ones is needed")
        if filled != self.shape[0]:
            raise ValueError("there are empty rows")
        sizes = kept.groupBy("row").agg(F.count("*").alias("n"))
        sizes = F.broadcast(sizes) if self.shape[0] <= FEW_ROWS else sizes
        # pairs are counted once, then mirrored
        ones = kept.select("row", F.col("col").alias("k"), F.lit(True).alias("a"))
        met = _products(ones, ones.select("k", F.col("row").alias("col"), F.col("a").alias("b")), self.shape[1]).where("row <= col").groupBy("row", "col").agg(F.count("*").alias("val"))
        there, back = F.struct("row", "col"), F.struct(F.col("col").alias("row"), F.col("row").alias("col"))
        both = met.select(F.explode(F.when(F.col("row") < F.col("col"), F.array(there, back)).otherwise(F.array(there))).alias("e"), "val").select("e.*", "val")
        a, b = sizes.select("row", F.col("n").alias("na")), sizes.select(F.col("row").alias("col"), F.col("n").alias("nb"))
        value = F.col("val") / (F.col("na") + F.col("nb") - F.col("val"))
        return SparseMatrix(both.join(a, "row").join(b, "col").select("row", "col", value.alias("val")), (self.shape[0], self.shape[0]), self.layout)

    def equals(self, other: SparseMatrix) -> bool:
        """Same layout, shape, pattern and values."""
        if self.layout != other.layout or self.shape != other.shape:
            return False
        a, b = self.entries.withColumn("a", F.lit(1)), other.entries.select("row", "col", F.col("val").alias("other"), F.lit(1).alias("b"))
        off = a.join(b, ["row", "col"], "full").where(~F.col("a").eqNullSafe(F.col("b")) | ~F.col("val").eqNullSafe(F.col("other")))
        return off.isEmpty()

    def __eq__(self, other) -> bool:
        return isinstance(other, SparseMatrix) and self.equals(other)

    __hash__ = None

    def __repr__(self) -> str:
        return f"SparseMatrix({self.shape[0]} x {self.shape[1]}, {self.layout})"

    def array_blocks(self) -> DataFrame:
        """start, row, col, val: the arrays (row, col, val) in the layout's order, cut into runs; each run is made where its entries lie, and start is its place."""
        ship(self.spark)
        kind = self.entries.schema["val"].dataType.simpleString()
        ranked = with_rank(self.entries.select("row", "col", "val"), *self._order(), name="rank")
        return ranked.select("row", "col", "val", "rank").mapInArrow(_runs, f"start long, row array<long>, col array<long>, val array<{kind}>")

    def to_arrays(self):
        """numpy arrays (row, col, val) in the layout's order, for a matrix that fits the driver; blocks come one after the other."""
        blocks = [tuple(pd.Series(x).to_numpy() for x in r) for r in self.array_blocks().orderBy("start").select("row", "col", "val").toLocalIterator()]
        if not blocks:
            rows = self.listed().toPandas()
            return tuple(rows[c].to_numpy() for c in ("row", "col", "val"))
        return tuple(np.concatenate(x) for x in zip(*blocks, strict=True))


def to_scipy(matrix: SparseMatrix, layout: str | None = None):
    """The matrix as scipy's, in the layout of that name ('coo', 'csr' or 'csc', by default its own); needs scipy, and a matrix that fits the driver."""
    layout = layout or matrix.layout
    if layout not in ("coo", "csr", "csc"):
        raise ValueError(f"unknown layout {layout!r}")
    import scipy.sparse

    row, col, val = matrix.to_arrays()
    return getattr(scipy.sparse, f"{layout}_matrix")((val, (row, col)), shape=matrix.shape)


def gen_ranges(ranges: DataFrame) -> DataFrame:
    """(key, start, end) -> (key, value): start to end - 1 of each row; empty ranges give no row."""
    return ranges.where("start < end").select("key", F.explode(F.sequence("start", F.col("end") - 1)).alias("value"))


def segment_starts(lengths: DataFrame) -> DataFrame:
    """(key, n) -> (key, start): where each segment begins when they follow each other by key."""
    return with_running_sum(lengths, "n", "key").select("key", (F.col("total") - F.col("n")).alias("start"))


def expand(values: DataFrame) -> DataFrame:
    """(key, value, n) -> a row for each of the n repetitions."""
    return values.where("n > 0").select("key", F.explode(F.array_repeat("value", F.col("n").cast("int"))).alias("value"))
