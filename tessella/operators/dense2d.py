"""Dense 2-D arrays as tables (i, vals) of rows."""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.reducers import uniform

ARITHMETIC: dict[str, Callable] = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv}
COMPARISONS: dict[str, Callable] = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
SQL = {"int64": "bigint", "float64": "double", "bool": "boolean"}


def _apply(op: str, a: Column, b: Column, kinds: tuple[str, str]) -> Column:
    """Whole numbers stay whole but for /; bool with bool stays bool; comparisons give bool."""
    if op in COMPARISONS:
        to = "double" if "float64" in kinds else "bigint"
        return COMPARISONS[op](a.cast(to), b.cast(to))
    if op not in ARITHMETIC:
        raise ValueError(f"unknown operation {op!r}")
    if kinds == ("bool", "bool"):
        return {"+": a | b, "*": a & b, "-": a != b}[op] if op != "/" else F.try_divide(a.cast("double"), b.cast("double"))
    if op == "/":
        return F.try_divide(a.cast("double"), b.cast("double"))
    to = "double" if "float64" in kinds else "bigint"
    return ARITHMETIC[op](a.cast(to), b.cast(to))


@dataclass
class Array2D:
    rows: DataFrame
    shape: tuple[int, int]
    dtype: str = "int64"

    def __getitem__(self, key: int) -> DataFrame:
        """A row as (j, val); negative numbers count from the end."""
        if not isinstance(key, int) or isinstance(key, bool):
            raise TypeError(f"a row is picked by a whole number, not {type(key).__name__}")
        if not -self.shape[0] <= key < self.shape[0]:
            raise IndexError(f"row {key} of {self.shape[0]}")
        return self.rows.where(F.col("i") == key % self.shape[0]).select(F.posexplode("vals").alias("j", "val"))

    def binop(self, other: Array2D | int | float | bool, op: str) -> Array2D:
        if isinstance(other, Array2D):
            if self.shape != other.shape:
                raise ValueError(f"shapes {self.shape} and {other.shape} differ")
            kinds = (self.dtype, other.dtype)
            met = self.rows.join(other.rows.select("i", F.col("vals").alias("other")), "i")
            vals = F.zip_with("vals", "other", lambda a, b: _apply(op, a, b, kinds))
        else:
            kinds = (self.dtype, "bool" if isinstance(other, bool) else "float64" if isinstance(other, float) else "int64")
            met, vals = self.rows, F.transform("vals", lambda a: _apply(op, a, F.lit(other), kinds))
        out = met.select("i", vals.alias("vals"))
        kind = {v: k for k, v in SQL.items()}[dict(out.dtypes)["vals"].removeprefix("array<").removesuffix(">")]
        return Array2D(out, self.shape, kind)

    def __add__(self, other):
        return self.binop(other, "+")

    def __sub__(self, other):
        return self.binop(other, "-")

    def __mul__(self, other):
        return self.binop(other, "*")

    def __truediv__(self, other):
        return self.binop(other, "/")

    def flat(self) -> DataFrame:
        """idx, val in row order."""
        return self.rows.select("i", F.posexplode("vals").alias("j", "val")).select((F.col("i") * self.shape[1] + F.col("j")).alias("idx"), "val")

    def repartition(self, n: int, kind: str = "block") -> Array2D:
        """Rows dealt in ranges ('block') or in turn ('cyclic')."""
        rows = self.rows.repartitionByRange(n, "i") if kind == "block" else self.rows.repartition(n, F.col("i") % n)
        return Array2D(rows, self.shape, self.dtype)

    def text(self, most: int = 100) -> str:
        """The first rows in brackets."""
        shown = [r["vals"] for r in self.rows.orderBy("i").limit(most).collect()]
        return "[" + "\n ".join("[" + " ".join(map(str, r)) + "]" for r in shown) + "]"


def full(spark: SparkSession, value: int | float | bool, m: int, n: int) -> Array2D:
    kind = "bool" if isinstance(value, bool) else "float64" if isinstance(value, float) else "int64"
    return Array2D(spark.range(m).select(F.col("id").alias("i"), F.array_repeat(F.lit(value).cast(SQL[kind]), n).alias("vals")), (m, n), kind)


def random(spark: SparkSession, low: float, high: float, m: int, n: int, dtype: str = "int64", seed: int = 0, draw: Callable[..., Column] = uniform) -> Array2D:
    """Whole numbers from low to high - 1, numbers between low and high, or coin tosses."""
    if high < low:
        raise ValueError(f"{high} is below {low}")
    u = lambda j: draw("id", j, seed=seed)
    cell = {"int64": lambda j: (F.floor(u(j) * (high - low)) + low).cast("bigint"), "float64": lambda j: u(j) * (high - low) + low, "bool": lambda j: u(j) < 0.5}[dtype]
    return Array2D(spark.range(m).select(F.col("id").alias("i"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), cell).alias("vals")), (m, n), dtype)


def reshape(flat: DataFrame, shape: tuple[int, int], dtype: str = "int64", size: int | None = None) -> Array2D:
    """idx, val in row order -> an array; one -1 in the shape follows from the size."""
    size = flat.count() if size is None else size
    m, n = shape
    if m == -1 and n == -1 or m == 0 or n == 0:
        raise ValueError(f"shape {shape} says too little")
    m, n = (size // n if m == -1 else m), (size // m if n == -1 else n)
    if m * n != size:
        raise ValueError(f"{size} values do not fill {(m, n)}")
    cells = flat.select(F.floor(F.col("idx") / n).cast("long").alias("i"), F.struct((F.col("idx") % n).alias("j"), F.col("val")).alias("c"))
    rows = cells.groupBy("i").agg(F.array_sort(F.collect_list("c")).alias("c")).select("i", F.transform("c", lambda x: x["val"]).alias("vals"))
    return Array2D(rows, (m, n), dtype)
