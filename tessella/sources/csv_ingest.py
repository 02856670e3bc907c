"""Text files to column files: typed reading, schema checks, conversion of many files."""

from __future__ import annotations

import time
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.plans.rank import with_rank
from tessella.plans.store import Scratch
from tessella.sources.formats import FORMATS, CsvFormat, convert

KNOWN = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType)


def typed(raw: DataFrame, fmt: CsvFormat, sentinel: bool = True) -> DataFrame:
    """Columns of text as the format's types, then its transforms; type and sentinel stand in the column's metadata."""
    columns = []
    for name, kind in fmt.fields.items():
        value = F.try_to_timestamp(F.col(name), F.lit(fmt.timestamp)) if kind.sql == "timestamp" else convert(F.col(name), kind, sentinel)
        columns.append(value.alias(name, metadata={"dtype": kind.sql, "na": kind.na if sentinel else None}))
    out = raw.select(*columns, *[c for c in raw.columns if c not in fmt.fields])
    for t in fmt.transforms:
        before = set(out.columns)
        out = t(out)
        if not isinstance(out, DataFrame):
            raise TypeError(f"a transform of columns {sorted(before)} gave no table")
    unknown = [f.name for f in out.schema.fields if not isinstance(f.dataType, KNOWN)]
    if unknown:
        raise TypeError(f"columns without a storable type: {unknown}")
    return out


def read_csv(spark: SparkSession, paths: str | list[str], fmt: CsvFormat | str, sentinel: bool = True, columns: list[str] | None = None) -> DataFrame:
    """All files as one table; lines of another length become nulls beyond what they hold.  Compressed files are recognised by name."""
    fmt = FORMATS[fmt] if isinstance(fmt, str) else fmt
    schema = T.StructType([T.StructField(n, T.StringType()) for n in fmt.fields])
    raw = spark.read.schema(schema).options(sep=fmt.sep, header=fmt.header, mode="PERMISSIVE").csv(paths)
    out = typed(raw, fmt, sentinel)
    return out.select(*columns) if columns else out


def infer_format(spark: SparkSession, path: str, sep: str = ",") -> CsvFormat:
    """Names and types of a file with a header; columns of types that can't be stored are left out."""
    from tessella.sources.formats import FieldType

    found = spark.read.options(sep=sep, header=True, inferSchema=True).csv(path)
    return CsvFormat({f.name: FieldType(f.dataType.simpleString()) for f in found.schema.fields if isinstance(f.dataType, KNOWN)}, sep, True)


def convert_files(spark: SparkSession, paths: list[str], out_dir: str, fmt: CsvFormat | str, compression: str = "zstd", sentinel: bool = True) -> list[str]:
    """Each text file as a column file of its base name under ``out_dir``; one job writes all.  A file that is written again replaces the old one."""
    fmt = FORMATS[fmt] if isinstance(fmt, str) else fmt
    df = with_file_name(read_csv(spark, paths, fmt, sentinel))
    write_by_file(df, out_dir, compression)
    return sorted(r[0] for r in df.select("file").distinct().collect())


def with_file_name(df: DataFrame) -> DataFrame:
    """Adds file, the base name of the row's file without its endings."""
    base = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1)
    return df.withColumn("file", base)


def write_by_file(df: DataFrame, out_dir: str, compression: str = "zstd") -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", compression).partitionBy("file").parquet(out_dir)


def save(df: DataFrame, path: str, compression: str = "zstd", attempts: int = 10, interval: float = 30.0, raise_errors: bool = False) -> bool:
    """Writes a table as column files, again after ``interval`` seconds if that fails; whether it was written.

    A write is committed as a whole, so that a failed one leaves no part of it.
    raise_errors: the first failure is an error.
    """
    for k in range(attempts):
        try:
            df.write.mode("overwrite").option("compression", compression).parquet(path)
            return True
        except Exception as e:
            if raise_errors:
                raise
            warnings.warn(f"{path} was not written: {e}", stacklevel=2)
            if k + 1 < attempts:
                time.sleep(interval)
    return False


def insert_rows(frame: DataFrame, rows: DataFrame, index: int, scratch: Scratch | None = None) -> DataFrame:
    """frame (idx, ...) with its rows from place ``index`` on replaced by ``rows`` (idx, ...), in the order of their own idx.

    Columns that ``rows`` lacks keep their values; rows beyond the frame's end
    are an error.
    """
    placed = with_rank(rows, "idx", name="__at", scratch=scratch).withColumn("__at", F.col("__at") + index).drop("idx")
    last, end = placed.agg(F.max("__at")).first()[0], frame.agg(F.max("idx")).first()[0]
    if index < 0 or (last is not None and (end is None or last > end)):
        raise ValueError(f"rows {index} to {last} do not fit into a frame that ends at {end}")
    both = [c for c in rows.columns if c != "idx"]
    fresh = placed.select(F.col("__at"), F.struct(*[F.col(f"`{c}`").alias(c) for c in both]).alias("__new"))
    met = frame.join(fresh, F.col("idx") == F.col("__at"), "left")
    pick = lambda c: F.when(F.col("__at").isNull(), F.col(f"`{c}`")).otherwise(F.col("__new").getField(c)).alias(c) if c in both else F.col(f"`{c}`")
    return met.select(*[pick(c) for c in frame.columns])


def schemas(spark: SparkSession, paths: list[str]) -> dict[str, T.StructType]:
    """The schema of each file, from footers alone."""
    return {p: spark.read.parquet(p).schema for p in paths}


def read_columns(spark: SparkSession, paths: list[str], columns: list[str] | None = None) -> DataFrame:
    """Column files of one schema as one table; another number, name or type of columns is an error."""
    if not paths:
        raise ValueError("no files")
    found = schemas(spark, paths)
    plain = {p: [(f.name, f.dataType) for f in s.fields if columns is None or f.name in columns] for p, s in found.items()}
    first = plain[paths[0]]
    if columns and {n for n, _ in first} != set(columns):
        raise ValueError(f"{paths[0]} lacks {sorted(set(columns) - {n for n, _ in first})}")
    off = [p for p, s in plain.items() if sorted(s, key=str) != sorted(first, key=str)]
    if off:
        raise ValueError(f"other columns than in {paths[0]}: {off}")
    out = spark.read.schema(found[paths[0]]).parquet(*paths)
    return out.select(*columns) if columns else out


def column_metadata(spark: SparkSession, path: str) -> DataFrame:
    """name, dtype, na, rows of each column of a file."""
    df = spark.read.parquet(path)
    n = df.count()
    rows = [(f.name, f.metadata.get("dtype", f.dataType.simpleString()), None if f.metadata.get("na") is None else str(f.metadata["na"]), n) for f in df.schema.fields]
    return spark.createDataFrame(rows, "name string, dtype string, na string, rows long")


def concat_files(spark: SparkSession, paths: list[str], dest: str, single: bool = False) -> None:
    """Files of one schema as one table; a type that differs is an error.  ``single``: in one file, which one task writes row group by row group."""
    found = read_columns(spark, paths)
    (found.coalesce(1) if single else found).write.mode("errorifexists").parquet(dest)


def write_text(df: DataFrame, dest: str, columns: list[str] | None = None, header: bool = False) -> None:
    """Columns as lines of text: whole numbers as they are, others with 15 decimals.  With a header each file begins with it."""
    picked = [f for f in df.schema.fields if columns is None or f.name in columns]
    cells = [F.format_string("%.15e", F.col(f.name)) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name).cast("string") for f in picked]
    name = " ".join(f.name for f in picked)
    lines = df.select(F.concat_ws(" ", *cells).alias(name if header else "value"))
    if header:  # as CSV of one column, whose writer begins each file with the name
        lines.write.options(header=True, quote="", escape="").csv(dest)
    else:
        lines.write.text(dest)
