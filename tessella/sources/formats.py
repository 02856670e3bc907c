"""Named text formats: columns, types, and the value that stands for a missing one."""

from __future__ import annotations

import runpy
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FieldType:
    """SQL type, the value written for missing ones (None: null), and what is done with the text first."""

    sql: str
    na: object = None
    prepare: Callable[[Column], Column] | None = None


def convert(value: Column, kind: FieldType, sentinel: bool = True) -> Column:
    """The text as the type; what can't be cast is missing."""
    prepared = kind.prepare(value) if kind.prepare else value
    cast = prepared.try_cast(kind.sql)
    return F.coalesce(cast, F.lit(kind.na).cast(kind.sql)) if sentinel and kind.na is not None else cast


@dataclass(frozen=True)
class CsvFormat:
    """fields in file order; transforms: tables to tables, after the casts; they may add and replace columns."""

    fields: dict[str, FieldType]
    sep: str = ","
    header: bool = False
    timestamp: str = "yyyy-MM-dd HH:mm:ss"
    transforms: tuple[Callable[[DataFrame], DataFrame], ...] = field(default=())


FORMATS: dict[str, CsvFormat] = {}


def register_format(name: str, fmt: CsvFormat) -> None:
    FORMATS[name] = fmt


def load_formats(path: str) -> list[str]:
    """Runs a Python file of the user's that defines FORMATS, a dict of CsvFormat, and adds them."""
    found = runpy.run_path(path).get("FORMATS")
    if not isinstance(found, dict) or not all(isinstance(f, CsvFormat) for f in found.values()):
        raise ValueError(f"{path} defines no FORMATS")
    FORMATS.update(found)
    return sorted(found)


def _split(df: DataFrame) -> DataFrame:
    from tessella.sources.netaddr import split_ip

    return split_ip(df, ["srcIP", "dstIP"])


# An example of flow records; unsigned types take the next wider signed one.
register_format(
    "example",
    CsvFormat(
        {
            "small_vals": FieldType("tinyint", -1),
            "pos_ints": FieldType("bigint", -1),
            "flag": FieldType("int", 0x8000),
            "flag2": FieldType("smallint", 0b110),
            "nonzero": FieldType("bigint", 0),
            "starttime": FieldType("timestamp"),
            "endtime": FieldType("timestamp"),
            "srcIP": FieldType("string", ""),
            "dstIP": FieldType("string", ""),
        },
        sep="\t",
        transforms=(_split,),
    ),
)
