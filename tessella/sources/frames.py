"""Tables and arrays of the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def to_numpy(df: DataFrame, *columns: str) -> tuple[np.ndarray, ...]:
    """Columns as arrays, over Arrow; for tables that fit the driver."""
    rows = df.select(*columns).toPandas() if columns else df.toPandas()
    return tuple(rows[c].to_numpy() for c in rows.columns)


def from_numpy(spark: SparkSession, **arrays: np.ndarray) -> DataFrame:
    """Arrays of one length as columns, with their place as idx."""
    if len({len(a) for a in arrays.values()}) > 1:
        raise ValueError("arrays of different lengths")
    frame = pd.DataFrame(arrays)
    frame.insert(0, "idx", np.arange(len(frame)))
    return spark.createDataFrame(frame)


def write_edges(edges: DataFrame, path: str) -> None:
    edges.select("src", "dst").write.parquet(path)
