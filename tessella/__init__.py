"""Tessella: graph, sparse-matrix and array analytics on Spark DataFrames."""

__version__ = "0.1.0"
