"""Named functions and operators that users may add to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_COMMANDS: dict[str, Callable] = {}


def register(name: str, fn: Callable, spark: SparkSession | None = None, returns: str | None = None) -> Callable:
    """Adds ``fn`` under a name; with a session and a type also as a SQL function."""
    if name in _COMMANDS and _COMMANDS[name] is not fn:
        raise ValueError(f"{name} is taken")
    _COMMANDS[name] = fn
    if spark is not None:
        spark.udf.register(name, fn, returns) if returns else spark.udf.register(name, fn)
    return fn


def call(name: str, *args, **kwargs) -> DataFrame:
    if name not in _COMMANDS:
        raise KeyError(f"no command {name!r}")
    return _COMMANDS[name](*args, **kwargs)


def commands() -> list[str]:
    return sorted(_COMMANDS)
