"""The query registry: name, callable, oracle SQL and the survey rows it covers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        COVERS[name] = covers.split()
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
