"""Unions, de-duplication with conflict checks, selections of best rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..checks import assert_empty, assert_unique_key
from .ranks import first_per_key


def stack_tables(tables: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), tables)


def pooled(tables: Mapping[str, DataFrame], tag: str = "crop") -> DataFrame:
    """Tables stacked with a constant tag, which comes first."""
    tagged = [df.select(F.lit(name).alias(tag), *[c for c in df.columns if c != tag]) for name, df in tables.items()]
    return stack_tables(tagged, allow_missing=True)


def distinct_map(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Distinct rows of a member map; a name with two regions is an error."""
    return assert_unique_key(df.select(*columns).distinct(), [key], "member map")


def one_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """One row per key, first in an explicit order."""
    ordering = order or [F.col(c) for c in df.columns if c not in key]
    return first_per_key(df, key, ordering)


def distinct_values(df: DataFrame, key: Sequence[str], value: str, sheet: str = "sheet", tolerance: float = K.ANCHOR_TOLERANCE) -> DataFrame:
    """Per key: how many distinct values, their range, their mean and a status.

    Values are collapsed to (key, value) before the second aggregate, so no list
    of values is ever collected.
    """
    values = df.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(
        F.min(sheet).alias("_s1"), F.max(sheet).alias("_s2")
    )
    per_key = values.groupBy(*key).agg(
        F.count(F.lit(1)).alias("value_count"),
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
        F.avg(value).alias("mean_value"),
        F.min("_s1").alias("first_sheet"),
        F.max("_s2").alias("last_sheet"),
    )
    spread = (F.col("highest") - F.col("lowest")) / F.greatest(F.abs("highest"), F.lit(1e-9))
    status = F.when(F.col("value_count") == 1, "single").when(spread <= tolerance, "averaged").otherwise("conflict")
    return per_key.withColumns({"relative_spread": spread, "status": status})


def resolve_duplicates(df: DataFrame, key: Sequence[str], value: str, sheet: str = "sheet", strict: bool = True) -> DataFrame:
    """Close duplicates become the mean of their distinct values; a material
    conflict raises (or, when not strict, is left out)."""
    table = distinct_values(df, key, value, sheet)
    if strict:
        bad = table.filter("status = 'conflict'").select(*key, "lowest", "highest", "first_sheet", "last_sheet")
        assert_empty(bad, f"conflicting values of {value}")
    return table.filter("status <> 'conflict'").select(*key, F.col("mean_value").alias(value))


def key_difference(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    return left.select(*key).distinct().join(right.select(*key).distinct(), list(key), "left_anti")


def sort_by_magnitude(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(F.abs(F.col(column)).desc())


def best_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row that minimises the order columns, per group."""
    return first_per_key(df, groups, order)


def primary_results(results: DataFrame) -> DataFrame:
    """Rows registered as primary, overall scope, raw scale; best first."""
    scale = F.coalesce(F.col("target_scale"), F.lit("raw"))
    return results.filter(
        F.col("registered_primary_metric") & (F.col("result_scope") == "overall") & (scale == "raw")
    ).orderBy("rmse", "mae")
