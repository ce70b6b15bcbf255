"""Schema and key guards shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, required: Iterable[str], name: str = "table") -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{name} is missing columns: {missing}")
    return df


def nan_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN means missing in the source files; Spark aggregates skip only NULL."""
    names = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (columns is None or f.name in columns)
    ]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in names}) if names else df


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def assert_unique_key(df: DataFrame, key: Sequence[str], name: str = "table") -> DataFrame:
    offenders = duplicate_keys(df, key).limit(20).collect()
    if offenders:
        raise ValueError(f"{name} has duplicate keys {list(key)}: {[tuple(r)[:-1] for r in offenders]}")
    return df


def assert_empty(df: DataFrame, message: str) -> None:
    """Raise with at most 20 offending rows."""
    rows = df.limit(20).collect()
    if rows:
        raise ValueError(f"{message}: {[tuple(r) for r in rows]}")


def try_divide(num: Column, den: Column) -> Column:
    """Division that gives NULL for a zero or missing denominator."""
    return num / F.nullif(den, F.lit(0).cast("double"))


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a null or NaN in ``columns``, as ``dropna`` keeps them, by one condition per column.

    ``dropna`` makes one condition over all columns. Where columns are renamed above it, Catalyst lists that
    condition once per subset of the names, so that with 64 columns a checkpoint of the plan never ends.
    """
    kinds = dict(df.dtypes)
    known = (F.col(c).isNotNull() & ~F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNotNull() for c in columns)
    return df.where(reduce(and_, known, F.lit(True)))
