"""Season calendars and the daily-to-season interval join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..checks import assert_empty

CALENDAR_KEY = ["spatial_unit", "year", "season"]


def season_calendar(
    units: DataFrame,
    years: Sequence[int],
    spec: Mapping[str, tuple[str, str] | None] = K.SEASON_SPEC,
    unit: str = "spatial_unit",
) -> DataFrame:
    """One closed interval per unit, year and season. A season without month-days
    spans the whole year. Years and seasons are literal arrays that are exploded
    beside each unit, so no join is made."""
    seasons = F.array(
        *[
            F.struct(
                F.lit(name).alias("season"),
                F.lit(span[0] if span else "01-01").alias("lo"),
                F.lit(span[1] if span else "12-31").alias("hi"),
            )
            for name, span in spec.items()
        ]
    )
    base = units.select(F.col(unit).alias("spatial_unit")).distinct()
    grid = base.select("spatial_unit", F.explode(F.array(*[F.lit(int(y)) for y in years])).alias("year"))
    grid = grid.select("spatial_unit", "year", F.explode(seasons).alias("s"))
    day = lambda part: F.to_date(F.concat_ws("-", F.col("year").cast("string"), F.col(f"s.{part}")))
    return grid.select(
        "spatial_unit", "year", F.col("s.season").alias("season"), day("lo").alias("start_date"), day("hi").alias("end_date")
    )


def shifted_calendars(calendar: DataFrame, shifts: Sequence[int] = (-14, 0, 14)) -> DataFrame:
    """The calendar once per shift in days; adds ``shift_days``."""
    out = calendar.withColumn("shift_days", F.explode(F.array(*[F.lit(int(s)) for s in shifts])))
    return out.withColumns(
        {c: F.date_add(F.col(c), F.col("shift_days")) for c in ("start_date", "end_date")}
    )


def season_days(
    daily: DataFrame,
    calendar: DataFrame,
    unit: str = "spatial_unit",
    date: str = "date",
    month_key: bool = True,
) -> DataFrame:
    """Interval join: a daily row meets every window of its unit that contains its
    date, both ends included; windows may overlap.

    Each window is listed once per month it touches, so unit and month form an
    equi key. Work then spreads over months and a unit with a long history is
    not one shuffle group. The listed windows are shuffled, never broadcast: size
    estimates don't count the rows that ``explode`` makes, so a calendar of many
    units would pass as small and be collected on the driver.
    """
    cal = calendar.withColumnRenamed("spatial_unit", unit) if unit != "spatial_unit" else calendar
    cal = cal.withColumns({"_start": F.col("start_date"), "_end": F.col("end_date")}).drop("start_date", "end_date")
    left, keys = daily, [unit]
    if month_key:
        months = F.sequence(F.trunc("_start", "month"), F.trunc("_end", "month"), F.expr("interval 1 month"))
        cal = cal.withColumn("_month", F.explode(months))
        left = daily.withColumn("_month", F.trunc(date, "month"))
        keys = [unit, "_month"]
    clash = [c for c in cal.columns if c in left.columns and c not in keys]
    joined = left.drop(*clash).join(cal.hint("merge"), keys, "inner")
    return joined.filter(F.col(date).between(F.col("_start"), F.col("_end"))).drop("_start", "_end", "_month")


def empty_windows(calendar: DataFrame, features: DataFrame, key: Sequence[str] = CALENDAR_KEY) -> DataFrame:
    """Calendar rows without a feature row."""
    return calendar.join(features.select(*key).distinct(), list(key), "left_anti")


def assert_no_empty_windows(calendar: DataFrame, features: DataFrame, key: Sequence[str] = CALENDAR_KEY) -> None:
    assert_empty(empty_windows(calendar, features, key).select(*key), "no daily records for windows")
