"""End-to-end plan: daily tables and survey targets to the finished panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.agg import temperature_features, unit_day_mean
from ..operators.calendar import season_days
from ..operators.clean import pin_order
from ..operators.joins import attach_elevation, attach_static, merge_climate
from ..operators.series import rainfall_features


def seasonal_climate(rain: DataFrame, temperature: DataFrame, members: DataFrame, calendar: DataFrame) -> DataFrame:
    """Region-day means, interval join with the calendar, seasonal features of both."""
    rain_days = season_days(unit_day_mean(rain, members, ["rain_mm"]), calendar)
    temp_days = season_days(unit_day_mean(temperature, members, ["tmax_c", "tmin_c"]), calendar)
    wet = rainfall_features(rain_days).withColumn("rainfall_source", F.lit("daily_rainfall"))
    warm = temperature_features(temp_days, K.ENVIRONMENT_KEY).withColumn("temperature_source", F.lit("daily_temperature"))
    return merge_climate(wet, warm)


def final_panel(
    targets: DataFrame, climate: DataFrame, soil: DataFrame, elevation: DataFrame | None = None,
    data_version: str = "1", processing_version: str = "1",
) -> DataFrame:
    """Targets with climate, soil and optional elevation in the pinned order."""
    clash = [c for c in climate.columns if c in targets.columns and c not in K.ENVIRONMENT_KEY]
    panel = targets.join(climate.drop(*clash), K.ENVIRONMENT_KEY, "left")
    panel = attach_elevation(attach_static(panel, soil), elevation)
    return pin_order(panel, data_version, processing_version)
