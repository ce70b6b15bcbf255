"""Table scans with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checks import assert_empty, nan_to_null, require_columns

DAILY_RAIN = "district STRING, date DATE, rain_mm DOUBLE"
DAILY_TEMPERATURE = "district STRING, date DATE, tmax_c DOUBLE, tmin_c DOUBLE"
MEMBER_MAP = "district STRING, sub_region STRING, lat DOUBLE, lon DOUBLE"
SEASON_CALENDAR = "spatial_unit STRING, year INT, season STRING, start_date DATE, end_date DATE"
GRID_CELLS = "time DATE, latitude DOUBLE, longitude DOUBLE, precip DOUBLE"
MICRODATA = "household_id STRING, district STRING, year INT, crop_code INT, production_kg DOUBLE, area_harvested_ha DOUBLE"


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str, required: Sequence[str] = ()) -> DataFrame:
    """CSV with a header and a declared schema. The header is compared with the
    schema by name, so a reordered or renamed file fails instead of shifting."""
    df = spark.read.csv(list(path) if not isinstance(path, str) else path, header=True, schema=schema, enforceSchema=False)
    return nan_to_null(require_columns(df, required, str(path)))


def read_table(spark: SparkSession, path: str | Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    return nan_to_null(require_columns(spark.read.parquet(*paths), required, str(path)))


def with_source_file(df: DataFrame, column: str = "source_file") -> DataFrame:
    return df.withColumn(column, F.input_file_name())


def assert_single_valued(df: DataFrame, column: str, source: str = "source_file") -> DataFrame:
    """Each source file holds one value of ``column``."""
    from ..operators.quality import single_valued

    assert_empty(single_valued(df, source, column), f"files with several values of {column}")
    return df
