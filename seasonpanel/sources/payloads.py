"""JSON payloads to long rows. Each function takes a table of parsed payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import MISSING_READING

SOIL_PAYLOAD = (
    "struct<properties: struct<layers: array<struct<name: string, unit_measure: struct<d_factor: int>, "
    "depths: array<struct<label: string, values: struct<mean: double>>>>>>>"
)
DAILY_MAP_PAYLOAD = "map<string, map<string, double>>"
RECORD_PAYLOAD = "array<struct<isodate: string, raw_value: string>>"
BOUNDARY_PAYLOAD = "struct<features: array<struct<properties: struct<shapeName: string>, geometry: struct<type: string, coordinates: string>>>>"


def parsed(files: DataFrame, schema: str, needs: str, text: str = "value") -> DataFrame:
    """Adds ``payload``, parsed with a declared schema. A text in which the field ``needs`` (a
    path inside the payload, or empty for the whole) is missing is of another shape and raises."""
    out = files.withColumn("payload", F.from_json(text, schema))
    where = F.col("payload" + ("." + needs if needs else ""))
    return out.withColumn("payload", F.when(where.isNull(), F.raise_error(F.concat(F.lit(f"payload without {needs or 'content'}: "), F.substring(text, 1, 200)))).otherwise(F.col("payload")))


def read_payloads(spark: SparkSession, path: str, schema: str, needs: str = "", pattern: str = r"([^/]+)__([^_/]+)__([^/]+)\.json$") -> DataFrame:
    """Payload files named unit__property__depth.json, see :func:`parsed`."""
    raw = spark.read.text(path, wholetext=True).withColumn("_path", F.input_file_name())
    names = [F.regexp_extract("_path", pattern, i).alias(n) for i, n in ((1, "district"), (2, "property"), (3, "depth"))]
    return parsed(raw.select(*names, "value"), schema, needs).drop("value")


def boundary_features(payloads: DataFrame) -> DataFrame:
    """(name, parts): one row per feature of boundary files; parts are the polygons, each an outer
    ring followed by its holes, as arrays of (lon, lat)."""
    rows = payloads.select(F.explode("payload.features").alias("f")).select(F.col("f.properties.shapeName").alias("name"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("text"))
    single = F.array(F.from_json("text", "array<array<array<double>>>"))
    several = F.from_json("text", "array<array<array<array<double>>>>")
    unknown = F.raise_error(F.concat(F.lit("geometry that is no polygon: "), F.coalesce("kind", F.lit("null"))))
    coordinates = F.when(F.col("kind") == "Polygon", single).when(F.col("kind") == "MultiPolygon", several).otherwise(unknown)
    point = lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))
    parts = F.transform(coordinates, lambda part: F.transform(part, lambda ring: F.transform(ring, point)))
    return rows.select("name", "kind", parts.alias("parts"))


def centroid_rings(features: DataFrame) -> DataFrame:
    """(name, rings) for the centroid: all rings of a single polygon, the outer rings of several."""
    outer = F.transform("parts", lambda part: part[0])
    return features.select("name", F.when(F.col("kind") == "Polygon", F.element_at("parts", 1)).otherwise(outer).alias("rings"))


def soil_points(payloads: DataFrame) -> DataFrame:
    """(district, property, depth, value, d_factor): one row per depth whose label is
    the depth of the file and that has a value. Only the first layer counts."""
    layer = F.try_element_at(F.col("payload.properties.layers"), F.lit(1))
    rows = payloads.select(
        "district", "property", "depth", layer["unit_measure"]["d_factor"].alias("d_factor"), F.explode(layer["depths"]).alias("d")
    )
    return rows.filter((F.col("d.label") == F.col("depth")) & F.col("d.values.mean").isNotNull()).select(
        "district", "property", "depth", F.col("d.values.mean").alias("value"), "d_factor"
    )


def daily_from_maps(payloads: DataFrame, high: str = "T2M_MAX", low: str = "T2M_MIN", missing: float = MISSING_READING) -> DataFrame:
    """(district, date, tmax_c, tmin_c) from {"high": {"yyyymmdd": x}, "low": {...}}."""
    real = lambda c: F.nullif(c, F.lit(missing))
    rows = payloads.select("district", F.col("payload")[low].alias("_low"), F.explode(F.col("payload")[high]).alias("k", "v"))
    return rows.select(
        "district",
        F.to_date("k", "yyyyMMdd").alias("date"),
        real(F.col("v")).alias("tmax_c"),
        real(F.col("_low")[F.col("k")]).alias("tmin_c"),
    )


def daily_from_records(payloads: DataFrame, out: str = "rain_mm") -> DataFrame:
    """(district, date, value) plus year, month, day and day of year from an array of records with
    an ISO date and a number as text. A record without either raises."""
    rows = payloads.select("district", F.explode("payload").alias("r"))
    date, value = F.to_date(F.substring("r.isodate", 1, 10)), F.col("r.raw_value").cast("double")
    bad = F.raise_error(F.concat(F.lit("record without isodate or raw_value: "), F.to_json("r")))
    rows = rows.select("district", F.when(date.isNull() | value.isNull(), bad).otherwise(date).alias("date"), value.alias(out))
    day = F.col("date")
    return rows.select("*", F.year(day).alias("year"), F.month(day).alias("month"), F.dayofmonth(day).alias("day"), F.dayofyear(day).alias("doy"))
