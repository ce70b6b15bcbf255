"""Dimension joins, validated joins, as-of and fallback lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..checks import assert_empty, assert_unique_key
from .clean import prefix_columns
from .ranks import null_safe_join


def validated_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", validate: str = "many_to_one"
) -> DataFrame:
    """Equi-join that first checks the promised unique sides."""
    if validate.startswith("one_"):
        assert_unique_key(left, keys, "left side")
    if validate.endswith("_one"):
        assert_unique_key(right, keys, "right side")
    return left.join(right, list(keys), how)


def reference_dimension(members: DataFrame, centroids: DataFrame, key: str = "district") -> DataFrame:
    """Member map with its centroid; every member needs one."""
    table = validated_join(members, centroids, [key], "left", "one_to_one")
    assert_empty(table.filter(F.col("lat").isNull() | F.col("lon").isNull()).select(key), "no centroid for")
    return table


def merge_climate(rain: DataFrame, temperature: DataFrame, keys: Sequence[str] = tuple(K.ENVIRONMENT_KEY)) -> DataFrame:
    """Full outer join of the two seasonal tables without the clashing columns."""
    clash = [c for c in temperature.columns if c in rain.columns and c not in keys]
    return rain.join(temperature.drop(*clash), list(keys), "full")


def attach_static(panel: DataFrame, static: DataFrame, key: str = "spatial_unit") -> DataFrame:
    """Static columns of a key that the dimension promises to hold once; a repeated key raises."""
    return validated_join(panel, static, [key], "left", "many_to_one")


def attach_elevation(panel: DataFrame, elevation: DataFrame | None, source: str = "elevation", key: str = "spatial_unit") -> DataFrame:
    """Optional elevation; an absent table leaves NULLs and says so."""
    if elevation is None:
        return panel.withColumns(
            {
                "elevation_m": F.lit(None).cast("double"),
                "elevation_m_sd": F.lit(None).cast("double"),
                "elevation_source": F.lit("not_available"),
            }
        )
    return attach_static(panel, elevation, key).withColumn("elevation_source", F.lit(source))


def assign_to_members(
    panel: DataFrame, members: DataFrame, member_static: DataFrame, member: str = "district", region: str = "sub_region"
) -> DataFrame:
    """Copy region rows to each member district (grade B); static columns of the
    region give way to the member's own."""
    static = [c for c in member_static.columns if c != member]
    copied = panel.drop(*static).join(members.select(member, region), region, "inner")
    out = copied.join(member_static, member, "left")
    return out.withColumns({"data_quality_score": F.lit("B"), "is_geographically_assigned": F.lit(True)})


def seasons_side_by_side(yearly: DataFrame, seasonal: DataFrame, keys: Sequence[str], prefix: str = "") -> DataFrame:
    """Yearly rows with first- and second-season columns of one table beside them."""
    out = yearly
    for season in ("first", "second"):
        part = seasonal.filter(F.col("season") == season).drop("season")
        out = out.join(prefix_columns(part, f"{prefix}{season}_", keys), list(keys), "left")
    return out


def wide_by_crop(df: DataFrame, crops: Sequence[str], keys: Sequence[str], value: str = "yield_tons_ha") -> DataFrame:
    """One column per crop; only keys present for every crop (inner semantics)."""
    wide = df.filter(F.col("crop").isin(*crops)).groupBy(*keys).pivot("crop", list(crops)).agg(F.max(value))
    return wide.dropna(subset=list(crops))


def latest_before(
    test: DataFrame, train: DataFrame, keys: Sequence[str], target: str = "yield_tons_ha", year: str = "year",
    out: str = "previous_value",
) -> DataFrame:
    """As-of join: for each test row the training row of the same keys with the
    greatest strictly earlier year; the last of equal years by value.

    Both sides are first reduced to one row per key and year, then merged in
    year order and filled forward. A group is thus at most a few rows per year,
    however many rows a key has.
    """
    waves = train.groupBy(*keys, year).agg(F.max(target).alias("_wave"))
    asked = test.select(*keys, year).distinct().withColumn("_ask", F.lit(1))
    both = waves.join(asked, [*keys, year], "full")
    w = Window.partitionBy(*keys).orderBy(year).rowsBetween(Window.unboundedPreceding, -1)
    filled = both.withColumns(
        {out: F.last("_wave", ignorenulls=True).over(w), f"{out}_{year}": F.last(F.when(F.col("_wave").isNotNull(), F.col(year)), ignorenulls=True).over(w)}
    )
    found = filled.filter("_ask = 1").select(*keys, year, out, f"{out}_{year}")
    return test.join(found, [*keys, year], "left")


def lookup_chain(
    rows: DataFrame, levels: Sequence[tuple[str, Sequence[str], DataFrame]], default: Column, out: str = "prediction"
) -> DataFrame:
    """Value of the most specific level that has one, with the name of the level.

    ``levels`` are (name, keys, table with column ``value``), most specific first;
    a hit on the first is labelled ``none`` (no fallback).
    """
    joined, values, label = rows, [], None
    for i, (name, keys, table) in enumerate(levels):
        side = table.select(*keys, F.col("value").alias(f"_v{i}"))
        joined = null_safe_join(joined, side, list(keys), "left") if keys else joined.join(F.broadcast(side), F.lit(True), "left")
        values.append(F.col(f"_v{i}"))
        tag = F.lit("none" if i == 0 else name)
        label = F.when(values[-1].isNotNull(), tag) if label is None else label.when(values[-1].isNotNull(), tag)
    out_df = joined.withColumns(
        {out: F.coalesce(*values, default), "fallback_level": label.otherwise("training_global_mean")}
    )
    return out_df.withColumn("applicable", F.col("fallback_level") == "none").drop(*[f"_v{i}" for i in range(len(levels))])


def fallback_means(
    test: DataFrame, train: DataFrame, keys: Sequence[str], target: str = "yield_tons_ha", crop: str = "crop", out: str = "prediction"
) -> DataFrame:
    """Training mean of the specific key, else of the crop, else overall."""
    mean = lambda ks: train.groupBy(*ks).agg(F.avg(target).alias("value"))
    levels = [("specific", list(keys), mean(keys)), ("training_crop_mean", [crop], mean([crop]))]
    overall = train.agg(F.avg(target).alias("_global"))
    with_global = test.join(F.broadcast(overall), F.lit(True), "left")
    return lookup_chain(with_global, levels, F.col("_global"), out).drop("_global")


def previous_period(
    test: DataFrame, train: DataFrame, unit: str, test_year: int, train_year: int, target: str, order: str, out: str = "prediction"
) -> DataFrame:
    """Value of a fixed earlier year, first row of the unit; else the training mean."""
    base = train.filter(F.col("year") == train_year)
    first = base.groupBy(unit).agg(F.min_by(target, order).alias("_prev"))
    overall = base.agg(F.avg(target).alias("_mean"))
    rows = test.filter(F.col("year") == test_year).join(first, unit, "left").join(F.broadcast(overall), F.lit(True), "left")
    return rows.withColumn(out, F.coalesce("_prev", "_mean")).drop("_prev", "_mean")


def match_file_families(left: DataFrame, right: DataFrame, pattern: str, left_path: str = "path", right_path: str = "path") -> DataFrame:
    """Inner match of two file listings on the part of the name in ``pattern``."""
    a = left.withColumn("suffix", F.regexp_extract(left_path, pattern, 1)).withColumnRenamed(left_path, "left_path")
    b = right.withColumn("suffix", F.regexp_extract(right_path, pattern, 1)).withColumnRenamed(right_path, "right_path")
    return a.filter("suffix <> ''").join(b, "suffix", "inner")


def coalesce_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which shared columns fill each other's gaps."""
    shared = [c for c in right.columns if c in left.columns and c not in keys]
    side = right.select(*[F.col(c).alias(f"_s_{c}") if c in shared else F.col(c) for c in right.columns])
    joined = left.join(side, list(keys), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_s_{c}")) for c in shared}).drop(*[f"_s_{c}" for c in shared])


def outside_reference(df: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Key values of ``df`` that the reference table lacks."""
    return df.select(key).distinct().join(reference.select(key).distinct(), key, "left_anti")


def aligned_days(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Days on which every listed reading is present on both sides."""
    return left.join(right, list(keys), "inner").dropna(subset=list(values))


def two_key_join(features: DataFrame, target: DataFrame, keys: Sequence[str] = ("district", "year")) -> DataFrame:
    return features.join(target, list(keys), "inner")


def first_usable(
    tables: Sequence[DataFrame], key: Sequence[str], target: str, substitutes: Sequence[str] = ()
) -> DataFrame:
    """First table that has the key and the target or a column to stand in for it."""
    for df in tables:
        if not set(key) <= set(df.columns):
            continue
        if target in df.columns:
            return df
        for name in substitutes:
            if name in df.columns:
                return df.withColumnRenamed(name, target)
    raise ValueError(f"no table has {list(key)} and {target}")


def coalesce_sources(base: DataFrame, sources: Sequence[DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """Per row, the first source that has a value."""
    out = base
    for i, src in enumerate(sources):
        out = out.join(src.select(*keys, F.col(value).alias(f"_v{i}")), list(keys), "left")
    cols = [F.col(f"_v{i}") for i in range(len(sources))]
    return out.withColumn(value, F.coalesce(*cols)).drop(*[f"_v{i}" for i in range(len(sources))])
