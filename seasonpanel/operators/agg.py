"""Grouped aggregates: daily, monthly, seasonal, soil and survey summaries.

All are partial + final hash aggregates, so a hot group is reduced to one row
per task before the shuffle. Per-group medians and quantiles go through
``ranks.OrderStatistics``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..checks import assert_unique_key
from ..checks import numeric_columns, try_divide
from ..functions.scalars import days_in_month, degree_days, kelvin_to_celsius, month_group
from .ranks import group_quantiles, null_safe_join
from .series import heatwave_count, older_season_rows


def unit_day_mean(
    daily: DataFrame, members: DataFrame, values: Sequence[str], member: str = "district", unit: str = "sub_region"
) -> DataFrame:
    """Unweighted mean over member districts per date; unmapped districts drop."""
    joined = daily.join(members.select(member, F.col(unit).alias("spatial_unit")), member, "inner")
    return joined.groupBy("spatial_unit", "date").agg(*[F.avg(v).alias(v) for v in values])


def group_means(df: DataFrame, groups: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Mean of every numeric column; rows with a missing group are dropped."""
    values = [c for c in numeric_columns(df, exclude) if c not in groups]
    rows = df.dropna(subset=list(groups))
    return rows.groupBy(*groups).agg(*[F.avg(c).alias(c) for c in values])


def temperature_features(
    days: DataFrame,
    keys: Sequence[str],
    base: float = K.GDD_BASE_C,
    heat: float = K.HEAT_C,
    extreme: float = K.EXTREME_HEAT_C,
    cold: float = K.COLD_C,
) -> DataFrame:
    """Temperature summary over days that have both readings."""
    rows = days.filter(F.col("tmax_c").isNotNull() & F.col("tmin_c").isNotNull())
    mean = (F.col("tmax_c") + F.col("tmin_c")) / 2
    return rows.groupBy(*keys).agg(
        F.avg(mean).alias("temperature_mean_c"),
        F.max("tmax_c").alias("temperature_maximum_c"),
        F.min("tmin_c").alias("temperature_minimum_c"),
        (F.avg("tmax_c") - F.avg("tmin_c")).alias("temperature_range_c"),
        F.sum(degree_days(mean, base)).alias("growing_degree_days"),
        F.count_if(F.col("tmax_c") >= heat).alias("heat_days_32c"),
        F.count_if(F.col("tmax_c") >= extreme).alias("extreme_heat_days_35c"),
        F.count_if(F.col("tmin_c") <= cold).alias("cold_days_10c"),
    )


def older_temperature_features(
    daily: DataFrame,
    rain: DataFrame | None = None,
    unit: str = "district",
    base: float = K.GDD_BASE_C,
    heat: float = K.OLDER_HEAT_C,
    extreme: float = K.EXTREME_HEAT_C,
    warm_night: float = K.WARM_NIGHT_C,
) -> DataFrame:
    """Older seasonal temperature row: degree days, hot days, warm nights, heatwaves
    and, when rain is given, the wet-day interactions."""
    keys = [unit, "year", "season"]
    rows = older_season_rows(daily, unit)
    mean = (F.col("tmax_c") + F.col("tmin_c")) / 2
    aggs = [
        F.coalesce(F.sum(degree_days(mean, base)), F.lit(0.0)).alias("season_gdd"),
        F.count_if(F.col("tmax_c") >= heat).alias("heat_days"),
        F.count_if(F.col("tmax_c") >= extreme).alias("extreme_heat_days"),
        F.count_if(F.col("tmin_c") >= warm_night).alias("warm_night_days"),
    ]
    if rain is not None:
        rows = rows.join(rain.select(unit, "date", "rain_mm"), [unit, "date"], "left")
        aggs += wet_day_interactions(base)
    out = rows.groupBy(*keys).agg(*aggs)
    waves = heatwave_count(rows, keys, threshold=heat)
    return out.join(waves, keys, "left").withColumn("heatwave_count", F.coalesce("heatwave_count", F.lit(0)))


def wet_day_interactions(base: float = K.GDD_BASE_C) -> list[Column]:
    """Mean maximum and degree days (of the maximum) over days with rain; days
    need both readings."""
    both = F.col("tmax_c").isNotNull() & F.col("rain_mm").isNotNull()
    wet_tmax = F.when(both & (F.col("rain_mm") >= K.WET_DAY_MM), F.col("tmax_c"))
    gdd = F.coalesce(F.sum(degree_days(wet_tmax, base)), F.lit(0.0))
    return [F.avg(wet_tmax).alias("wet_day_tmax_mean"), F.when(F.count_if(both) > 0, gdd).alias("wet_day_gdd")]


def household_summary(rows: DataFrame, groups: Sequence[str], low: float = 0.1, high: float = 10.0) -> DataFrame:
    """Plausible household yields to district level, plus the ratio of sums."""
    kept = plausible_yield(rows, low, high)
    out = kept.groupBy(*groups).agg(
        F.avg("yield_t_ha").alias("mean_yield"),
        F.countDistinct("household_id").alias("households"),
        F.sum("area_harvested_ha").alias("total_area_ha"),
        F.sum("production_kg").alias("total_production_kg"),
    )
    return out.withColumn("weighted_yield", try_divide(F.col("total_production_kg"), F.col("total_area_ha") * 1000))


def plausible_yield(rows: DataFrame, low: float = 0.1, high: float = 10.0) -> DataFrame:
    """t/ha from kg and ha; keeps the open range (low, high)."""
    y = try_divide(F.col("production_kg"), F.col("area_harvested_ha") * 1000)
    return rows.withColumn("yield_t_ha", y).filter((F.col("yield_t_ha") > low) & (F.col("yield_t_ha") < high))


def month_sums(daily: DataFrame, groups: Sequence[str], value: str = "rain_mm", out: str = "rainfall_mm") -> DataFrame:
    return daily.groupBy(*groups, F.trunc("date", "month").alias("month_start")).agg(F.sum(value).alias(out))


def monthly_rain_features(
    monthly: DataFrame,
    unit: str = "district",
    groups: Mapping[str, Sequence[int]] = K.MONTH_GROUPS,
    rainy: float = K.RAINY_MONTH_MM,
) -> DataFrame:
    """Yearly rainfall features from months; a missing month counts 0 in the sums."""
    v = F.col("rainfall_mm")
    seasons = [
        F.coalesce(F.sum(F.when(F.col("month").isin(*m), v)), F.lit(0.0)).alias(s) for s, m in groups.items()
    ]
    return monthly.groupBy(unit, "year").agg(
        *seasons,
        F.sum(v).alias("annual_rainfall"),
        F.when(F.avg(v) > 0, F.stddev_samp(v) / F.avg(v)).otherwise(0.0).alias("rain_cv"),
        F.max(v).alias("max_monthly"),
        F.min(v).alias("min_monthly"),
        F.count_if(v >= rainy).alias("rainy_months"),
    )


def season_pivot(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    seasons: Sequence[str] = tuple(K.MONTH_GROUPS),
    how: str = "sum",
    fill: float | None = 0.0,
) -> DataFrame:
    """One column per season; ``fill`` replaces seasons without rows."""
    func = {"sum": F.sum, "avg": F.avg, "max": F.max}[how]
    out = df.groupBy(*keys).pivot("season", list(seasons)).agg(func(value))
    return out if fill is None else out.fillna(fill, list(seasons))


def measures_by_season(
    df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column], seasons: Sequence[str] = tuple(K.MONTH_GROUPS)
) -> DataFrame:
    """Several measures per season as columns named SEASON_measure."""
    return df.groupBy(*keys).pivot("season", list(seasons)).agg(*[a.alias(n) for n, a in aggs.items()])


def pivoted_rain_features(monthly: DataFrame, unit: str = "district", rainy: float = K.RAINY_MONTH_MM) -> DataFrame:
    """Older yearly features: season pivot joined to annual ones; strictly more than
    ``rainy`` makes a rainy month."""
    keys = [unit, "year"]
    v = F.col("rainfall_mm")
    tagged = monthly.withColumn("season", month_group("month"))
    annual = monthly.groupBy(*keys).agg(
        F.sum(v).alias("annual_rainfall"),
        F.when(F.avg(v) > 0, F.stddev_samp(v) / F.avg(v)).otherwise(0.0).alias("rain_cv"),
        F.max(v).alias("max_monthly"),
        F.min(v).alias("min_monthly"),
        F.count_if(v > rainy).alias("rainy_months"),
    )
    return season_pivot(tagged, keys, "rainfall_mm").join(annual, keys, "inner")


def climatology(
    monthly: DataFrame,
    years: tuple[int, int] = K.BASELINE_YEARS,
    unit: str = "district",
    groups: Mapping[str, Sequence[int]] = K.MONTH_GROUPS,
) -> DataFrame:
    """Baseline mean and spread: monthly means add up, monthly variances add up."""
    base = monthly.filter(F.col("year").between(*years))
    by_month = base.groupBy(unit, "month").agg(
        F.avg("rainfall_mm").alias("_m"), F.var_samp("rainfall_mm").alias("_v")
    )
    aggs = [F.sum("_m").alias("clim_annual_mean"), F.sqrt(F.sum("_v")).alias("clim_annual_std")]
    for season, months in groups.items():
        inside = F.col("month").isin(*months)
        aggs += [
            F.sum(F.when(inside, F.col("_m"))).alias(f"clim_{season}_mean"),
            F.sqrt(F.sum(F.when(inside, F.col("_v")))).alias(f"clim_{season}_std"),
        ]
    return by_month.groupBy(unit).agg(*aggs)


def climate_anomalies(
    features: DataFrame, clim: DataFrame, unit: str = "district", seasons: Sequence[str] = tuple(K.MONTH_GROUPS)
) -> DataFrame:
    """Difference from the baseline and its z-score; a zero spread gives NULL. A unit with
    two baselines raises."""
    assert_unique_key(clim, [unit], "baseline")
    out = features.join(clim, unit, "left")
    pairs = [("annual_rainfall", "clim_annual", "rainfall"), *[(s, f"clim_{s}", s) for s in seasons]]
    for column, base, name in pairs:
        diff = F.col(column) - F.col(f"{base}_mean")
        out = out.withColumns({f"{name}_anomaly": diff, f"{name}_zscore": try_divide(diff, F.col(f"{base}_std"))})
    return out


# columns of the older seasonal rows and how first and second season combine
TOTAL_SUM = ["season_total_mm", "rain_days_1mm", "rain_days_10mm", "rain_days_20mm", "dry_spell_count_7d", "dry_spell_count_10d"]
TOTAL_MAX = ["longest_dry_spell_days", "maximum_5day_rainfall", "false_onset_flag"]
TOTAL_TEMP_SUM = ["season_gdd", "heat_days", "extreme_heat_days", "warm_night_days", "heatwave_count", "wet_day_gdd"]


def first_and_second_total(seasonal: DataFrame, unit: str = "district") -> DataFrame:
    """Combine first and second season into ``total``.

    Sums take a missing second season as 0. Extremes and dates follow "keep the
    first argument when the comparison with a missing value fails": a missing
    first gives NULL, a missing second keeps the first. The wet-day mean is
    weighted with the rain days of each season (true first-season weights).
    """
    keys = [unit, "year"]
    cols = [c for c in seasonal.columns if c not in (*keys, "season")]
    first = seasonal.filter("season = 'first'").select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols])
    second = seasonal.filter("season = 'second'").select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols])
    both = first.join(second, keys, "left")
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    keep_first = lambda func, c: F.when(a(c).isNotNull(), func(a(c), F.coalesce(b(c), a(c))))
    out: dict[str, Column] = {}
    for c in cols:
        if c in TOTAL_SUM or c in TOTAL_TEMP_SUM:
            out[c] = a(c) + F.coalesce(b(c), F.lit(0))
        elif c in TOTAL_MAX:
            out[c] = keep_first(F.greatest, c)
        elif c == "wet_day_tmax_mean":
            out[c] = (a(c) + b(c)) / 2
    if "season_onset_day" in cols:
        out["season_onset_day"] = keep_first(F.least, "season_onset_day")
        out["season_cessation_day"] = keep_first(F.greatest, "season_cessation_day")
        out["season_length_days"] = out["season_cessation_day"] - out["season_onset_day"] + 1
    if "mean_wet_day_rainfall" in cols:
        w1, w2 = a("rain_days_1mm").cast("double"), b("rain_days_1mm").cast("double")
        weighted = a("mean_wet_day_rainfall") * w1 + b("mean_wet_day_rainfall") * w2
        out["mean_wet_day_rainfall"] = try_divide(weighted, w1 + w2)
    return both.select(*keys, F.lit("total").alias("season"), *[v.alias(k) for k, v in out.items()])


def daily_temperature_by_month_group(
    daily: DataFrame, unit: str = "district", base: float = K.GDD_BASE_C, heat: float = K.EXTREME_HEAT_C, cold: float = 5.0
) -> DataFrame:
    """Seasonal and annual temperature columns from daily maxima and minima."""
    keys = [unit, "year"]
    mean = (F.col("tmax_c") + F.col("tmin_c")) / 2
    rows = daily.withColumns(
        {"year": F.year("date"), "season": month_group(F.month("date")), "_mean": mean, "_gdd": degree_days(mean, base)}
    )
    shared = {
        "tmax_mean": F.avg("tmax_c"),
        "tmin_mean": F.avg("tmin_c"),
        "tmean_mean": F.avg("_mean"),
        "gdd_total": F.coalesce(F.sum("_gdd"), F.lit(0.0)),
        "heat_stress_days": F.count_if(F.col("tmax_c") > heat),
        "cold_stress_days": F.count_if(F.col("tmin_c") < cold),
    }
    seasonal = measures_by_season(rows, keys, shared)
    annual = rows.groupBy(*keys).agg(
        F.avg("tmax_c").alias("annual_tmax_mean"),
        F.avg("tmin_c").alias("annual_tmin_mean"),
        F.avg("_mean").alias("annual_tmean_mean"),
        F.coalesce(F.sum("_gdd"), F.lit(0.0)).alias("annual_gdd"),
        F.count_if(F.col("tmax_c") > heat).alias("annual_heat_stress"),
        F.count_if(F.col("tmin_c") < cold).alias("annual_cold_stress"),
        F.count_if(F.col("_gdd") > 0).alias("growing_season_length"),
    )
    return seasonal.join(annual, keys, "inner")


def monthly_temperature_features(
    monthly: DataFrame, unit: str = "district", kelvin: str = "t_mean_k", base: float = K.GDD_BASE_C,
    heat: float = K.EXTREME_HEAT_C, cold: float = 5.0,
) -> DataFrame:
    """Monthly means in kelvin to degree days, stress months and growing months."""
    keys = [unit, "year"]
    c = kelvin_to_celsius(kelvin)
    rows = monthly.withColumns(
        {
            "year": F.year("month_start"),
            "season": month_group(F.month("month_start")),
            "_c": c,
            "_gdd": degree_days(c, base) * days_in_month("month_start"),
        }
    )
    seasonal = measures_by_season(
        rows,
        keys,
        {
            "tmean_mean": F.avg("_c"),
            "gdd_total": F.sum("_gdd"),
            "heat_stress_months": F.count_if(F.col("_c") > heat),
            "cold_stress_months": F.count_if(F.col("_c") < cold),
        },
    )
    annual = rows.groupBy(*keys).agg(
        F.avg("_c").alias("annual_tmean"),
        F.sum("_gdd").alias("annual_gdd"),
        F.count_if(F.col("_c") > heat).alias("annual_heat_stress"),
        F.count_if(F.col("_c") < cold).alias("annual_cold_stress"),
        F.count_if(F.col("_gdd") > 0).alias("growing_months"),
    )
    return seasonal.join(annual, keys, "inner")


SOIL_MOISTURE_LAYERS = ["surface_sm", "rzsm_1m", "rzsm_1", "rzsm_2", "rzsm_3"]


def soil_moisture_features(monthly: DataFrame, unit: str = "district") -> DataFrame:
    """Season means of five layers as columns, annual statistics and the index."""
    keys = [unit, "year"]
    tagged = monthly.withColumn("season", month_group("month"))
    seasonal = measures_by_season(tagged, keys, {c: F.avg(c) for c in SOIL_MOISTURE_LAYERS})
    cv = lambda c: F.when(F.avg(c) != 0, F.stddev_samp(c) / F.avg(c)).when(F.avg(c) == 0, 0.0)
    annual = monthly.groupBy(*keys).agg(
        *[F.avg(c).alias(f"annual_{c}") for c in SOIL_MOISTURE_LAYERS],
        *[cv(c).alias(f"{c}_cv") for c in ("surface_sm", "rzsm_1m")],
        *[F.min(c).alias(f"min_{c}") for c in ("surface_sm", "rzsm_1m")],
        *[F.max(c).alias(f"max_{c}") for c in ("surface_sm", "rzsm_1m")],
        *[F.avg(c).alias(f"annual_{c}") for c in ("surface_nobs", "rzsm_1m_nobs")],
    )
    return seasonal.join(annual, keys, "inner").withColumn("soil_moisture_index", F.col("annual_rzsm_1m"))


def depth_weighted_soil(
    points: DataFrame,
    unit: str = "district",
    weights: Mapping[str, float] = K.DEPTH_WEIGHTS,
    properties: Sequence[str] = tuple(K.SOIL_PROPERTIES),
) -> DataFrame:
    """Depth-weighted mean over the depths that have a value, then unit scaling;
    one column per property."""
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("depth")]
    rows = points.filter(F.col("value").isNotNull()).withColumn("_w", weight).filter(F.col("_w").isNotNull())
    means = rows.groupBy(unit, "property").agg(
        (F.sum(F.col("value") * F.col("_w")) / F.sum("_w")).alias("_mean"), F.max("d_factor").cast("double").alias("_d")
    )
    scaled = means.withColumn("v", try_divide(F.col("_mean"), F.col("_d")))
    return scaled.groupBy(unit).pivot("property", list(properties)).agg(F.max("v"))


def region_soil(
    soil: DataFrame, members: DataFrame, member: str = "district", unit: str = "sub_region",
    renames: Mapping[str, str] = K.SOIL_RENAMES,
) -> DataFrame:
    """Region mean, spread (0 for a single member) and member count."""
    joined = soil.join(members.select(member, F.col(unit).alias("spatial_unit")), member, "inner")
    aggs = []
    for source, name in renames.items():
        aggs += [F.avg(source).alias(name), F.coalesce(F.stddev_samp(source), F.lit(0.0)).alias(f"{name}_sd")]
    return joined.groupBy("spatial_unit").agg(*aggs, F.count(F.lit(1)).alias("soil_district_count"))


def region_elevation(
    elevation: DataFrame | None, members: DataFrame, member: str = "district", unit: str = "sub_region"
) -> DataFrame:
    """Region mean and spread of elevation; an absent source gives no rows."""
    if elevation is None:
        return members.sparkSession.createDataFrame(
            [], "spatial_unit string, elevation_m double, elevation_m_sd double"
        )
    joined = elevation.join(members.select(member, F.col(unit).alias("spatial_unit")), member, "inner")
    return joined.groupBy("spatial_unit").agg(
        F.avg("elevation_m").alias("elevation_m"), F.stddev_samp("elevation_m").alias("elevation_m_sd")
    )


def panel_summary(panel: DataFrame, groups: Sequence[str] = ("year", "season")) -> DataFrame:
    return panel.groupBy(*groups).agg(
        F.countDistinct("spatial_unit").alias("units"),
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("crop").alias("crops"),
        F.avg("yield_tons_ha").alias("mean_yield"),
    )


def national_reconstruction(rows: DataFrame, printed: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Sums over regions next to the printed national row."""
    sums = rows.groupBy("crop").agg(
        F.sum("area_harvested_ha").alias("area_sum"), F.sum("production_mt").alias("production_sum")
    )
    close = lambda x, y: F.abs(F.col(x) - F.col(y)) <= F.abs(F.col(y)) * tolerance
    return sums.join(printed, "crop", "left").withColumn(
        "reconstructed", close("area_sum", "area_printed") & close("production_sum", "production_printed")
    )


def plausibility(rows: DataFrame, value: str = "yield_tons_ha", groups: Sequence[str] = ("crop",)) -> DataFrame:
    return rows.groupBy(*groups).agg(
        F.min(value).alias("minimum"), F.max(value).alias("maximum"), F.count(F.lit(1)).alias("rows")
    )


def missingness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing count and share of every column from one pass."""
    cols = list(columns or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    rows = one.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in cols])).alias("r"))
    return rows.select(
        F.col("r.column").alias("column"),
        F.col("r.missing").alias("missing_count"),
        try_divide(F.col("r.missing").cast("double"), F.col("_n").cast("double")).alias("missing_fraction"),
    )


def feature_availability(df: DataFrame, columns: Sequence[str], planned: Sequence[str] = ()) -> DataFrame:
    """Coverage, status and source of each feature; planned ones are listed last."""
    from ..functions.scalars import source_of_column

    report = missingness(df, columns).select(
        F.col("column").alias("feature"),
        F.round(1 - F.col("missing_fraction"), 4).alias("coverage"),
        F.when(F.col("missing_fraction") < 1, "usable").otherwise("unavailable").alias("status"),
        source_of_column("column").alias("source"),
    )
    absent = [(n, 0.0, "planned", "generated / not yet integrated") for n in planned if n not in df.columns]
    if absent:
        ddl = "feature string, coverage double, status string, source string"
        report = report.unionByName(df.sparkSession.createDataFrame(absent, ddl))
    return report


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per value of each column, missing values included."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("count"))


def describe_by_group(df: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    base = df.groupBy(*groups).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    medians = group_quantiles(df, value, {"median": 0.5}, groups).drop("n")
    return null_safe_join(base, medians, list(groups), "left")


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of every pair of columns, long form, from one aggregate over
    rows where both are present."""
    pairs = [(i, a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.corr(a, b).alias(f"c{n}") for n, (_, a, b) in enumerate(pairs)])
    cells = F.array(
        *[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"c{n}").alias("r")) for n, (_, a, b) in enumerate(pairs)]
    )
    return one.select(F.explode(cells).alias("c")).select("c.left", "c.right", F.col("c.r").alias("correlation"))


def benchmark_rows(results: DataFrame, targets: DataFrame, unit: str = "district", target: str = "yield_tons_ha") -> DataFrame:
    """Best model per crop beside the spread of its target."""
    best = results.groupBy("crop").agg(F.max_by(F.struct("model", "r2", "rmse"), F.struct("r2", -F.col("rmse"))).alias("b"))
    stats = targets.groupBy("crop").agg(
        F.countDistinct(unit).alias("units"),
        F.avg(target).alias("mean_yield"),
        F.stddev_samp(target).alias("std_yield"),
        F.min(target).alias("min_yield"),
        F.max(target).alias("max_yield"),
    )
    return best.select("crop", F.col("b.model").alias("model"), F.col("b.r2").alias("r2"), F.col("b.rmse").alias("rmse")).join(
        stats, "crop", "inner"
    )
