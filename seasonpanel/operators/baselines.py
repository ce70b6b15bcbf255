"""Training-only baselines per fold.

``folds`` gives each row its test fold; the training set of a fold is all other
rows. Fold means are "total minus own" sums, so rows are never copied per fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import null_safe_join

BASELINES = ["training_global_mean", "training_crop_mean", "training_crop_season_mean"]
TEMPORAL_BASELINES = [*BASELINES, "historical_subregion_crop_mean", "previous_available_wave"]


def complement_means(rows: DataFrame, keys: Sequence[str], target: str, out: str, fold: str = "fold") -> DataFrame:
    """(fold, keys, out): mean target of the rows of the key that lie in other folds."""
    own = rows.groupBy(fold, *keys).agg(F.sum(target).alias("_s"), F.count(target).alias("_c"))
    total = own.groupBy(*keys).agg(F.sum("_s").alias("_ts"), F.sum("_c").alias("_tc"))
    mean = (F.col("_ts") - F.col("_s")) / F.nullif(F.col("_tc") - F.col("_c"), F.lit(0))
    return null_safe_join(own, total, list(keys), "inner").select(fold, *keys, mean.alias(out))


def earlier_means(rows: DataFrame, keys: Sequence[str], target: str, out: str, year: str = "year") -> DataFrame:
    """(keys, year, out): mean target of strictly earlier years of the key. Rows are
    reduced to one per key and year first, so windows hold a few rows each."""
    years = rows.groupBy(*keys, year).agg(F.sum(target).alias("_s"), F.count(target).alias("_c"))
    w = Window.partitionBy(*keys).orderBy(year).rowsBetween(Window.unboundedPreceding, -1)
    mean = F.sum("_s").over(w) / F.nullif(F.sum("_c").over(w), F.lit(0))
    return years.select(*keys, year, mean.alias(out))


def _with_fallback(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Fallback chain specific -> crop mean -> global mean, with level and flag."""
    crop, overall = F.col("training_crop_mean"), F.col("training_global_mean")
    out: dict[str, Column] = {}
    for name in names:
        value = F.col(name)
        level = F.when(value.isNotNull(), "none").when(crop.isNotNull(), "training_crop_mean").otherwise("training_global_mean")
        out[f"{name}_level"] = level
        out[f"{name}_value"] = F.coalesce(value, crop, overall)
    return df.withColumns(out).drop(*names).withColumnsRenamed({f"{n}_value": n for n in names})


def spatial_baselines(rows: DataFrame, target: str = "yield_tons_ha", fold: str = "fold") -> DataFrame:
    """Test rows of every fold with global, crop and crop-season training means. A
    unit's own history cannot be used: all its rows lie in the tested fold."""
    out = rows
    for name, keys in (("training_crop_season_mean", ["crop", "season"]), ("training_crop_mean", ["crop"]), ("training_global_mean", [])):
        table = complement_means(rows, keys, target, name, fold)
        out = null_safe_join(out, table, [fold, *keys], "left")
    return _with_fallback(out, BASELINES)


def temporal_baselines(
    rows: DataFrame, first_test_year: int, target: str = "yield_tons_ha", unit: str = "spatial_unit", year: str = "year"
) -> DataFrame:
    """Test rows of rolling-origin folds with all five baselines."""
    specs = [
        ("historical_subregion_crop_mean", [unit, "crop"]), ("training_crop_season_mean", ["crop", "season"]),
        ("training_crop_mean", ["crop"]), ("training_global_mean", []),
    ]
    out = rows.filter(F.col(year) >= first_test_year)
    for name, keys in specs:
        out = null_safe_join(out, earlier_means(rows, keys, target, name, year), [*keys, year], "left")
    from .joins import latest_before

    wave = latest_before(out, rows, [unit, "crop", "season"], target, year, "previous_available_wave")
    return _with_fallback(wave.drop(f"previous_available_wave_{year}"), TEMPORAL_BASELINES)


def baseline_predictions(wide: DataFrame, names: Sequence[str], target: str = "yield_tons_ha", keys: Sequence[str] = ("spatial_unit", "year", "season", "crop")) -> DataFrame:
    """Long prediction rows, one per baseline."""
    cells = F.array(
        *[F.struct(F.lit(n).alias("model"), F.col(n).alias("predicted_yield"), F.col(f"{n}_level").alias("fallback_level")) for n in names]
    )
    extra = ["fold"] if "fold" in wide.columns else []
    long = wide.select(*keys, *extra, F.col(target).alias("observed_yield"), F.explode(cells).alias("p"))
    return long.select(*keys, *extra, "observed_yield", "p.*").withColumn("fallback_used", F.col("fallback_level") != "none")


def fallback_rates(long: DataFrame, groups: Sequence[str] = ("model", "fold")) -> DataFrame:
    return long.groupBy(*groups).agg(F.avg(F.col("fallback_used").cast("double")).alias("fallback_rate"), F.count(F.lit(1)).alias("rows"))


def older_baselines(rows: DataFrame, target: str = "yield_tons_ha", unit: str = "spatial_unit", fold: str = "fold") -> DataFrame:
    """Fold mean and the unit's historical mean in other folds, which falls back to
    the fold mean."""
    out = null_safe_join(rows, complement_means(rows, [unit], target, "historical_mean", fold), [fold, unit], "left")
    out = null_safe_join(out, complement_means(rows, [], target, "mean_predictor", fold), [fold], "left")
    return out.withColumn("historical_mean", F.coalesce("historical_mean", "mean_predictor"))
