"""Error metrics, skill, coverage, intervals over long prediction tables.

A prediction table has panel keys, fold, model, feature_space, target_scale,
observed_yield and predicted_yield. Every metric is one groupBy over it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checks import try_divide
from .ranks import group_quantiles, null_safe_join, order_statistics, seeded_hash

CORE = ["model", "feature_space", "target_scale"]


def metric_columns(observed: str = "observed_yield", predicted: str = "predicted_yield") -> list[Column]:
    """rmse, mae, r2; r2 is NULL below two rows or for constant observations."""
    o, e = F.col(observed), F.col(observed) - F.col(predicted)
    r2 = 1 - try_divide(F.sum(e * e), F.var_pop(o) * F.count(o))
    return [
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.when((F.count(o) >= 2) & (F.min(o) < F.max(o)), r2).alias("r2"),
    ]


def error_metrics(df: DataFrame, groups: Sequence[str], observed: str = "observed_yield", predicted: str = "predicted_yield") -> DataFrame:
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("observations"), *metric_columns(observed, predicted))


def skill(observed: str, predicted: str, baseline: str) -> Column:
    """1 - MSE(model) / MSE(baseline), NULL for a perfect baseline."""
    e, b = F.col(observed) - F.col(predicted), F.col(observed) - F.col(baseline)
    return 1 - try_divide(F.sum(e * e), F.sum(b * b))


def out_of_fold_summary(predictions: DataFrame) -> DataFrame:
    """Pooled metrics per model, space and scale, with skill over the training means."""
    observed = "observed_evaluation_target" if "observed_evaluation_target" in predictions.columns else "observed_yield"
    predicted = "predicted_evaluation_target" if "predicted_evaluation_target" in predictions.columns else "predicted_yield"
    aggs = [F.count(F.lit(1)).alias("observations"), *metric_columns(observed, predicted)]
    for name in ("training_global_mean", "training_crop_mean"):
        if name in predictions.columns:
            aggs.append(skill("observed_yield", "predicted_yield", name).alias(f"skill_vs_{name}"))
    out = predictions.groupBy(*CORE).agg(*aggs)
    return out.withColumns({"result_scope": F.lit("overall"), "registered_primary_metric": F.col("target_scale") == "raw"})


def per_crop_metrics(predictions: DataFrame, groups: Sequence[str] = tuple(CORE)) -> DataFrame:
    out = predictions.groupBy(*groups, "crop").agg(F.count(F.lit(1)).alias("observations"), *metric_columns())
    return out.withColumn("result_scope", F.lit("per_crop"))


def macro_average(per_crop: DataFrame, groups: Sequence[str] = tuple(CORE)) -> DataFrame:
    """Mean over crops; ``observations`` is the number of crops."""
    out = per_crop.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("observations"), *[F.avg(c).alias(c) for c in ("rmse", "mae", "r2")]
    )
    return out.withColumn("result_scope", F.lit("macro_average"))


def fold_mean_scores(predictions: DataFrame, groups: Sequence[str] = tuple(CORE)) -> DataFrame:
    """Mean of per-fold scores: mean R2 and the root of the mean fold MSE."""
    folds = predictions.groupBy(*groups, "fold").agg(*metric_columns())
    return folds.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("folds"), F.avg("r2").alias("mean_r2"), F.sqrt(F.avg(F.col("rmse") * F.col("rmse"))).alias("root_mean_mse")
    )


def fold_results(predictions: DataFrame) -> DataFrame:
    """One row per fold, model, space and scale."""
    extra = [F.max(c).alias(c) for c in ("calibration_size", "calibration_group_count", "conformal_alpha") if c in predictions.columns]
    # the same for all rows of a fold and model; a map has no order, so any of them is taken
    extra += [F.any_value(c).alias(c) for c in ("best_parameters",) if c in predictions.columns]
    return predictions.groupBy("fold", *CORE).agg(F.count(F.lit(1)).alias("test_rows"), *metric_columns(), *extra)


def anomaly_r2(df: DataFrame, group: str, observed: str = "observed_yield", predicted: str = "predicted_yield", keys: Sequence[str] = ()) -> DataFrame:
    """R2 after both series are centred on the true group mean.

    Centring by one constant per group leaves the errors as they are; the total
    sum of squares is the pooled within-group one.
    """
    e = F.col(observed) - F.col(predicted)
    per_group = df.groupBy(*keys, group).agg(
        F.sum(e * e).alias("_sse"), (F.var_pop(observed) * F.count(observed)).alias("_within")
    )
    return per_group.groupBy(*keys).agg((1 - try_divide(F.sum("_sse"), F.sum("_within"))).alias("anomaly_r2"))


def interval_coverage(predictions: DataFrame) -> DataFrame:
    """Coverage overall, per crop and per season in one pass with grouping sets."""
    usable = predictions.dropna(subset=["conformal_lower", "conformal_upper"])
    covered = F.col("observed_yield").between(F.col("conformal_lower"), F.col("conformal_upper"))
    sets = [[*map(F.col, CORE)], [*map(F.col, CORE), F.col("crop")], [*map(F.col, CORE), F.col("season")]]
    out = usable.groupingSets(sets, *CORE, "crop", "season").agg(
        F.grouping_id(*CORE, "crop", "season").alias("_gid"),
        (1 - F.min("conformal_alpha")).alias("nominal_coverage"),
        F.avg(covered.cast("double")).alias("actual_coverage"),
        F.avg(F.col("conformal_upper") - F.col("conformal_lower")).alias("mean_interval_width"),
        F.count(F.lit(1)).alias("observations"),
        F.min("calibration_size").alias("calibration_size_min"),
        F.min("calibration_group_count").alias("calibration_group_count_min"),
        F.max("calibration_group_count").alias("calibration_group_count_max"),
    )
    level = F.when(F.col("_gid") == 3, "overall").when(F.col("_gid") == 1, "crop").otherwise("season")
    blank = {"aggregation_level": level, "crop": F.coalesce("crop", F.lit("")), "season": F.coalesce("season", F.lit(""))}
    return out.withColumns(blank).drop("_gid")


def conformal_rank(alpha: float = 0.05) -> Column:
    """1-based rank of the calibration residual that bounds the interval: level
    min(1, ceil((n + 1)(1 - alpha)) / n), then the next higher order statistic.
    Products are rounded to 9 digits before the ceiling."""
    n = F.col("n")
    level = F.least(F.lit(1.0), F.ceil(F.round((n + 1) * (1 - alpha), 9)) / n)
    return F.least(F.ceil(F.round(level * (n - 1), 9)) + 1, n)


def conformal_radius(calibration: DataFrame, groups: Sequence[str], residual: str = "absolute_residual", alpha: float = 0.05) -> DataFrame:
    """(groups, calibration_size, conformal_radius): exact order statistic per group."""
    out = order_statistics(calibration, residual, groups).at({"conformal_radius": conformal_rank(alpha)})
    return out.select(*groups, F.col("n").alias("calibration_size"), "conformal_radius")


def add_intervals(predictions: DataFrame, radius: DataFrame, groups: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Interval columns; the radius table has one row per fold and model."""
    joined = null_safe_join(predictions, F.broadcast(radius), list(groups), "left")
    return joined.withColumns(
        {
            "conformal_lower": F.col("predicted_yield") - F.col("conformal_radius"),
            "conformal_upper": F.col("predicted_yield") + F.col("conformal_radius"),
            "conformal_alpha": F.lit(alpha),
        }
    )


def in_sample_interval(predictions: DataFrame, groups: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Older interval: quantile of the errors it is then judged on, labelled as such."""
    rows = predictions.withColumn("_abs", F.abs(F.col("observed_yield") - F.col("predicted_yield")))
    radius = group_quantiles(rows, "_abs", {"radius": 1 - alpha}, groups)
    joined = null_safe_join(rows, F.broadcast(radius.drop("n")), list(groups), "inner")
    return joined.groupBy(*groups).agg(
        F.max("radius").alias("interval_radius"),
        F.avg((F.col("_abs") <= F.col("radius")).cast("double")).alias("interval_coverage"),
        F.lit("in_sample").alias("coverage_basis"),
    )


def residual_table(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    e = F.col("observed_yield") - F.col("predicted_yield")
    return predictions.select(*keys, "observed_yield", "predicted_yield", e.alias("residual"), F.abs(e).alias("absolute_error"))


def model_agreement(predictions: DataFrame) -> DataFrame:
    """MAE and row count per model; the older names y_true and y_pred also work."""
    obs = "observed_yield" if "observed_yield" in predictions.columns else "y_true"
    pred = "predicted_yield" if "predicted_yield" in predictions.columns else "y_pred"
    return predictions.groupBy("model").agg(F.avg(F.abs(F.col(obs) - F.col(pred))).alias("mae"), F.count(F.lit(1)).alias("n"))


def cluster_bootstrap(
    predictions: DataFrame, groups: Sequence[str] = tuple(CORE), unit: str = "spatial_unit", iterations: int = 200, seed: int = 42
) -> DataFrame:
    """95 % bootstrap intervals of rmse, mae and the two skills, units resampled.

    Rows are reduced to sums per unit first. A draw of as many units as there are,
    with replacement, gives each unit a weight; here the weights are independent
    Poisson(1) counts from a hash of (seed, draw, unit), which needs no slot table
    and no second copy of the units. Fewer than two units give NULLs.
    """
    e = F.col("observed_yield") - F.col("predicted_yield")
    base = {n: c for n, c in (("global_skill", "training_global_mean"), ("crop_skill", "training_crop_mean")) if c in predictions.columns}
    per_unit = predictions.filter(F.col(unit).isNotNull()).groupBy(*groups, unit).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(e * e).alias("se"),
        F.sum(F.abs(e)).alias("ae"),
        *[F.sum(F.pow(F.col("observed_yield") - F.col(c), 2)).alias(f"b_{name}") for name, c in base.items()],
    )
    draws = per_unit.withColumn("iter", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    w = poisson_weight(seeded_hash(seed, "iter", unit))
    total = lambda c: F.sum(F.col("_w") * F.col(c))
    sums = draws.withColumn("_w", w).groupBy(*groups, "iter").agg(
        F.count(F.lit(1)).alias("units"), total("n").alias("n"), total("se").alias("se"), total("ae").alias("ae"),
        *[total(f"b_{name}").alias(f"b_{name}") for name in base],
    )
    stats = {"rmse": F.sqrt(try_divide(F.col("se"), F.col("n"))), "mae": try_divide(F.col("ae"), F.col("n"))}
    stats |= {name: 1 - try_divide(F.col("se"), F.col(f"b_{name}")) for name in base}
    usable = sums.withColumns({f"s_{k}": F.when(F.col("units") >= 2, v) for k, v in stats.items()})
    # one value per draw and group: the percentile state holds ``iterations`` numbers
    bounds = [
        F.percentile(f"s_{k}", q).alias(f"{k}_ci_{side}") for k in stats for side, q in (("lower", 0.025), ("upper", 0.975))
    ]
    return usable.groupBy(*groups).agg(*bounds)


POISSON_ONE = list(accumulate(math.exp(-1.0) / math.factorial(k) for k in range(10)))


def poisson_weight(hashed: Column) -> Column:
    """Poisson(1) count from a uniform hash."""
    u = F.pmod(hashed, F.lit(1 << 52)) / float(1 << 52)
    out = F.when(u < POISSON_ONE[0], 0.0)
    for k, p in enumerate(POISSON_ONE[1:], 1):
        out = out.when(u < p, float(k))
    return out.otherwise(float(len(POISSON_ONE)))
