"""Fold-local feature preparation: everything is learned on training rows only.

``rows`` carry the fold columns and a ``role``; statistics read the training
roles, one small row per fold, and are applied to all rows as projections.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled
from .ranks import null_safe_join, order_statistics

#: Levels of a categorical predictor at most, unless a call allows more.
MAX_LEVELS = 1000
TRAIN_ROLES = ("train", "proper")


def training_rows(rows: DataFrame, roles: Sequence[str] = TRAIN_ROLES) -> DataFrame:
    return rows.filter(F.col("role").isin(*roles)) if "role" in rows.columns else rows


def unpivot_values(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.feature", "p.value")


def widen(table: DataFrame, columns: Sequence[str], keys: Sequence[str], value: str, prefix: str) -> DataFrame:
    return table.groupBy(*keys).agg(*[F.max(F.when(F.col("feature") == c, F.col(value))).alias(f"{prefix}{c}") for c in columns])


def exact_medians(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("fold",)) -> DataFrame:
    """(keys, feature, median) over training rows."""
    long = unpivot_values(training_rows(rows), columns, keys)
    return order_statistics(long, "value", [*keys, "feature"]).quantiles({"median": 0.5}).drop("n")


def attach(rows: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Statistics have one row per fold, which bounds the broadcast. They are computed
    once here, so later steps do not repeat the work behind them."""
    stats = settled(stats)
    if not keys:
        return rows.join(F.broadcast(stats), F.lit(True), "left")
    return null_safe_join(rows, F.broadcast(stats), list(keys), "left")


def impute_median(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("fold",)) -> DataFrame:
    wide = widen(exact_medians(rows, columns, keys), columns, keys, "median", "_med_")
    filled = attach(rows, wide, keys).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}")) for c in columns})
    return filled.drop(*[f"_med_{c}" for c in columns])


def training_modes(rows: DataFrame, column: str, keys: Sequence[str] = ("fold",)) -> DataFrame:
    """(keys, mode): most frequent training value, the smallest on ties. Counted per
    value first, so the aggregate state is one row."""
    counts = training_rows(rows).filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias("mode"))


def impute_mode(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("fold",)) -> DataFrame:
    for c in columns:
        modes = training_modes(rows, c, keys).withColumnRenamed("mode", "_mode")
        rows = attach(rows, modes, keys).withColumn(c, F.coalesce(c, "_mode")).drop("_mode")
    return rows


def impute_mean(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("fold",)) -> DataFrame:
    means = training_rows(rows).groupBy(*keys).agg(*[F.avg(c).alias(f"_avg_{c}") for c in columns])
    filled = attach(rows, means, keys).withColumns({c: F.coalesce(F.col(c), F.col(f"_avg_{c}")) for c in columns})
    return filled.drop(*[f"_avg_{c}" for c in columns])


def column_variances(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("fold",)) -> DataFrame:
    """(keys, feature, variance) with population variance over training rows."""
    long = unpivot_values(training_rows(rows), columns, keys)
    return long.groupBy(*keys, "feature").agg(F.var_pop("value").alias("variance"))


def varying_columns(rows: DataFrame, columns: Sequence[str], threshold: float = 1e-8) -> list[str]:
    """Columns whose variance exceeds the threshold; one aggregate, one driver row."""
    row = training_rows(rows).agg(*[F.var_pop(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is not None and row[c] > threshold]


def standardise(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("fold",)) -> DataFrame:
    """(x - mean) / population std of the training rows; a constant scales by 1."""
    stats = training_rows(rows).groupBy(*keys).agg(
        *[F.avg(c).alias(f"_avg_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_std_{c}") for c in columns]
    )
    scale = lambda c: F.when(F.col(f"_std_{c}") > 1e-12, F.col(f"_std_{c}")).otherwise(1.0)
    scaled = attach(rows, stats, keys).withColumns({c: (F.col(c) - F.col(f"_avg_{c}")) / scale(c) for c in columns})
    return scaled.drop(*[f"_{s}_{c}" for c in columns for s in ("avg", "std")])


def training_levels(rows: DataFrame, column: str, keys: Sequence[str] = ("fold",), max_levels: int = MAX_LEVELS) -> DataFrame:
    """(keys, levels): sorted training levels of each fold. ``max_levels`` bounds the
    distinct levels of the column, however many folds share them."""
    distinct = training_rows(rows).filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.lit(1).alias("_one"))
    if len(distinct.select(column).distinct().limit(max_levels + 1).collect()) > max_levels:
        raise ValueError(f"{column} has more than {max_levels} levels; it is not a categorical predictor")
    return distinct.groupBy(*keys).agg(F.array_sort(F.collect_list(column)).alias("levels"))


def one_hot(rows: DataFrame, column: str, keys: Sequence[str] = ("fold",), drop_first: bool = True, max_levels: int = MAX_LEVELS) -> tuple[DataFrame, list[str]]:
    """Indicator columns named column=level. A level unknown to the training rows of
    a fold, and the first known one when ``drop_first``, gives all zeros. Only the
    names of the levels, ``max_levels`` at most, come to the driver."""
    table = settled(training_levels(rows, column, keys, max_levels))
    names = sorted(r[0] for r in table.select(F.explode("levels")).distinct().collect())
    names = names[1:] if drop_first and not keys else names
    joined = attach(rows, table.withColumnRenamed("levels", "_levels"), keys)
    out = {}
    for level in names:
        hit = (F.col(column) == level) & F.array_contains("_levels", F.lit(level))
        if drop_first:
            hit = hit & (F.element_at("_levels", 1) != level)
        out[f"{column}={level}"] = F.when(F.coalesce(hit, F.lit(False)), 1.0).otherwise(0.0)
    return joined.withColumns(out).drop("_levels"), list(out)


def training_offsets(rows: DataFrame, target: str = "yield_tons_ha", by: str = "crop", keys: Sequence[str] = ("fold",)) -> DataFrame:
    """Adds ``offset``: mean training target of the row's crop, else of all training rows."""
    train = training_rows(rows)
    means = train.groupBy(*keys, by).agg(F.avg(target).alias("_crop_mean"))
    overall = train.groupBy(*keys).agg(F.avg(target).alias("_all_mean"))
    out = attach(null_safe_join(rows, settled(means), [*keys, by], "left"), overall, keys)
    return out.withColumn("offset", F.coalesce("_crop_mean", "_all_mean")).drop("_crop_mean", "_all_mean")


def component_scores(columns: Sequence[str], loadings: Sequence[Sequence[float]], prefix: str = "PC") -> dict[str, Column]:
    """PCk = sum of weight times standardised column, as plain projections."""
    return {
        f"{prefix}{k}": sum((F.lit(float(w)) * F.col(c) for c, w in zip(columns, vector)), F.lit(0.0))
        for k, vector in enumerate(loadings, 1)
    }


def feature_space(
    rows: DataFrame, space: str, climate: Sequence[str], static: Sequence[str], categorical: Sequence[str] = (), share: float = 0.90,
) -> tuple[DataFrame, list[str]]:
    """Design columns of one training set (roles mark the training rows).

    raw: climate and static, scaled. pca: components of climate. hybrid: components
    of climate plus scaled static. Categoricals stay outside the components.
    """
    from .linear import components_for_share, eigen, gram, unpack

    climate = [c for c in climate if c in rows.columns]
    static = [c for c in static if c in rows.columns]
    if not climate:
        raise ValueError("no climate predictor is present")
    numeric = [*climate, *static]
    out = standardise(impute_median(rows, numeric, ()), numeric, ())
    design = {"raw": numeric, "pca": [], "hybrid": list(static)}[space]
    if space != "raw":
        m = gram(training_rows(out).withColumn("_zero", F.lit(0.0)), climate, "_zero").first()["m"]
        values, vectors = eigen(unpack(m)[3])
        k = components_for_share(values, share) if share < 1 else int(share)
        scores = component_scores(climate, vectors[:, :k].T)
        out, design = out.withColumns(scores), [*scores, *design]
    present = [c for c in categorical if c in rows.columns]
    out = impute_mode(out, present, ())
    for c in present:
        out, names = one_hot(out, c, ())
        design = [*design, *names]
    keep = [c for c in rows.columns if c not in numeric and c not in present]
    return out.select(*keep, *present, *[f"`{c}`" for c in design]), design
