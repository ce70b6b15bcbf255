"""Nested, leakage-safe evaluation of linear models over spatial, temporal and stress folds.

Flow: units get a test fold; in every fold the other units split into proper
training and calibration; proper units get an inner fold. Rows are copied once
per outer fold (at most five copies, made inside the scan stage), imputed and
encoded with statistics of the proper rows of that fold, and reduced to one Gram
matrix per (fold, inner fold). All models, feature spaces and parameters are
then chosen and fitted from those matrices; predictions are a projection.

Inner folds reuse the medians and levels of the whole proper set; calibration
and test rows never touch any statistic.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import prep
from ..operators.folds import calibration_split, inner_spatial, spatial_folds, year_table
from ..operators.linear import components_for_share, eigen, gram, linear_prediction, scales, solve, squared_error, unpack
from ..operators.metrics import add_intervals, conformal_radius
from ..operators.ranks import hash_rank, null_safe_join
from ..session import settled

SPECS = [
    ("dummy_mean", [0.0]), ("ols", [0.0]), ("ridge", [0.01, 0.1, 1.0, 10.0, 100.0]), ("pls", [2.0, 4.0]),
]
SHARES = [0.80, 0.90, 0.95]
KEY = ["spatial_unit", "year", "season", "crop"]


MODES = ("spatial", "loso", "temporal", "stress")


def fold_rows(
    data: DataFrame, folds: int = 5, inner: int = 4, seed: int = 42, unit: str = "spatial_unit", mode: str = "spatial", minimum_years: int = 3,
    year: str = "year",
) -> DataFrame:
    """Rows once per outer fold that uses them, with ``fold``, ``role`` and ``inner``.

    spatial: units dealt into ``folds`` folds. loso: every unit is a fold. temporal: a year after
    the first ``minimum_years`` is tested, earlier years train. stress: a unit in such a year is
    tested, earlier years of the other units train. Of the training units of a fold a fifth
    calibrates. ``inner`` is a fold of proper units, or the year in temporal and stress mode.

    The copies of a row are as many as the folds that use it, which in loso and stress mode grow
    with the units.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode in ("spatial", "loso"):
        # the roles of a unit travel as one small array, and the copies are made after the join
        outer = settled(spatial_folds(data, folds if mode == "spatial" else 2**31 - 1, unit, seed))
        roles = settled(calibration_split(outer, unit, 0.2, seed))
        inners = settled(inner_spatial(roles, inner, unit, seed))
        per_unit = roles.join(inners, ["fold", unit], "left").groupBy(unit).agg(
            F.collect_list(F.struct("fold", "role", "inner")).alias("_roles")
        )
        joined = data.join(per_unit, unit, "inner").withColumn("_r", F.explode("_roles"))
        return joined.select(*data.columns, "_r.fold", "_r.role", "_r.inner")

    years = year_table(data, year).filter(F.col("position") > minimum_years).select("test_year")
    if mode == "temporal":
        tested = years.select("test_year", F.lit(None).cast(data.schema[unit].dataType).alias("test_unit"))
    else:
        cells = data.filter(F.col(unit).isNotNull()).select(F.col(year).alias("test_year"), F.col(unit).alias("test_unit")).distinct()
        tested = cells.join(years, "test_year", "left_semi")
    numbered = settled(tested.select(F.row_number().over(Window.partitionBy().orderBy("test_year", "test_unit")).cast("int").alias("fold"), "*"))
    # one row per year, or per year and unit
    table = numbered.agg(F.collect_list(F.struct("fold", "test_year", "test_unit")).alias("_folds"))
    apart = lambda f: f["test_unit"].isNull() | (f["test_unit"] != F.col(unit))
    own = lambda f: (f["test_year"] == F.col(year)) & (f["test_unit"].isNull() | (f["test_unit"] == F.col(unit)))
    uses = F.filter("_folds", lambda f: own(f) | ((F.col(year) < f["test_year"]) & apart(f)))
    copies = data.filter(F.col(unit).isNotNull()).join(F.broadcast(table), F.lit(True), "inner").withColumn("_f", F.explode(uses)).drop("_folds")
    copies = copies.withColumns({"fold": F.col("_f.fold"), "_test": own(F.col("_f"))}).drop("_f")
    train = copies.filter("not _test").select("fold", unit).distinct()
    ranked = hash_rank(train, [unit], ["fold"], F.col("fold") + seed, "_rank", total="_n")
    share = ranked.select("fold", unit, (F.col("_rank") > F.col("_n") - F.ceil(F.col("_n") * 0.2)).alias("_calibrates"))
    trained = share.select("fold").distinct()
    out = copies.join(trained, "fold", "left_semi").join(share, ["fold", unit], "left")
    role = F.when(F.col("_test"), "test").when(F.col("_calibrates"), "calibration").otherwise("proper")
    out = out.withColumn("role", role)
    return out.select(*data.columns, "fold", "role", F.when(F.col("role") == "proper", F.col(year)).cast("int").alias("inner"))


def design(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Imputed numeric columns and training-level indicators, per outer fold."""
    out = prep.impute_median(rows, numeric)
    out = prep.impute_mode(out, categorical)
    names: list[str] = []
    for c in categorical:
        coded = out.withColumn(f"_{c}", F.col(c))
        out, levels = prep.one_hot(coded, f"_{c}")
        out, names = out.drop(f"_{c}"), [*names, *levels]
    return out, [*numeric, *names]


def space_map(xx: np.ndarray, space: str, n_climate: int, n_numeric: int, share: float) -> np.ndarray:
    """Columns of the feature space as combinations of the scaled design columns."""
    p = len(xx)
    eye = np.eye(p)
    if space == "raw":
        return eye
    values, vectors = eigen(xx[:n_climate, :n_climate])
    k = components_for_share(values, share)
    block = np.zeros((p, k))
    block[:n_climate] = vectors[:, :k]
    rest = eye[:, n_numeric:] if space == "pca" else eye[:, n_climate:]
    return np.hstack([block, rest])


def fit_space(m: Sequence[float], space: str, n_climate: int, n_numeric: int, kind: str, param: float, share: float) -> np.ndarray:
    """(intercept, coefficients) on the design columns, numeric ones scaled inside."""
    n, mean, y_mean, xx, xy, _ = unpack(m)
    s = np.concatenate([scales(xx, n)[:n_numeric], np.ones(len(mean) - n_numeric)])
    zz, zy = xx / np.outer(s, s), xy / s
    t = space_map(zz, space, n_climate, n_numeric, share)
    b = (t @ solve(kind, t.T @ zz @ t, t.T @ zy, n, param)) / s
    return np.concatenate([[y_mean - mean @ b], b])


def nested_fits(
    inner_grams: DataFrame, n_climate: int, n_numeric: int, spaces: Sequence[str], specs: Sequence[tuple[str, Sequence[float]]], temporal: bool = False
) -> DataFrame:
    """Best fit per fold, model and space. A group is the few matrices of one fold. Each inner
    fold is tested on a fit of the others, or with ``temporal`` of the years before it, from the
    third year on; fewer than two such years raise."""
    schema = "fold int, model string, feature_space string, param double, variance_share double, inner_rmse double, coef array<double>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mats = [np.asarray(m, float) for m in pdf.sort_values("inner")["m"]]
        total = np.sum(mats, axis=0)
        splits = [(np.sum(mats[:i], axis=0), mats[i]) for i in range(2, len(mats))] if temporal else [(total - m, m) for m in mats]
        if temporal and len(splits) < 2:
            raise ValueError("too few years for inner temporal validation")
        rows = []
        for space in spaces:
            for kind, params in specs:
                trials = []
                for share in [1.0] if space == "raw" else SHARES:
                    for param in params:
                        errors = [
                            (squared_error(m, fit_space(rest, space, n_climate, n_numeric, kind, param, share)) / m[0]) ** 0.5
                            for rest, m in splits
                        ]
                        trials.append((float(np.mean(errors)), share, param))
                rmse, share, param = min(trials, key=lambda t: t[0])
                coef = fit_space(total, space, n_climate, n_numeric, kind, param, share)
                rows.append((int(pdf["fold"].iloc[0]), kind, space, float(param), float(share), rmse, coef.tolist()))
        return pd.DataFrame(rows, columns=["fold", "model", "feature_space", "param", "variance_share", "inner_rmse", "coef"])

    return inner_grams.select("fold", "inner", "m").groupBy("fold").applyInPandas(run, schema)


def nested_evaluation(
    data: DataFrame,
    climate: Sequence[str],
    static: Sequence[str] = (),
    categorical: Sequence[str] = ("season", "crop"),
    target: str = "yield_tons_ha",
    scale: str = "raw",
    spaces: Sequence[str] = ("raw", "pca", "hybrid"),
    specs: Sequence[tuple[str, Sequence[float]]] = tuple(SPECS),
    alpha: float = 0.10,
    folds: int = 5,
    seed: int = 42,
    mode: str = "spatial",
    minimum_years: int = 3,
) -> DataFrame:
    """Out-of-fold predictions with conformal intervals, one row per test row, model
    and feature space. ``mode``: see :func:`fold_rows`."""
    climate, static, categorical = list(climate), list(static), list(categorical)
    numeric = [*climate, *static]
    rows = fold_rows(data.dropna(subset=[target]), folds, seed=seed, mode=mode, minimum_years=minimum_years)
    if scale == "crop_centered":
        rows = prep.training_offsets(rows, target)
    else:
        rows = rows.withColumn("offset", F.lit(0.0))
    rows, columns = design(rows.withColumn("_y", F.col(target) - F.col("offset")), numeric, categorical)
    safe = {c: f"_x{i}" for i, c in enumerate(columns)}
    rows = rows.withColumns({v: F.col(f"`{k}`") for k, v in safe.items()})
    names = list(safe.values())

    grams = gram(rows.filter("role = 'proper'"), names, "_y", ["fold", "inner"])
    fits = settled(nested_fits(grams, len(climate), len(numeric), spaces, specs, mode in ("temporal", "stress")))

    used = rows.filter("role <> 'proper'").select(*KEY, "fold", "role", "offset", F.col(target).alias("observed_yield"), *names)
    # one coefficient row per fold, model and space bounds this broadcast
    scored = used.join(F.broadcast(fits), "fold", "inner").withColumn(
        "predicted_yield", linear_prediction(names) + F.col("offset")
    )
    scored = scored.withColumn("target_scale", F.lit(scale)).drop(*names, "coef")
    cells = ["fold", "model", "feature_space", "target_scale"]
    calibration = scored.filter("role = 'calibration'").withColumn(
        "absolute_residual", F.abs(F.col("observed_yield") - F.col("predicted_yield"))
    )
    radius = settled(conformal_radius(calibration, cells, alpha=alpha))
    groups = calibration.groupBy(*cells).agg(F.countDistinct("spatial_unit").alias("calibration_group_count"))
    test = add_intervals(scored.filter("role = 'test'").drop("role"), radius.join(settled(groups), cells), cells, alpha)

    train = rows.filter("role <> 'test'")
    overall = settled(train.groupBy("fold").agg(F.avg(target).alias("training_global_mean")))
    crop = settled(train.groupBy("fold", "crop").agg(F.avg(target).alias("training_crop_mean")))
    out = null_safe_join(test, F.broadcast(overall), ["fold"], "left")
    out = null_safe_join(out, crop, ["fold", "crop"], "left")
    return out.withColumns(
        {
            "training_crop_mean": F.coalesce("training_crop_mean", "training_global_mean"),
            "observed_evaluation_target": F.col("observed_yield") - F.col("offset"),
            "predicted_evaluation_target": F.col("predicted_yield") - F.col("offset"),
            "best_parameters": F.create_map(
                F.lit("param"), F.col("param").cast("string"), F.lit("variance_share"), F.col("variance_share").cast("string")
            ),
        }
    ).drop("offset", "param", "variance_share", "inner_rmse")


def tree_evaluation(
    data: DataFrame, features: Sequence[str], kind: str, params: dict, target: str = "yield_tons_ha", folds: int = 5, seed: int = 42,
    alpha: float = 0.10,
) -> DataFrame:
    """Out-of-fold predictions of a tree ensemble with conformal intervals; one fit
    per outer fold on its proper-training rows."""
    from functools import reduce

    from ..operators import trees

    rows = fold_rows(data.dropna(subset=[target]), folds, seed=seed)
    rows = prep.impute_median(rows, list(features))
    numbers = [r[0] for r in rows.select("fold").distinct().orderBy("fold").collect()]
    parts = []
    for f in numbers:
        own = rows.filter(F.col("fold") == f)
        model = trees.fit(own.filter("role = 'proper'"), features, target, kind, params, seed + f)
        parts.append(model(own.filter("role <> 'proper'")))
    scored = reduce(DataFrame.unionByName, parts).select(
        *KEY, "fold", "role", F.col(target).alias("observed_yield"), F.col("prediction").alias("predicted_yield"),
        F.lit(kind).alias("model"), F.lit("raw").alias("feature_space"), F.lit("raw").alias("target_scale"),
    )
    cells = ["fold", "model", "feature_space", "target_scale"]
    calibration = scored.filter("role = 'calibration'").withColumn(
        "absolute_residual", F.abs(F.col("observed_yield") - F.col("predicted_yield"))
    )
    radius = settled(conformal_radius(calibration, cells, alpha=alpha))
    return add_intervals(scored.filter("role = 'test'").drop("role"), radius, cells, alpha)
