"""Nested, leakage-safe evaluation of tree ensembles: every parameter is chosen inside its outer fold.

Rows get folds, roles, offsets and design columns as in the linear evaluation. The design of a feature
space is one vector column, sparse where indicators make it so, and the candidates of a fold are tree
parameters times vector columns. Inner spatial folds run through Spark ML's ``CrossValidator`` on the fold
column; inner temporal folds are fits on the years before. Outer folds run side by side in a small
pool of driver threads, each submitting distributed jobs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import prep, trees
from ..operators.linear import components_for_share, eigen, gram, scales, unpack
from ..operators.metrics import add_intervals, conformal_radius
from ..session import cut_lineage, settled
from .evaluate import KEY, SHARES, design, fold_rows

GRIDS = {"random_forest": trees.FOREST_GRID, "boosted": trees.BOOST_GRID}


def fold_components(proper: DataFrame, climate: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(fold, share, means, weights): standardised principal components of ``climate`` that explain a share.

    ``weights`` has one array per component, divided by the columns' scales. One matrix per fold is read.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for fold, m in zip(pdf["fold"], pdf["m"]):
            n, mean, _, xx, _, _ = unpack(m)
            s = scales(xx, n)
            values, vectors = eigen(xx / np.outer(s, s))
            for share in shares:
                k = components_for_share(values, share)
                rows.append((fold, share, mean.tolist(), (vectors[:, :k] / s[:, None]).T.tolist()))
        return pd.DataFrame(rows, columns=["fold", "share", "means", "weights"])

    return gram(proper, climate, "_y", ["fold"]).groupBy("fold").applyInPandas(run, "fold int, share double, means array<double>, weights array<array<double>>")


def vector_columns(rows: DataFrame, climate: Sequence[str], static: Sequence[str], columns: Sequence[str], spaces: Sequence[str]) -> tuple[DataFrame, dict[str, dict[str, float]]]:
    """``rows`` with a vector column per feature space and variance share, and {space: {column: share}}.

    raw: all design columns; pca: components of climate and the indicators; hybrid: the static columns too.
    """
    # Spark ML reads dots and quotes in names as syntax
    safe = {c: f"_x{i}" for i, c in enumerate(columns)}
    rows = rows.withColumns({v: F.col(f"`{k}`") for k, v in safe.items()})
    indicators = [safe[c] for c in columns if c not in (*climate, *static)]
    own = {"raw": [safe[c] for c in columns], "pca": indicators, "hybrid": [*[safe[c] for c in static], *indicators]}
    made: dict[str, dict[str, float]] = {}
    parts: dict[str, list[str]] = {}
    if set(spaces) - {"raw"}:
        table = settled(fold_components(rows.filter("role = 'proper'"), [safe[c] for c in climate], SHARES))
        wide = table.groupBy("fold").agg(*[F.first(F.when(F.col("share") == s, F.struct("means", "weights")), ignorenulls=True).alias(f"_c{i}") for i, s in enumerate(SHARES)])
        rows = rows.join(F.broadcast(wide), "fold")  # one row per fold
        x = F.array(*[F.col(safe[c]).cast("double") for c in climate])
        for i in range(len(SHARES)):
            centred = F.zip_with(x, F.col(f"_c{i}.means"), lambda a, b: a - b)
            scores = F.transform(F.col(f"_c{i}.weights"), lambda w: F.aggregate(F.zip_with(centred, w, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
            rows = rows.withColumn(f"_pc{i}", array_to_vector(scores))
    for space in spaces:
        made[space] = {}
        for i, share in enumerate([1.0] if space == "raw" else SHARES):
            name = f"_v_{space}_{i}"
            parts[name] = own[space] if space == "raw" else [f"_pc{i}", *own[space]]
            made[space][name] = share
    for name, inputs in parts.items():
        rows = VectorAssembler(inputCols=inputs, outputCol=name, handleInvalid="error").transform(rows)
    return rows, made


def best_by_folds(proper: DataFrame, kind: str, candidates: Sequence[tuple[str, Mapping[str, object]]], fixed: Mapping[str, object], seed: int, temporal: bool, parallelism: int):
    """(place of the best candidate, its mean inner RMSE, the model refitted on all rows of ``proper``).

    A candidate is a vector column and tree parameters. Ties: the first candidate.
    """
    base = trees.estimator(kind, fixed, "_y", seed)
    maps = [{base.getParam("featuresCol"): v, **{base.getParam(k): x for k, x in params.items()}} for v, params in candidates]
    inner = sorted(r[0] for r in proper.select("inner").distinct().collect())  # a handful
    evaluator = RegressionEvaluator(labelCol="_y", metricName="rmse")
    if not temporal:
        if len(inner) < 2:
            raise ValueError("too few units for inner folds")
        place = reduce(lambda c, x: c.when(F.col("inner") == x[1], x[0]), list(enumerate(inner))[1:], F.when(F.col("inner") == inner[0], 0))
        search = CrossValidator(estimator=base, estimatorParamMaps=maps, evaluator=evaluator, numFolds=len(inner), foldCol="_cv", parallelism=parallelism, seed=seed)
        fitted = search.fit(proper.withColumn("_cv", place.cast("int")))
        return int(np.argmin(fitted.avgMetrics)), float(min(fitted.avgMetrics)), fitted.bestModel
    if len(inner) < 4:
        raise ValueError("too few years for inner temporal validation")

    def error(work):
        year, candidate = work
        model = base.fit(proper.filter(F.col("inner") < year), maps[candidate])
        return candidate, evaluator.evaluate(model.transform(proper.filter(F.col("inner") == year)))

    errors: list[list[float]] = [[] for _ in maps]
    with ThreadPoolExecutor(parallelism) as pool:
        for candidate, e in pool.map(error, product(inner[2:], range(len(maps)))):
            errors[candidate].append(e)
    means = [float(np.mean(e)) for e in errors]
    best = int(np.argmin(means))
    return best, means[best], base.fit(proper, maps[best])


def _steady(rows: DataFrame) -> DataFrame:
    """The rows in partitions of the advised size, dealt and ordered by their keys.

    A fit over few rows then has few tasks, so that many fits run side by side, and the bootstrap, which goes by
    partition and place, draws the same rows in each run.
    """
    order = [c for c in rows.columns if c in (*KEY, "fold")]
    return rows.hint("rebalance", *order).sortWithinPartitions(*order, "observed_yield")


def tree_search(
    data: DataFrame,
    climate: Sequence[str],
    static: Sequence[str] = (),
    categorical: Sequence[str] = ("season", "crop"),
    target: str = "yield_tons_ha",
    kind: str = "random_forest",
    scale: str = "raw",
    spaces: Sequence[str] = ("raw", "pca", "hybrid"),
    grid: Sequence[Mapping[str, object]] | None = None,
    fixed: Mapping[str, object] | None = None,
    alpha: float = 0.10,
    folds: int = 5,
    seed: int = 42,
    mode: str = "spatial",
    minimum_years: int = 3,
    parallelism: int = 4,
    outer_at_once: int = 2,
) -> DataFrame:
    """Out-of-fold predictions with conformal intervals: one row per test row and feature space.

    In every outer fold the tree parameters of ``grid`` and, outside the raw space, the variance share are chosen by
    the mean RMSE over the inner folds of the proper-training rows; the best is refitted on all of these. Calibration rows give
    the radius. ``best_parameters`` has what was chosen. ``fixed`` overrides the 300 trees or 200 rounds.
    At most ``outer_at_once`` times ``parallelism`` fits run at a time.
    """
    climate, static, categorical = list(climate), list(static), list(categorical)
    grid = list(GRIDS[kind] if grid is None else grid)
    rows = fold_rows(data.dropna(subset=[target]), folds, seed=seed, mode=mode, minimum_years=minimum_years)
    rows = prep.training_offsets(rows, target) if scale == "crop_centered" else rows.withColumn("offset", F.lit(0.0))
    rows, columns = design(rows.withColumn("_y", F.col(target) - F.col("offset")), [*climate, *static], categorical)
    rows, vectors = vector_columns(rows, climate, static, columns, spaces)
    names = [v for s in vectors.values() for v in s]
    rows = cut_lineage(_steady(rows.select(*KEY, "fold", "role", "inner", "offset", "_y", F.col(target).cast("double").alias("observed_yield"), *names)))
    numbers = [r[0] for r in rows.select("fold").distinct().orderBy("fold").collect()]
    temporal = mode in ("temporal", "stress")

    def one(work: tuple[int, str]) -> DataFrame:
        fold, space = work
        own = rows.filter(F.col("fold") == fold)
        candidates = list(product(vectors[space], grid))
        best, error, model = best_by_folds(own.filter("role = 'proper'"), kind, candidates, fixed or {}, seed + fold, temporal, parallelism)
        vector, params = candidates[best]
        chosen = {**{k: str(v) for k, v in params.items()}, "variance_share": str(vectors[space][vector])}
        pairs = [F.lit(x) for item in sorted(chosen.items()) for x in item]
        scored = model.transform(own.filter("role <> 'proper'"))
        return scored.select(
            *KEY, "fold", "role", "observed_yield", (F.col("prediction") + F.col("offset")).alias("predicted_yield"), F.lit(kind).alias("model"),
            F.lit(space).alias("feature_space"), F.lit(scale).alias("target_scale"), F.lit(error).alias("inner_rmse"), F.create_map(*pairs).alias("best_parameters"))

    with ThreadPoolExecutor(outer_at_once) as pool:
        parts = list(pool.map(one, product(numbers, spaces)))
    scored = cut_lineage(reduce(DataFrame.unionByName, parts))
    cells = ["fold", "model", "feature_space", "target_scale"]
    calibration = scored.filter("role = 'calibration'").withColumn("absolute_residual", F.abs(F.col("observed_yield") - F.col("predicted_yield")))
    radius = settled(conformal_radius(calibration, cells, alpha=alpha))
    return add_intervals(scored.filter("role = 'test'").drop("role"), radius, cells, alpha)
