"""Tree ensembles from Spark ML, behind the same call as the linear fits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# parameter grids of the evaluation; depth 30 is the deepest Spark ML grows
FOREST_GRID = [{"maxDepth": d, "minInstancesPerNode": leaf} for d in (30, 8) for leaf in (2, 4)]
BOOST_GRID = [{"maxDepth": d} for d in (2, 3)]


def estimator(kind: str, params: Mapping[str, object] | None = None, target: str = "yield_tons_ha", seed: int = 42):
    """random_forest: 300 trees, sqrt features. boosted: 200 rounds, rate 0.05,
    row share 0.8 (Spark ML has no column sampling or leaf penalty)."""
    given = dict(params or {})
    if kind == "random_forest":
        fixed = {"numTrees": 300, "featureSubsetStrategy": "sqrt", "seed": seed}
        return RandomForestRegressor(labelCol=target, **{**fixed, **given})
    if kind == "boosted":
        fixed = {"maxIter": 200, "stepSize": 0.05, "subsamplingRate": 0.8, "seed": seed}
        return GBTRegressor(labelCol=target, **{**fixed, **given})
    raise ValueError(f"unknown tree kind {kind}")


class FittedTrees:
    """Fitted model with its feature list; call it to add ``prediction``."""

    def __init__(self, model: Transformer, features: Sequence[str]):
        self.model, self.features = model, list(features)

    def __call__(self, rows: DataFrame) -> DataFrame:
        assembled = VectorAssembler(inputCols=self.features, outputCol="features", handleInvalid="keep").transform(rows)
        return self.model.transform(assembled).drop("features")

    def importance(self, spark, top: int = 15) -> DataFrame:
        values = [(f, float(v)) for f, v in zip(self.features, self.model.featureImportances.toArray())]
        return spark.createDataFrame(values, "feature string, importance double").orderBy(F.desc("importance")).limit(top)


def fit(rows: DataFrame, features: Sequence[str], target: str, kind: str, params: Mapping[str, object] | None = None, seed: int = 42) -> FittedTrees:
    clean = rows.dropna(subset=[*features, target])
    assembled = VectorAssembler(inputCols=list(features), outputCol="features").transform(clean).select("features", target)
    return FittedTrees(estimator(kind, params, target, seed).fit(assembled), features)


def tune(rows: DataFrame, features: Sequence[str], target: str, kind: str, grid: Sequence[Mapping[str, object]], inner: str = "inner", seed: int = 42):
    """Parameters with the least mean inner-fold RMSE. Fold numbers are few; each fit
    is one distributed job over the rows outside the inner fold."""
    folds = [r[0] for r in rows.select(inner).distinct().orderBy(inner).collect()]
    scores = []
    for i, params in enumerate(grid):
        errors = []
        for f in folds:
            model = fit(rows.filter(F.col(inner) != f), features, target, kind, params, seed)
            held = model(rows.filter(F.col(inner) == f))
            errors.append(held.agg(F.sqrt(F.avg(F.pow(F.col(target) - F.col("prediction"), 2)))).first()[0])
        scores.append((sum(errors) / len(errors), i))
    return dict(grid[min(scores)[1]])
