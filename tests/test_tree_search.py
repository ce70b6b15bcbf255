"""Trees in the nested search: choices, spaces, modes and leakage."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonpanel.plans.evaluate import KEY, design, fold_rows
from seasonpanel.plans.tree_search import best_by_folds, fold_components, tree_search, vector_columns

SMALL = {"random_forest": {"numTrees": 5}, "boosted": {"maxIter": 4}}


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(3)
    rows = []
    for u in range(9):
        for y in range(2000, 2006):
            x = [rng.gauss(0, 1) for _ in range(4)]
            crop = rng.choice(["maize", "rice", None])
            t = 2 + (x[0] > 0) * 1.5 + 0.1 * x[3] + (crop == "rice") + rng.gauss(0, 0.05)
            rows.append((f"u{u}", y, "s1", crop, x[0], x[1] if u else None, x[0] + x[2], x[3], t))
    return spark.createDataFrame(rows, "spatial_unit string, year int, season string, crop string, a double, b double, c double, s double, yield_tons_ha double").cache()


@pytest.mark.parametrize("kind, mode, spaces", [("random_forest", "spatial", ("raw", "hybrid")), ("boosted", "spatial", ("raw",)), ("random_forest", "temporal", ("pca",))])
def test_every_row_is_predicted_and_bounds_hold(panel, kind, mode, spaces):
    grid = [{"maxDepth": 1}, {"maxDepth": 5}]
    got = tree_search(panel, ["a", "b", "c"], ["s"], ["crop"], kind=kind, mode=mode, grid=grid, fixed=SMALL[kind], scale="crop_centered", spaces=spaces, folds=2, minimum_years=4).collect()
    tested = panel.count() if mode == "spatial" else panel.filter("year > 2003").count()
    assert len(got) == len(spaces) * tested == len(spaces) * len({tuple(r[k] for k in KEY) for r in got})
    assert all(r.conformal_lower <= r.predicted_yield <= r.conformal_upper for r in got)
    assert {r.best_parameters["maxDepth"] for r in got} <= {"1", "5"}
    assert {r.best_parameters["variance_share"] for r in got if r.feature_space != "raw"} <= {"0.8", "0.9", "0.95"}
    assert len({(r.fold, r.feature_space, r.inner_rmse) for r in got}) == len(spaces) * len({r.fold for r in got})
    if kind == "random_forest" and mode == "spatial":
        raw = [r for r in got if r.feature_space == "raw"]
        spread = np.std([r.observed_yield for r in raw])
        assert np.sqrt(np.mean([(r.observed_yield - r.predicted_yield) ** 2 for r in raw])) < 0.8 * spread


def test_vectors_equal_numpy_components(panel):
    rows, columns = design(fold_rows(panel, 3).withColumn("_y", F.col("yield_tons_ha")), ["a", "b", "c", "s"], ["crop"])
    kept = rows.filter("role = 'proper'")
    made, names = vector_columns(rows, ["a", "b", "c"], ["s"], columns, ("raw", "pca", "hybrid"))
    assert [len(v) for v in names.values()] == [1, 3, 3]
    for fold in (1, 2):
        x = np.array([[r.a, r.b, r.c] for r in kept.filter(F.col("fold") == fold).collect()])
        z = (x - x.mean(0)) / x.std(0)
        values, vectors = np.linalg.eigh(z.T @ z / len(z))
        k = int(np.searchsorted(np.cumsum(values[::-1]) / values.sum(), 0.9) + 1)
        part = made.filter((F.col("fold") == fold) & (F.col("role") == "proper")).select("a", "b", "c", "s", "_v_hybrid_1", "_v_raw_0").collect()
        for r in part:
            want = ((np.array([r.a, r.b, r.c]) - x.mean(0)) / x.std(0)) @ vectors[:, ::-1][:, :k]
            got = r._v_hybrid_1.toArray()
            assert np.allclose(np.abs(got[:k]), np.abs(want), atol=1e-6) and got[k] == r.s
            assert r._v_raw_0.toArray()[:4].tolist() == [r.a, r.b, r.c, r.s]
    table = fold_components(kept, ["a", "b", "c"], [0.8, 0.95]).collect()
    assert len(table) == 6 and all(len(r.weights) <= 3 for r in table)


def test_test_rows_do_not_reach_the_choice(panel):
    spoiled = panel.withColumn("yield_tons_ha", F.when(F.col("spatial_unit") == "u3", 1000.0).otherwise(F.col("yield_tons_ha")))
    fold = fold_rows(panel, 3).filter("role = 'test' and spatial_unit = 'u3'").first()["fold"]
    keep = lambda df: {tuple(r[k] for k in KEY): (r.predicted_yield, r.inner_rmse) for r in tree_search(df, ["a", "c"], ["s"], [], grid=[{"maxDepth": 3}], fixed={"numTrees": 5}, spaces=("raw",), folds=3).filter(F.col("fold") == fold).collect()}
    assert keep(panel) == keep(spoiled)


def test_best_is_the_first_least_error_and_too_few_years_raise(panel):
    rows = fold_rows(panel, 3, mode="temporal").filter("fold = 1 and role = 'proper'").withColumn("_y", F.col("yield_tons_ha"))
    made, names = vector_columns(rows.fillna(0.0), ["a", "c"], ["s"], ["a", "c", "s"], ("raw",))
    with pytest.raises(ValueError, match="too few years"):
        best_by_folds(made, "random_forest", [("_v_raw_0", {"maxDepth": 2})], {"numTrees": 2}, 1, True, 2)
    spatial = made.withColumn("inner", F.pmod(F.xxhash64("spatial_unit"), F.lit(3)).cast("int"))
    twice = [("_v_raw_0", {"maxDepth": 2}), ("_v_raw_0", {"maxDepth": 2})]
    assert best_by_folds(spatial, "random_forest", twice, {"numTrees": 2}, 1, False, 2)[0] == 0
