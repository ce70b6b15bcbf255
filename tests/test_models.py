"""Folds, linear algebra, baselines, intervals and diagnostics."""

import math
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonpanel.operators import baselines, components, diagnostics, folds, linear, metrics, prep
from seasonpanel.plans import evaluate


@pytest.fixture(scope="module")
def panel(spark):
    """120 rows of a seeded synthetic panel, hash-based so that every read agrees."""
    noise = lambda s: (F.pmod(F.xxhash64(F.lit(s), "id"), F.lit(10_000)) / 5000 - 1)
    base = spark.range(240).select(
        "id", F.concat(F.lit("u"), F.pmod("id", F.lit(12)).cast("string")).alias("spatial_unit"), (2015 + F.pmod(F.floor(F.col("id") / 24), F.lit(5))).cast("int").alias("year"),
        F.when(F.pmod("id", F.lit(2)) == 0, "first").otherwise("second").alias("season"), F.concat(F.lit("c"), F.pmod(F.floor(F.col("id") / 12), F.lit(2)).cast("string")).alias("crop"),
        *[noise(s).alias(f"x{s}") for s in range(1, 6)])
    return base.withColumn("yield_tons_ha", 2 + F.col("x1") - 0.5 * F.col("x2") + 0.1 * F.col("x5")).withColumn("x3", F.when(F.col("id") % 7 > 0, F.col("x3"))).cache()


def test_spatial_folds_keep_units_apart(spark, panel):
    table = folds.spatial_folds(panel, 5)
    rows = table.collect()
    assert len({r["spatial_unit"] for r in rows}) == len(rows) == 12
    assert {r["fold"] for r in rows} == {1, 2, 3, 4, 5}
    with pytest.raises(ValueError):
        folds.spatial_folds(panel.filter("spatial_unit = 'u1'"))


def test_calibration_units_are_neither_tested_nor_fitted(spark, panel):
    roles = folds.calibration_split(folds.spatial_folds(panel, 4)).collect()
    for f in range(1, 5):
        by_role = {role: {r["spatial_unit"] for r in roles if r["fold"] == f and r["role"] == role} for role in ("test", "proper", "calibration")}
        assert sum(map(len, by_role.values())) == 12
        assert len(by_role["calibration"]) == math.ceil(0.2 * 9)


def test_rolling_origin_never_trains_on_the_future(spark, panel):
    table = folds.rolling_origin(panel, 3)
    assert [r["test_year"] for r in table.orderBy("fold").collect()] == [2018, 2019]
    members = folds.rolling_membership(panel, table)
    worst = members.groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("year"))).alias("a"), F.min(F.when(F.col("role") == "test", F.col("year"))).alias("b")).collect()
    assert all(r["a"] < r["b"] for r in worst)
    with pytest.raises(ValueError):
        folds.rolling_origin(panel, 9)


def test_balanced_groups_spread_rows(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, "big").otherwise(F.concat(F.lit("g"), (F.col("id") % 20).cast("string"))).alias("g"))
    load = df.join(folds.balanced_group_folds(df, "g", 3), "g").groupBy("fold").count().collect()
    assert sorted(r["count"] for r in load) == [300, 300, 400]


def matrix(df, cols):
    return np.array([[r[c] for c in cols] for r in df.orderBy("id").collect()], float)


def test_linear_fits_agree_with_direct_solutions(spark, panel):
    cols = ["x1", "x2", "x4"]
    z = matrix(panel, [*cols, "yield_tons_ha"])
    x, y = z[:, :3], z[:, 3]
    m = linear.gram(panel, cols, "yield_tons_ha").first()["m"]
    direct = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
    assert linear.fit_matrix(m, "ols") == pytest.approx(direct, abs=1e-8)
    assert linear.fit_matrix(m, "pls", 3) == pytest.approx(direct, abs=1e-7)
    assert linear.fit_matrix(m, "pcr", 3) == pytest.approx(direct, abs=1e-8)
    s = x.std(axis=0)
    zx = (x - x.mean(axis=0)) / s
    w = np.linalg.solve(zx.T @ zx + 10 * np.eye(3), zx.T @ (y - y.mean()))
    assert linear.fit_matrix(m, "ridge", 10.0)[1:] == pytest.approx(w / s, abs=1e-9)
    coef = linear.fit_matrix(m, "ols")
    assert linear.squared_error(m, coef) == pytest.approx(float(((y - coef[0] - x @ coef[1:]) ** 2).sum()), abs=1e-7)


def test_gram_equals_matrix_products(spark, panel):
    cols = ["x1", "x2", "x4"]
    got = {r["crop"]: r["m"] for r in linear.gram(panel, cols, "yield_tons_ha", ["crop"], F.abs("x5")).collect()}
    pdf = panel.dropna(subset=[*cols, "yield_tons_ha"]).toPandas()
    assert set(got) == set(pdf["crop"])
    for crop, part in pdf.groupby("crop"):
        z = np.column_stack([np.ones(len(part)), part[[*cols, "yield_tons_ha"]].to_numpy(float)])
        assert got[crop] == pytest.approx((z.T @ (z * np.abs(part["x5"].to_numpy())[:, None])).ravel())


@pytest.mark.parametrize("k", [1, 2, 5, 7, 9])
def test_matches_are_the_best_assignment(k):
    rng = np.random.default_rng(k)
    for wide in (k, k + 2):
        a, b = rng.normal(size=(12, k)), rng.normal(size=(12, wide))
        strength = np.abs(a.T @ b)
        got = components.best_matches(a, b)
        assert len(set(got)) == k
        if k <= 5:
            best = max(strength[range(k), list(p)].sum() for p in permutations(range(wide), k))
            assert strength[range(k), got].sum() == pytest.approx(best)
        shuffled = rng.permutation(k)
        assert components.best_matches(a, a[:, shuffled]) == np.argsort(shuffled).tolist() or k > 12


def test_permuted_columns_keep_no_correlation_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(components, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(3)
    x = rng.normal(size=4_000)
    df = spark.createDataFrame([(i, float(v), float(v), float(v)) for i, v in enumerate(x)], "id long, a double, b double, c double")
    got = [np.array(r["m"]).reshape(5, 5) for r in components.permuted_grams(df, ["a", "b", "c"], ["id"], 60).collect()]
    r = []
    for m in got:
        assert m[0, 0] == pytest.approx(4_000, rel=1e-6) and m[1, 1] == pytest.approx((x * x).sum(), rel=0.02)
        c = m[1:4, 1:4] - np.outer(m[0, 1:4], m[0, 1:4]) / m[0, 0]
        r += [c[i, j] / np.sqrt(c[i, i] * c[j, j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    assert abs(np.mean(r)) < 4 / np.sqrt(len(r) * 4_000) and 0.7 < np.std(r) * np.sqrt(4_000) < 1.3


def test_groups_are_dealt_as_the_greedy_rule_does(spark):
    rng = np.random.default_rng(1)
    for sizes in ([7, 7, 7, 3, 3, 1], rng.integers(1, 9, 400).tolist(), [50] + [1] * 30):
        load = [0] * 5
        for n in sorted(sizes, reverse=True):
            load[load.index(min(load))] += n
        rows = [(f"g{i}",) for i, n in enumerate(sizes) for _ in range(n)]
        df = spark.createDataFrame(rows, "g string")
        table = folds.balanced_group_folds(df, "g")
        assert table.count() == len(sizes) == table.select("g").distinct().count()
        got = {r["fold"]: r["count"] for r in df.join(table, "g").groupBy("fold").count().collect()}
        assert [got.get(f, 0) for f in range(1, 6)] == load


def test_leave_one_row_out_equals_refitting(spark, panel):
    small = panel.filter("id < 12")
    z = matrix(small, ["x1", "yield_tons_ha"])
    got = [r["loo_prediction"] for r in linear.leave_one_row_out(small, ["x1"], "yield_tons_ha").orderBy("id").collect()]
    for i in range(len(z)):
        keep = np.arange(len(z)) != i
        slope, icept = np.polyfit(z[keep, 0], z[keep, 1], 1)
        assert got[i] == pytest.approx(icept + slope * z[i, 0], abs=1e-8)


@pytest.mark.parametrize("n", [10, 19, 100])
def test_conformal_rank(spark, n):
    df = spark.range(1, n + 1).select(F.col("id").cast("double").alias("absolute_residual"), F.lit(1).alias("fold"))
    level = min(1.0, math.ceil(round((n + 1) * 0.95, 9)) / n)
    want = float(np.quantile(np.arange(1, n + 1), level, method="higher"))
    assert metrics.conformal_radius(df, ["fold"]).first()["conformal_radius"] == want


def test_spatial_crop_baseline_needs_no_unit_history(spark):
    rows = spark.createDataFrame(
        [("a", 2018, "s", "maize", 1.0, 1), ("a", 2018, "s", "beans", 10.0, 1), ("b", 2018, "s", "maize", 5.0, 2), ("b", 2018, "s", "beans", 7.0, 2), ("b", 2018, "s", "rice", 7.0, 2)],
        "spatial_unit string, year int, season string, crop string, yield_tons_ha double, fold int")
    out = baselines.spatial_baselines(rows).filter("spatial_unit = 'b'")
    got = {r["crop"]: (r["training_crop_mean"], r["training_crop_mean_level"], r["training_crop_season_mean_level"]) for r in out.collect()}
    assert got["maize"][:2] == (1.0, "none") and got["beans"][0] == 10.0
    assert got["rice"] == (5.5, "training_global_mean", "training_global_mean")


def test_nested_evaluation_is_complete_and_leak_free(spark, panel):
    kwargs = dict(climate=["x1", "x2", "x3"], static=["x4"], spaces=("raw", "pca"), specs=(("ols", [0.0]), ("ridge", [0.1, 10.0])), folds=3)
    p = evaluate.nested_evaluation(panel, **kwargs).cache()
    assert p.count() == 240 * 4
    assert p.filter("predicted_yield is null or conformal_lower > predicted_yield or conformal_upper < predicted_yield").count() == 0
    assert p.agg(F.max("calibration_group_count")).first()[0] < 12
    fold1 = [r["spatial_unit"] for r in folds.spatial_folds(panel, 3).filter("fold = 1").collect()]
    changed = panel.withColumn("yield_tons_ha", F.when(F.col("spatial_unit").isin(fold1), F.lit(99.0)).otherwise(F.col("yield_tons_ha")))
    q = evaluate.nested_evaluation(changed, **kwargs).filter("fold = 1")
    key = ["spatial_unit", "year", "season", "crop", "model", "feature_space"]
    mine, theirs = (
        sorted((*[r[k] for k in key], round(r["predicted_yield"], 8)) for r in d.select(*key, "predicted_yield").collect()) for d in (p.filter("fold = 1"), q))
    assert mine == theirs
    coverage = metrics.interval_coverage(p)
    assert {r["aggregation_level"] for r in coverage.collect()} == {"overall", "crop", "season"}


def test_contributions_and_retention(spark, panel):
    cols = ["x1", "x2", "x4", "x5"]
    sums = components.loadings(panel, cols).groupBy("component").agg(F.sum("contribution_pct").alias("s")).collect()
    assert [r["s"] for r in sums] == pytest.approx([100.0] * 4)
    spectrum = components.eigenvalues(panel, cols)
    x = matrix(panel, cols)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    want = np.linalg.svd(z, compute_uv=False) ** 2 / (len(z) - 1)
    assert [r["eigenvalue"] for r in spectrum.orderBy("component").collect()] == pytest.approx(want.tolist())
    par = components.parallel_analysis(panel, cols, ["id"], iterations=50)
    assert par.filter("threshold > 0.8 and threshold < 1.6").count() == 4
    assert components.retention(spectrum, par).count() == 1


def test_alignment_undoes_sign_and_order():
    rng = np.random.default_rng(1)
    ref = np.linalg.qr(rng.normal(size=(5, 3)))[0]
    assert components.align_components(ref, -ref[:, [2, 0, 1]]) == pytest.approx(ref)


def test_bootstrap_is_repeatable_and_covers_the_estimate(spark, panel):
    a = components.bootstrap_coefficients(panel, ["x1", "x2"], "yield_tons_ha", ["id"], iterations=100).orderBy("term").collect()
    b = components.bootstrap_coefficients(panel.repartition(9), ["x1", "x2"], "yield_tons_ha", ["id"], iterations=100).orderBy("term").collect()
    for r, s in zip(a, b):
        assert r["lower"] == pytest.approx(s["lower"]) and r["lower"] < r["mean"] < r["upper"]
    x1 = next(r for r in a if r["term"] == "x1")
    assert x1["lower"] < 1.0 < x1["upper"]


def test_vif_of_collinear_columns(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 2.0), (3.0, 1.0)], "x double, y double")
    assert all(r["vif"] >= 1 for r in diagnostics.variance_inflation(df, ["x", "y"]).collect())
    assert diagnostics.variance_inflation(df, ["x"]).count() == 0


def test_chi_square_quantiles():
    # fixed values: standard table entries
    assert diagnostics.chi_square_quantile(0.95, 1) == pytest.approx(3.8415, abs=1e-3)
    assert diagnostics.chi_square_quantile(0.99, 3) == pytest.approx(11.3449, abs=1e-3)
    assert diagnostics.chi_square_quantile(0.5, 10) == pytest.approx(9.3418, abs=1e-3)


def test_outliers_find_planted_rows(spark, panel):
    planted = panel.withColumn("x1", F.when(F.col("id") < 12, F.col("x1") + 15).otherwise(F.col("x1")))
    flags = diagnostics.robust_outliers(planted, ["x1", "x2"]).filter("is_multivariate_outlier")
    assert flags.filter("id < 12").count() == 12
    assert flags.filter("id >= 12").count() < 12
    with pytest.raises(ValueError):
        diagnostics.robust_outliers(panel.limit(2), ["x1", "x2"])


def planted_cluster(spark, n=900):
    """Two fifths of the rows in a cloud across the grain of the others."""
    rng = np.random.default_rng(1)
    z = rng.normal(size=(n, 1)) + 0.2 * rng.normal(size=(n, 3))
    z[: n * 2 // 5] = np.array([-1.5, 1.5, -1.5]) + 0.5 * rng.normal(size=(n * 2 // 5, 3))
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(z)], "id int, x1 double, x2 double, x3 double")


def test_many_starts_find_a_cluster_that_the_medians_miss(spark):
    df, cols, n = planted_cluster(spark), ["x1", "x2", "x3"], 900
    flags = diagnostics.robust_outliers(df, cols).filter("is_multivariate_outlier")
    assert flags.filter(f"id < {n * 2 // 5}").count() == n * 2 // 5
    assert flags.filter(f"id >= {n * 2 // 5}").count() < n * 0.05
    h = (n + 4) // 2
    z = np.array([[r[c] for c in cols] for r in df.orderBy("id").collect()])
    middle = np.median(z, axis=0)
    plain = (middle, np.diag(np.median(abs(z - middle), axis=0) ** 2))
    starts = diagnostics.candidate_starts(df, cols, n, h, df.columns)
    alone, many = (diagnostics.minimum_determinant(df, cols, h, c) for c in ([plain], [plain, *starts]))
    assert len(starts) == 6 and np.linalg.det(many[1]) < 0.5 * np.linalg.det(alone[1])
    again = diagnostics.candidate_starts(df.repartition(7), cols, n, h, df.columns)
    assert all(np.allclose(a[0], b[0]) and np.allclose(a[1], b[1]) for a, b in zip(starts, again, strict=True))


def test_determinant_is_the_least_of_all_subsets(spark):
    rng = np.random.default_rng(3)
    z = np.vstack([rng.normal(size=(9, 2)), rng.normal(3.0, 0.4, size=(5, 2))])
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(z)], "id int, x1 double, x2 double")
    h = (14 + 3) // 2
    least = min(np.linalg.det(np.cov(z[list(k)].T, bias=True)) for k in combinations(range(14), h))
    found = diagnostics.minimum_determinant(df, ["x1", "x2"], h, diagnostics.candidate_starts(df, ["x1", "x2"], 14, h, df.columns))
    assert np.linalg.det(found[1]) == pytest.approx(least, rel=1e-9)


def test_repeated_and_tied_rows_keep_their_distances(spark, panel):
    copies = panel.unionByName(panel.filter("id < 80")).unionByName(panel.filter("id = 5").withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(100)))).drop("_n"))
    got = diagnostics.robust_outliers(copies, ["x1", "x2"], steps=4)
    assert got.count() == copies.count() and got.columns[: len(panel.columns)] == panel.columns
    assert got.groupBy("id").agg(F.countDistinct("mahalanobis_distance_squared").alias("d")).filter("d > 1").count() == 0


def test_permutation_importance_ranks_the_drivers(spark, panel):
    predict = lambda rows: rows.withColumn("prediction", 2 + F.col("x1") - 0.5 * F.col("x2"))
    got = {r["feature"]: r["importance_mean"] for r in diagnostics.permutation_importance(panel.withColumn("fold", F.lit(1)), ["x1", "x2", "x4"], predict, ["id"]).collect()}
    assert got["x1"] > got["x2"] > 0.01 and got["x4"] == pytest.approx(0, abs=1e-12)


def test_cluster_bootstrap_brackets_rmse(spark, panel):
    p = panel.select("spatial_unit", F.lit("m").alias("model"), F.lit("raw").alias("feature_space"), F.lit("raw").alias("target_scale"), F.col("yield_tons_ha").alias("observed_yield"), F.lit(2.0).alias("predicted_yield"))
    rmse = metrics.error_metrics(p, ["model"]).first()["rmse"]
    ci = metrics.cluster_bootstrap(p).first()
    assert ci["rmse_ci_lower"] < rmse < ci["rmse_ci_upper"]
    one = metrics.cluster_bootstrap(p.filter("spatial_unit = 'u1'")).first()
    assert one["rmse_ci_lower"] is None


def test_hybrid_space_replaces_component_inputs(spark, panel):
    out, names = prep.feature_space(panel.drop("yield_tons_ha"), "hybrid", ["x1", "x2"], ["x4"], ["crop"], share=1)
    assert "PC1" in names and not {"x1", "x2"} & set(names) and "crop=c1" in names


def test_permuted_grams_of_many_renamed_columns(spark, monkeypatch):
    """A plan whose condition spans all columns is listed once per subset of their names by a checkpoint."""
    monkeypatch.setattr(components, "BLOCK_ROWS", 30)
    cols = [f"x{i}" for i in range(40)]
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=40).tolist()) for i in range(90)] + [(90, [None] * 40), (91, [float("nan")] + [1.0] * 39)]
    df = spark.createDataFrame(rows, "id long, v array<double>").select("id", *[F.col("v")[i].alias(c) for i, c in enumerate(cols)])
    got = components.permuted_grams(df, cols, ["id"], 2).collect()
    assert len(got) == 2 and all(r["n"] == pytest.approx(90) for r in got)


def test_bootstrap_grams_hold_bounded_arrays(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, *rng.normal(size=3).tolist()) for i in range(500)], "id long, a double, b double, c double")
    grams = lambda: {r["iter"]: np.array(r["m"]) for r in components.bootstrap_grams(df, ["a", "b", "c"], ["id"], 20).collect()}
    whole = grams()
    monkeypatch.setattr(components, "CELLS", 140)
    cut = grams()
    assert set(cut) == set(whole) and all(np.allclose(cut[k], whole[k]) for k in whole)


@pytest.mark.parametrize("name", ["l17_weighted_fit", "l17_weighted_metrics"])
def test_weighted_fits_build_their_targets_once(spark, monkeypatch, name):
    from seasonpanel.registry import inputs, load

    built = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        built.add(1)
        return x

    rows = [(f"R{i % 5}", 1998 + i % 4, "annual", f"c{i}", 1.0 + i % 7, 10.0 + i * i % 50, 5.0, 3.0, None if i % 9 == 0 else 2.0 + i % 11) for i in range(80)]
    shape = "spatial_unit string, year int, season string, crop string, yield_tons_ha double, area_planted_ha double, area_harvested_ha double, production_mt double, cv_production_pct double"
    table = spark.createDataFrame(rows, shape).withColumn("cv_production_pct", seen("cv_production_pct"))
    monkeypatch.setattr(inputs, "targets", lambda spark, d: table)
    assert load()[0][name](spark, "").collect()
    assert built.value == len(rows)


def test_gram_of_no_rows(spark):
    """A row of nulls, as SQL's sums over no rows, whatever made the table empty; with groups there is no row."""
    none = spark.createDataFrame([], "g string, a double, b double")
    lacking = spark.createDataFrame([("u", 1.0, None), ("v", None, 2.0)], none.schema)
    for df in (none, lacking, lacking.repartition(3).filter("a > b")):
        assert [tuple(r) for r in linear.gram(df, ["a"], "b", weight=F.lit(0.5)).collect()] == [(None, None)]
        assert linear.gram(df, ["a"], "b", ["g"]).collect() == []
        fits = linear.fit_table(linear.gram(df, ["a"], "b"), ["a"], [("ols", 0.0), ("ridge", 1.0)]).collect()
        assert [tuple(r) for r in fits] == [(m, p, t, i, None, None) for m, p in (("ols", 0.0), ("ridge", 1.0)) for i, t in enumerate(("intercept", "a"))]
    with pytest.raises(ValueError):
        linear.leave_one_row_out(lacking, ["a"], "b")


@pytest.mark.parametrize("spread, kept", [(0, False), (9, True)])
def test_weighted_fit_matches_sql_with_and_without_rows(spark, tmp_path, spread, kept):
    """Totals of many or equal lines vary by less than one per cent, and then no row takes part in the fit."""
    import duckdb
    from oracle import compare

    from seasonpanel.registry import load

    con = duckdb.connect()
    tables = {
        "nation": "select i::integer as n_nationkey, 'N' || i as n_name, 0 as n_regionkey from range(3) t(i)",
        "supplier": "select i::bigint as s_suppkey, (i % 3)::integer as s_nationkey from range(6) t(i)",
        "part": "select i::bigint as p_partkey, 'TYPE ' || i % 2 as p_type from range(4) t(i)",
        "lineitem": f"""select (i % 4)::bigint as l_partkey, (i // 4 % 6)::bigint as l_suppkey, (20 + i * 7 % 11 * {spread} / 10)::double as l_quantity,
            (100 + i % 13)::double as l_extendedprice, 'N' as l_returnflag, timestamp '1996-01-15' + to_days((i * 37 % 1000)::integer) as l_shipdate from range(480) t(i)""",
    }
    for name, text in tables.items():
        con.execute(f"copy ({text}) to '{tmp_path}/{name}.parquet' (format parquet)")
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet')")
    queries, sqls, *_ = load()
    out = queries["l17_weighted_fit"](spark, str(tmp_path)).cache()
    assert compare(out, con, sqls["l17_weighted_fit"]) == ""
    assert {r["term"]: r["coefficient"] is not None for r in out.collect()} == {"intercept": kept, "area_planted_ha": kept}
