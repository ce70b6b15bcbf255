"""Queries over folds, preparation, linear models, baselines, metrics and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import baselines, components, diagnostics, folds, linear, metrics, prep, trees
from ..plans import evaluate, held_out
from ..session import settled
from . import inputs as I
from .base import query
from .inputs import r, rounded, sql

PK = "spatial_unit, year, season, crop"


def numbered_fold(unit="spatial_unit"):
    return F.pmod(F.regexp_extract(unit, r"(\d+)$", 1).cast("int"), F.lit(5)) + 1


FOLDED = {"folded": "select *, cast(regexp_extract(spatial_unit, '([0-9]+)$', 1) as integer) % 5 + 1 as fold from targets"}
# rolling-origin membership: test years 1998..2001, training rows strictly earlier
ROLLING = {
    "ro": "select cast(y - 1997 as integer) as fold, cast(y as integer) as test_year from range(1998, 2002) t(y)",
    "members_ro": "select t.*, ro.fold, case when t.year = ro.test_year then 'test' else 'train' end as role from targets t join ro on t.year <= ro.test_year",
}


def folded(spark, d):
    return I.targets(spark, d).withColumn("fold", numbered_fold())


def rolling(spark, d):
    t = I.targets(spark, d)
    return folds.rolling_membership(t, folds.rolling_origin(t))


# --- folds ---------------------------------------------------------------------------
@query("k01_spatial_folds", "K1", sql(
    "select cast(f as integer) as fold, (select count(distinct spatial_unit) from targets) // 5 as units from range(1, 6) t(f)", "targets"))
def spatial_folds(spark, d):
    t = folds.spatial_folds(I.targets(spark, d), 5)
    return t.groupBy("fold").agg(F.countDistinct("spatial_unit").alias("units"))


@query("k02_leave_one_unit_out", "K2", sql(
    """select spatial_unit as fold, n as test_rows, sum(n) over () - n as train_rows, round((sum(s) over () - s) / (sum(n) over () - n), 8) as training_mean
    from (select spatial_unit, count(*) as n, sum(yield_tons_ha) as s from targets group by 1)""".replace("sum(n) over () - n as train_rows", "cast(sum(n) over () - n as bigint) as train_rows"), "targets"))
def leave_one_out(spark, d):
    return rounded(folds.leave_one_unit_out(I.targets(spark, d)))


@query("k03_rolling_origin", "K3", sql(
    """select ro.fold, ro.test_year, cast(count(*) filter (year < test_year) as bigint) as train_rows, count(*) filter (year = test_year) as test_rows from targets, ro group by all""", "targets", extra=ROLLING))
def rolling_origin(spark, d):
    return folds.rolling_origin(I.targets(spark, d))


@query("k05_inner_temporal", "K5", sql(
    """select cast(y - 1996 as integer) as fold, cast(y as integer) as test_year, cast(count(*) filter (year < y) as bigint) as train_rows, count(*) filter (year = y) as test_rows from targets, range(1997, 2002) t(y) group by all""", "targets"))
def inner_temporal(spark, d):
    return folds.inner_temporal(I.targets(spark, d))


@query("k04_future_unseen", "K4", sql(
    """select a.year, a.spatial_unit, a.n as test_rows, cast(sum(b.n) as bigint) as train_rows, round(sum(b.s) / sum(b.n), 8) as training_mean
    from (select spatial_unit, year, count(*) as n from targets group by all) a join (select spatial_unit, year, count(*) as n, sum(yield_tons_ha) as s from targets group by all) b on b.year < a.year and b.spatial_unit <> a.spatial_unit
    where a.year in (select year from (select distinct year from targets) qualify row_number() over (order by year) > 3) group by all""", "targets"))
def future_unseen(spark, d):
    return rounded(folds.future_unseen(I.targets(spark, d)))


@query("k07_calibration_split", "K7 K6", sql(
    """select cast(f as integer) as fold, role, case role when 'test' then u // 5 when 'calibration' then cast(ceil((u - u // 5) * 0.2) as bigint) else (u - u // 5) - cast(ceil((u - u // 5) * 0.2) as bigint) end as units,
    case when role = 'proper' then 4 else 0 end as inner_folds
    from (select count(distinct spatial_unit) as u from targets), range(1, 6) t(f), (values ('test'), ('calibration'), ('proper')) x(role)""", "targets"))
def calibration_split(spark, d):
    roles = folds.calibration_split(folds.spatial_folds(I.targets(spark, d)))
    joined = roles.join(folds.inner_spatial(roles), ["fold", "spatial_unit"], "left")
    return joined.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("units"), F.countDistinct("inner").alias("inner_folds"))


@query("k08_random_folds", "K8", sql(
    "select cast(f as integer) as fold, n // 5 + case when f <= n % 5 then 1 else 0 end as rows from (select count(*) as n from orders), range(1, 6) t(f)"))
def random_folds(spark, d):
    return folds.random_folds(I.scan(spark, d, "orders"), ["o_orderkey"]).groupBy("fold").agg(F.count(F.lit(1)).alias("rows"))


@query("k08_balanced_group_folds", "K8", sql(
    """select * from (with recursive g as (select n, row_number() over (order by n desc) as i from (select spatial_unit, count(*) as n from targets group by 1)),
    deal as (select 0::bigint as i, [0, 0, 0, 0, 0]::bigint[] as load, [0, 0, 0, 0, 0]::bigint[] as units
      union all select g.i, list_transform(load, lambda x, k: x + case when k = list_position(load, list_min(load)) then g.n else 0 end),
        list_transform(units, lambda x, k: x + case when k = list_position(load, list_min(load)) then 1 else 0 end) from deal join g on g.i = deal.i + 1)
    select cast(f as integer) as fold, load[f] as rows, units[f] as units from (select * from deal order by i desc limit 1), range(1, 6) t(f) where load[f] > 0)""", "targets"))
def balanced_folds(spark, d):
    t = I.targets(spark, d)
    table = folds.balanced_group_folds(t, "spatial_unit")
    return t.join(table, "spatial_unit").groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("spatial_unit").alias("units"))


@query("k08_year_pair", "K8", sql("select role, count(*) as rows, round(avg(yield_tons_ha), 8) as mean_yield from (select *, case year when 1998 then 'train' when 2000 then 'test' end as role from targets) where role is not null group by 1", "targets"))
def year_pair(spark, d):
    return rounded(folds.year_pair(I.targets(spark, d), 1998, 2000).groupBy("role").agg(F.count(F.lit(1)).alias("rows"), F.avg("yield_tons_ha").alias("mean_yield")))


@query("k09_leave_one_row_out", "K9", sql(
    """select vec_id, round(x2 - (x2 - (b0 + b1 * x1)) / (1 - (1.0 / n + (x1 - mx)^2 / sxx)), 8) as loo_prediction from vectors,
    (select count(*) as n, avg(x1) as mx, regr_sxx(x2, x1) as sxx, regr_slope(x2, x1) as b1, regr_intercept(x2, x1) as b0 from vectors)""", "vectors"))
def leave_one_row(spark, d):
    return rounded(linear.leave_one_row_out(I.vectors(spark, d), ["x1"], "x2").select("vec_id", "loo_prediction"))


@query("k10_temporal_calibration", "K10", sql(
    "select fold, case when role = 'test' then 'test' when year = test_year - 1 then 'calibration' else 'proper' end as role, count(*) as rows from members_ro join ro using (fold) group by all", "targets", extra=ROLLING))
def temporal_calibration(spark, d):
    return folds.temporal_calibration(rolling(spark, d)).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("rows"))


# --- preparation -------------------------------------------------------------------------
@query("l01_fold_medians", "L1", sql(
    "select fold, feature, round(case feature when 'cv_production_pct' then a else b end, 8) as median from (select fold, quantile_cont(cv_production_pct, 0.5) as a, quantile_cont(area_planted_ha, 0.5) as b from members_ro where role = 'train' group by 1), (values ('cv_production_pct'), ('area_planted_ha')) f(feature)",
    "targets", extra=ROLLING))
def fold_medians(spark, d):
    return rounded(prep.exact_medians(rolling(spark, d), ["cv_production_pct", "area_planted_ha"]))


@query("l02_fold_modes", "L2", sql(
    "select fold, crop as mode from (select fold, crop, row_number() over (partition by fold order by count(*) desc, crop) as k from members_ro where role = 'train' group by fold, crop) where k = 1", "targets", extra=ROLLING))
def fold_modes(spark, d):
    return prep.training_modes(rolling(spark, d), "crop")


@query("l03_mean_impute_variance", "L3", sql(
    "select fold, feature, round(case feature when 'area_planted_ha' then a else b end, 6) as variance from (select fold, var_pop(area_planted_ha) as a, var_pop(v) as b from (select *, coalesce(case when crop <> 'promo' then area_harvested_ha end, avg(case when crop <> 'promo' and role = 'train' then area_harvested_ha end) over (partition by fold)) as v from members_ro) where role = 'train' group by 1), (values ('area_planted_ha'), ('area_harvested_ha')) f(feature)",
    "targets", extra=ROLLING))
def mean_impute(spark, d):
    rows = rolling(spark, d).withColumn("area_harvested_ha", F.when(F.col("crop") != "promo", F.col("area_harvested_ha")))
    filled = prep.impute_mean(rows, ["area_harvested_ha"]).withColumn("flat", F.lit(3.0))
    varying = prep.varying_columns(filled, ["area_planted_ha", "area_harvested_ha", "flat"])
    return rounded(prep.column_variances(filled, varying), 6)


@query("l04_standardise", "L4", sql(
    f"select fold, role, {PK}, round((area_planted_ha - avg(case when role = 'train' then area_planted_ha end) over (partition by fold)) / stddev_pop(case when role = 'train' then area_planted_ha end) over (partition by fold), 8) as area_planted_ha from members_ro", "targets", extra=ROLLING))
def standardise(spark, d):
    return rounded(prep.standardise(rolling(spark, d), ["area_planted_ha"]).select("fold", "role", *K.PANEL_KEY, "area_planted_ha"))


@query("l05_one_hot", "L5 L6", sql(
    "select fold, role, count(*) as rows, cast(count(*) filter (season = 'second_season') as double) as first_dropped, 0.0::double as unknown_level, cast(count(*) filter (season = 'first_season') as double) as kept_all from (select * from members_ro where not (crop = 'promo' and role = 'train')) group by all", "targets", extra=ROLLING))
def one_hot(spark, d):
    rows = rolling(spark, d).filter("not (crop = 'promo' and role = 'train')")
    coded, _ = prep.one_hot(rows, "season")
    coded, names = prep.one_hot(coded, "crop")
    full, _ = prep.one_hot(coded.withColumn("s", F.col("season")), "s", drop_first=False)
    zero = F.sum("`crop=promo`") if "crop=promo" in names else F.lit(0.0)
    return full.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("`season=second_season`").alias("first_dropped"), zero.alias("unknown_level"), F.sum("`s=first_season`").alias("kept_all"))


@query("l07_feature_space_raw", "L7", sql(
    f"select {PK}, round((area_planted_ha - (select avg(area_planted_ha) from targets)) / (select stddev_pop(area_planted_ha) from targets), 8) as area_planted_ha, round((cv - (select avg(cv) from filled)) / (select stddev_pop(cv) from filled), 8) as cv_production_pct, case when season = 'second_season' then 1.0::double else 0.0 end as \"season=second_season\" from filled",
    "targets", extra={"filled": "select *, coalesce(cv_production_pct, (select quantile_cont(cv_production_pct, 0.5) from targets)) as cv from targets"}))
def feature_space_raw(spark, d):
    t = I.targets(spark, d).select(*K.PANEL_KEY, "area_planted_ha", "cv_production_pct").withColumn("s", F.col("season"))
    out, _ = prep.feature_space(t, "raw", ["area_planted_ha"], ["cv_production_pct"], ["season"])
    return rounded(out.withColumn("season", F.col("s")).select(*K.PANEL_KEY, "area_planted_ha", "cv_production_pct", "`season=second_season`"))


@query("l08_feature_space_hybrid", "L7 L8 L9", None)
def feature_space_hybrid(spark, d):
    out, _ = prep.feature_space(I.vectors(spark, d, 6), "hybrid", ["x1", "x2", "x3"], ["x4"], share=0.9)
    return rounded(out)


# --- linear fits ---------------------------------------------------------------------------
FITS = """select fold, model, param, term, position, round(case model when 'dummy_mean' then case when position = 0 then my else 0 end when 'ridge' then case when position = 0 then my - mx * n * rho * sy / (n + param) / sx else n * rho * sy / (n + param) / sx end
  else case when position = 0 then b0 else b1 end end, 8) as coefficient, n from (select cast(f as integer) as fold, cast(count(*) as double) as n, avg(x1) as mx, avg(x2) as my, stddev_pop(x1) as sx, stddev_pop(x2) as sy, corr(x1, x2) as rho, regr_slope(x2, x1) as b1, regr_intercept(x2, x1) as b0
  from vectors, range(0, 5) t(f) where label % 5 <> f group by 1), (values ('dummy_mean', 0.0::double), ('ols', 0.0), ('ridge', 1.0), ('ridge', 100.0), ('pcr', 1.0), ('pls', 1.0)) m(model, param), (values ('intercept', 0), ('x1', 1)) t(term, position)"""


@query("l11_linear_fits", "L10 L11 L12 L13 L14", sql(FITS, "vectors"))
def linear_fits(spark, d):
    v = I.vectors(spark, d).withColumn("fold", F.col("label") % 5)
    train = linear.complement_grams(linear.gram(v, ["x1"], "x2", ["fold"]))
    specs = [("dummy_mean", 0.0), ("ols", 0.0), ("ridge", 1.0), ("ridge", 100.0), ("pcr", 1.0), ("pls", 1.0)]
    return rounded(linear.fit_table(train, ["x1"], specs, ["fold"]).withColumn("fold", F.col("fold").cast("int")))


@query("l12_scored_predictions", "L12 L19", sql(
    """select vec_id, fold, round(b0 + b1 * x1, 8) as predicted_yield from (select *, cast(label % 5 as integer) as fold from vectors) join (select cast(f as integer) as fold, regr_slope(x2, x1) as b1, regr_intercept(x2, x1) as b0 from vectors, range(0, 5) t(f) where label % 5 <> f group by 1) using (fold)""", "vectors"))
def scored(spark, d):
    v = I.vectors(spark, d).withColumn("fold", F.col("label") % 5)
    fits = linear.fit_table(linear.complement_grams(linear.gram(v, ["x1"], "x2", ["fold"])), ["x1"], [("ols", 0.0)], ["fold"])
    return rounded(linear.score(v, fits, ["x1"]).select("vec_id", F.col("fold").cast("int").alias("fold"), "predicted_yield"))


@query("l11_rolling_fits", "L11 K3", sql(
    "select cast(y as integer) as year, term, round(case term when 'intercept' then regr_intercept(yield_tons_ha, area_planted_ha) else regr_slope(yield_tons_ha, area_planted_ha) end, 8) as coefficient from targets, range(1998, 2002) t(y), (values ('intercept'), ('area_planted_ha')) x(term) where year < y group by y, term", "targets"))
def rolling_fits(spark, d):
    g = linear.gram(I.targets(spark, d), ["area_planted_ha"], "yield_tons_ha", ["year"])
    fits = linear.fit_table(linear.earlier_grams(g, first_test=1998), ["area_planted_ha"], [("ols", 0.0)], ["year"])
    return rounded(fits.select("year", "term", "coefficient"))


@query("l17_weighted_metrics", "L17", sql(
    """with w as (select *, 1 / pow(greatest(coalesce(cv_production_pct, (select quantile_cont(cv_production_pct, 0.5) from targets where year < 2000)), 1.0), 2) as w from targets),
    f as (select sum(w) as sw, sum(w * area_planted_ha) as sx, sum(w * yield_tons_ha) as sy, sum(w * area_planted_ha * area_planted_ha) as sxx, sum(w * area_planted_ha * yield_tons_ha) as sxy from w where year < 2000),
    g as (select *, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) as b from f),
    p as (select yield_tons_ha as y, (sy - b * sx) / sw + b * area_planted_ha as q from targets, g where year >= 2000)
    select round(sqrt(avg((y - q) * (y - q))), 6) as rmse, round(1 - sum((y - q) * (y - q)) / (count(*) * var_pop(y)), 6) as r2, count(*) as n_test, 'cv_production_pct' as uncertainty_weight_column from p""".replace("with w as", "select * from (with w as", 1) + ")", "targets"))
def weighted_metrics(spark, d):
    t = settled(I.targets(spark, d))
    return rounded(linear.weighted_fit_metrics(t.filter("year < 2000"), t.filter("year >= 2000"), ["area_planted_ha"], "yield_tons_ha", "cv_production_pct", least=1.0), 6)


@query("l17_weighted_fit", "L17", sql(
    """select term, round(case term when 'intercept' then (sy - b * sx) / sw else b end, 8) as coefficient from (select *, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) as b from (select sum(w) as sw, sum(w * x) as sx, sum(w * y) as sy, sum(w * x * x) as sxx, sum(w * x * y) as sxy from
    (select area_planted_ha as x, yield_tons_ha as y, 1 / pow(greatest(coalesce(cv_production_pct, (select quantile_cont(cv_production_pct, 0.5) from targets)), 1e-6), 2) as w from targets where cv_production_pct > 1 or cv_production_pct is null))), (values ('intercept'), ('area_planted_ha')) t(term)""", "targets"))
def weighted_fit(spark, d):
    t = settled(I.targets(spark, d))
    rows = t.filter("cv_production_pct > 1 or cv_production_pct is null")
    weighted = prep.impute_median(t.withColumn("role", F.lit("train")), ["cv_production_pct"], ())
    kept = weighted.join(rows.select(*K.PANEL_KEY), K.PANEL_KEY, "left_semi")
    g = linear.gram(kept, ["area_planted_ha"], "yield_tons_ha", weight=1 / F.pow(F.greatest("cv_production_pct", F.lit(1e-6)), 2))
    return rounded(linear.fit_table(g, ["area_planted_ha"], [("ols", 0.0)]).select("term", "coefficient"))


@query("l18_grid_search", "L18", sql(
    """select outer_fold, model, round(avg(e), 8) as inner_rmse from (select outer_fold, inner_fold, model, sqrt(avg(pow(x2 - case model when 'ols' then b0 + b1 * x1 else my end, 2))) as e from
      (select cast(label % 3 as integer) as outer_fold, cast(vec_id % 4 as integer) as inner_fold, x1, x2 from vectors) v join (select cast(label % 3 as integer) as outer_fold, cast(i as integer) as inner_fold, regr_slope(x2, x1) as b1, regr_intercept(x2, x1) as b0, avg(x2) as my from vectors, range(0, 4) t(i) where vec_id % 4 <> i group by 1, 2) f using (outer_fold, inner_fold),
      (values ('ols'), ('dummy_mean')) m(model) group by all) group by all""", "vectors"))
def grid_search(spark, d):
    v = I.vectors(spark, d).select("x1", "x2", (F.col("label") % 3).cast("int").alias("fold"), (F.col("vec_id") % 4).cast("int").alias("inner"))
    scores = linear.grid_search(linear.gram(v, ["x1"], "x2", ["fold", "inner"]), ["x1"], [("ols", 0.0), ("dummy_mean", 0.0)])
    return rounded(scores.select(F.col("fold").alias("outer_fold"), "model", "inner_rmse"))


@query("l20_crop_offsets", "L20", sql(
    f"""select m.fold, m.role, {', '.join('m.' + c for c in K.PANEL_KEY)}, round(coalesce(c.v, g.v), 8) as "offset" from members_ro m left join (select fold, crop, avg(yield_tons_ha) as v from members_ro where role = 'train' and crop <> 'promo' group by all) c on c.fold = m.fold and c.crop = m.crop
    join (select fold, avg(yield_tons_ha) as v from members_ro where role = 'train' and crop <> 'promo' group by 1) g on g.fold = m.fold where not (m.crop = 'promo' and m.role = 'train')""", "targets", extra=ROLLING))
def crop_offsets(spark, d):
    rows = rolling(spark, d).filter("not (crop = 'promo' and role = 'train')")
    return rounded(prep.training_offsets(rows).select("fold", "role", *K.PANEL_KEY, "offset"))


@query("l21_component_sweep", "L21", None)
def component_sweep(spark, d):
    v = I.vectors(spark, d, 11)
    features = [f"x{i}" for i in range(1, 11)]
    return rounded(linear.component_sweep(linear.gram(v, features, "x11"), features), 6)


@query("l23_log_target", "L23", sql(
    "select vec_id, round(ln(1 + abs(x1)), 8) as log_target, round(abs(x1), 8) as back from vectors", "vectors"))
def log_target(spark, d):
    from ..functions.scalars import back_transform_log
    from ..operators.clean import log_target as columns

    v = I.vectors(spark, d).withColumn("a", F.abs("x1"))
    out = v.withColumns(columns("a"))
    return rounded(out.select("vec_id", "log_target", back_transform_log("log_target").alias("back")))


CLIMATE = [f"x{i}" for i in range(1, 5)]


def model_rows(spark, d):
    """Vectors as panel rows: 25 units, seven years, two seasons, five crops; some gaps."""
    v = I.vectors(spark, d, 7)
    i = F.col("vec_id")
    return v.select(
        F.concat(F.lit("U"), F.pmod(i, F.lit(25)).cast("string")).alias("spatial_unit"), (1995 + F.pmod(i, F.lit(7))).cast("int").alias("year"),
        F.when(i % 2 == 0, "first_season").otherwise("second_season").alias("season"), F.concat(F.lit("c"), F.pmod("label", F.lit(5)).cast("string")).alias("crop"),
        "x1", "x2", F.when(i % 9 > 0, F.col("x3")).alias("x3"), "x4", "x5", "x6",
        (F.col("x1") - 0.5 * F.col("x2") + 0.2 * F.col("x7") + F.pmod("label", F.lit(5)) / 10 + 2).alias("yield_tons_ha"))


def fold_roles(spark, d, mode):
    """Folds, tested rows, row copies, and units or years on both sides of a fold."""
    rows = evaluate.fold_rows(I.targets(spark, d).dropna(subset=["yield_tons_ha"]), mode=mode)
    side = F.when(F.col("role") == "test", "test").otherwise("train")
    counts = rows.groupBy("fold").agg(F.count_if(side == "test").alias("t"), F.count(F.lit(1)).alias("n"))
    units = rows.groupBy("fold", "spatial_unit").agg(F.countDistinct(side).alias("sides"))
    mixed = F.count_if(F.col("sides") > 1)
    if mode == "temporal":
        spans = rows.groupBy("fold").agg(F.max(F.when(side == "train", F.col("year"))).alias("a"), F.min(F.when(side == "test", F.col("year"))).alias("b"))
        leaks = spans.agg(F.count_if(F.col("a") >= F.col("b")).alias("leaks"))
    else:
        leaks = units.agg(mixed.alias("leaks"))
    both = rows.groupBy("fold", "spatial_unit").agg(F.collect_set("role").alias("r"))
    shared = both.agg(F.count_if(F.array_contains("r", "proper") & F.array_contains("r", "calibration")).alias("calibration_leaks"))
    total = counts.agg(F.count(F.lit(1)).alias("folds"), F.sum("t").alias("test_rows"), F.sum("n").alias("copies"))
    return total.join(F.broadcast(leaks), F.lit(True), "inner").join(F.broadcast(shared), F.lit(True), "inner")


SIDES = "0::bigint as leaks, 0::bigint as calibration_leaks"
LATE = "(select year from (select distinct year from targets) qualify row_number() over (order by year) > 3)"


@query("k01_spatial_roles", "K1 K6 K7 L19", sql(f"select least(5, u) as folds, n as test_rows, n * least(5, u) as copies, {SIDES} from (select count(*) as n, count(distinct spatial_unit) as u from targets where yield_tons_ha is not null and spatial_unit is not null)", "targets"))
def spatial_roles(spark, d):
    return fold_roles(spark, d, "spatial")


@query("k02_loso_roles", "K2 K7 L19", sql(f"select u as folds, n as test_rows, n * u as copies, {SIDES} from (select count(*) as n, count(distinct spatial_unit) as u from targets where yield_tons_ha is not null and spatial_unit is not null)", "targets"))
def loso_roles(spark, d):
    return fold_roles(spark, d, "loso")


@query("k03_temporal_roles", "K3 K5 K7 L19", sql(f"""select count(*) as folds, sum(n)::bigint as test_rows, sum(b)::bigint as copies, {SIDES} from (
    select year, count(*) as n, (select count(*) from targets x where x.year <= t.year and x.yield_tons_ha is not null) as b from targets t where yield_tons_ha is not null and year in {LATE} group by year)""", "targets"))
def temporal_roles(spark, d):
    return fold_roles(spark, d, "temporal")


@query("k04_stress_roles", "K4 K7 L19", sql(f"""select count(*) as folds, sum(n)::bigint as test_rows, sum(n + b)::bigint as copies, {SIDES} from (
    select year, spatial_unit, count(*) as n, (select count(*) from targets x where x.year < t.year and x.spatial_unit <> t.spatial_unit and x.yield_tons_ha is not null) as b
    from targets t where yield_tons_ha is not null and year in {LATE} group by year, spatial_unit) where b > 0""", "targets"))
def stress_roles(spark, d):
    return fold_roles(spark, d, "stress")


HELD_ROWS = {"held": "select vec_id, label as spatial_unit, vec_id % 7 as year, case when vec_id % 9 > 0 then x1 end as f, x2 as y from vectors where label is not null"}
HELD_FIT = "count(*) as train_rows, regr_slope(y, coalesce(f, fill)) as slope, regr_intercept(y, coalesce(f, fill)) as intercept, fill"
HELD_OUT = """round(slope, 6) as slope, round(intercept, 6) as intercept, round(fill, 6) as fill, count(*) as test_rows,
      round(sqrt(avg(pow(y - intercept - slope * coalesce(f, fill), 2))), 6) as rmse"""


def held_rows(spark, d):
    v = I.vectors(spark, d).filter("label is not null")
    return v.select("vec_id", F.col("label").alias("spatial_unit"), (F.col("vec_id") % 7).alias("year"), F.when(F.col("vec_id") % 9 > 0, F.col("x1")).alias("f"), F.col("x2").alias("y"))


def held_report(rows, fits, on):
    """Each fold's fit beside its error on the rows it left out."""
    scored = held_out.predict_held_out(rows, fits, ["f"], on)
    errors = scored.groupBy(*on).agg(F.count(F.lit(1)).alias("test_rows"), F.sqrt(F.avg(F.pow(F.col("y") - F.col("predicted_yield"), 2))).alias("rmse"))
    table = fits.select(*on, "train_rows", F.col("coef")[0].alias("slope"), "intercept", F.col("fill")[0].alias("fill"))
    return rounded(table.join(errors, on), 6)


@query("k02_unit_out_fits", "K2 L19 L18", sql(f"""select spatial_unit, train_rows, {HELD_OUT} from held join (
    select u, {HELD_FIT} from held join (select u, avg(f) as fill from held, (select distinct spatial_unit as u from held) where spatial_unit <> u group by u) on spatial_unit <> u group by u, fill)
    on spatial_unit = u group by spatial_unit, train_rows, slope, intercept, fill""", "vectors", extra=HELD_ROWS))
def unit_out_fits(spark, d):
    """Every label left out in turn: means of gaps, slope and intercept from the other labels alone, error on its own rows."""
    rows = held_rows(spark, d)
    return held_report(rows, held_out.leave_unit_out_fits(rows, ["f"], "y", specs=(("ols", (0.0,)),)), ["spatial_unit"])


@query("k04_future_unseen_fits", "K4 L19 L18", sql(f"""select spatial_unit, year, train_rows, {HELD_OUT} from held join (
    select u, t, {HELD_FIT} from held join (select u, t, avg(f) as fill from held, (select distinct spatial_unit as u, year as t from held where year >= 3) where spatial_unit <> u and year < t group by u, t)
      on spatial_unit <> u and year < t group by u, t, fill) on spatial_unit = u and year = t group by spatial_unit, year, train_rows, slope, intercept, fill""", "vectors", extra=HELD_ROWS))
def future_unseen_fits(spark, d):
    """The same for every label and year, trained on earlier years of the other labels."""
    rows = held_rows(spark, d)
    return held_report(rows, held_out.future_unseen_fits(rows, ["f"], "y", specs=(("ols", (0.0,)),)), ["spatial_unit", "year"])


@query("l19_unit_out_evaluation", "L19 L18 K2", sql(
    "select model, count(*) as rows, count(distinct label) as units, count(distinct label) as fits, true as inside from vectors, (values ('ols'), ('ridge')) m(model) where label is not null group by model", "vectors"))
def unit_out_evaluation(spark, d):
    """All 64 features with penalties chosen inside each left-out label: every row predicted once per model."""
    features = [f"x{i}" for i in range(1, 65) if i != 2]
    rows = I.vectors(spark, d, 64).filter("label is not null").withColumnRenamed("label", "spatial_unit")
    fits = settled(held_out.leave_unit_out_fits(rows, features, "x2"))
    kept = fits.groupBy("model").agg(F.countDistinct("spatial_unit").alias("fits"), F.every(F.col("param").isin(0.0, 0.01, 0.1, 1.0, 10.0, 100.0) & (F.col("inner_mse") > 0)).alias("inside"))
    scored = held_out.predict_held_out(rows, fits, features)
    return scored.groupBy("model").agg(F.count("predicted_yield").alias("rows"), F.countDistinct("spatial_unit").alias("units")).join(kept, "model")


@query("l19_temporal_evaluation", "L19 L18 K3 K5 M9", sql(
    "select model, count(*) as rows, count(distinct vec_id % 7) as years, 0::bigint as crossed from vectors, (values ('ols'), ('ridge')) m(model) where vec_id % 7 >= 4 group by model", "vectors"))
def temporal_evaluation(spark, d):
    """Rolling years with inner temporal folds: every later row predicted once per model, bounds in order."""
    p = evaluate.nested_evaluation(model_rows(spark, d), CLIMATE, ["x5", "x6"], spaces=("raw",), specs=(("ols", [0.0]), ("ridge", [0.1, 10.0])), mode="temporal", minimum_years=4)
    return p.groupBy("model").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("year").alias("years"),
        F.count_if((F.col("conformal_lower") > F.col("predicted_yield")) | (F.col("conformal_upper") < F.col("predicted_yield"))).alias("crossed"))


@query("l19_nested_evaluation", "L19 L18 L7 K1 K6 K7 M9", None)
def nested(spark, d):
    p = evaluate.nested_evaluation(model_rows(spark, d), CLIMATE, ["x5", "x6"])
    return rounded(p.drop("best_parameters"), 6)


@query("m06_out_of_fold_summary", "M6 L20 M5", None)
def oof_summary(spark, d):
    p = evaluate.nested_evaluation(model_rows(spark, d), CLIMATE, ["x5", "x6"], scale="crop_centered", spaces=("raw",), specs=(("ols", [0.0]), ("ridge", [0.1, 10.0])))
    return rounded(metrics.out_of_fold_summary(p).orderBy("rmse", "mae"), 6)


@query("l15_random_forest", "L15", None)
def random_forest(spark, d):
    p = evaluate.tree_evaluation(model_rows(spark, d), [*CLIMATE, "x5"], "random_forest", {"numTrees": 10, "maxDepth": 5, "minInstancesPerNode": 2}, folds=3)
    return rounded(metrics.error_metrics(p, ["model", "fold"]), 6)


@query("l16_boosted_trees", "L16", None)
def boosted(spark, d):
    p = evaluate.tree_evaluation(model_rows(spark, d), [*CLIMATE, "x5"], "boosted", {"maxIter": 10, "maxDepth": 2}, folds=2)
    return rounded(metrics.error_metrics(p, ["model", "fold"]), 6)


@query("l22_tree_importance", "L22 G4", None)
def importance(spark, d):
    model = trees.fit(model_rows(spark, d), [*CLIMATE, "x5", "x6"], "yield_tons_ha", "random_forest", {"numTrees": 20, "maxDepth": 5})
    return rounded(model.importance(spark), 6)


# --- baselines --------------------------------------------------------------------------------
SPATIAL = {**FOLDED, **{
    "g": "select f as fold, avg(yield_tons_ha) as m from folded, range(1, 6) t(f) where fold <> f group by 1",
    "c": "select f as fold, crop, avg(yield_tons_ha) as m from folded, range(1, 6) t(f) where fold <> f group by 1, 2",
    "cs": "select f as fold, crop, season, avg(yield_tons_ha) as m from folded, range(1, 6) t(f) where fold <> f group by 1, 2, 3",
    "sb": f"select {PK}, fold, yield_tons_ha, g.m as gm, c.m as cm, cs.m as csm from folded join g using (fold) left join c using (fold, crop) left join cs using (fold, crop, season)",
}}


@query("m01_spatial_baselines", "M1", sql(
    f"select {PK}, fold, round(gm, 8) as training_global_mean, round(coalesce(cm, gm), 8) as training_crop_mean, round(coalesce(csm, cm, gm), 8) as training_crop_season_mean from sb", "targets", extra=SPATIAL))
def spatial_baselines(spark, d):
    return rounded(baselines.spatial_baselines(folded(spark, d)).select(*K.PANEL_KEY, "fold", *baselines.BASELINES))


TEMPORAL = {**ROLLING, **{
    "sub": "select * from targets where not (crop = 'promo' and year < 2000)",
    "tb": """select t.*, (select avg(p.yield_tons_ha) from sub p where p.year < t.year) as gm, (select avg(p.yield_tons_ha) from sub p where p.year < t.year and p.crop = t.crop) as cm,
      (select avg(p.yield_tons_ha) from sub p where p.year < t.year and p.crop = t.crop and p.spatial_unit = t.spatial_unit) as hm,
      (select arg_max(p.yield_tons_ha, p.year) from sub p where p.year < t.year and p.crop = t.crop and p.spatial_unit = t.spatial_unit and p.season = t.season) as wave from sub t where t.year >= 1999"""}}


@query("m01_temporal_baselines", "M1 C12 C13", sql(
    f"""select {PK}, round(gm, 8) as training_global_mean, round(coalesce(hm, cm, gm), 8) as historical_subregion_crop_mean, round(coalesce(wave, cm, gm), 8) as previous_available_wave,
    case when wave is not null then 'none' when cm is not null then 'training_crop_mean' else 'training_global_mean' end as previous_available_wave_level from tb""", "targets", extra=TEMPORAL))
def temporal_baselines(spark, d):
    rows = I.targets(spark, d).filter("not (crop = 'promo' and year < 2000)")
    out = baselines.temporal_baselines(rows, 1999)
    return rounded(out.select(*K.PANEL_KEY, "training_global_mean", "historical_subregion_crop_mean", "previous_available_wave", "previous_available_wave_level"))


@query("m02_fallback_rates", "M2", sql(
    "select model, year, round(avg(case when miss then 1.0 else 0 end), 8) as fallback_rate, count(*) as rows from (select year, unnest(['historical_subregion_crop_mean', 'previous_available_wave', 'training_global_mean']) as model, unnest([hm is null, wave is null, gm is null]) as miss from tb) group by all", "targets", extra=TEMPORAL))
def fallback_rates(spark, d):
    rows = I.targets(spark, d).filter("not (crop = 'promo' and year < 2000)")
    long = baselines.baseline_predictions(baselines.temporal_baselines(rows, 1999), ["historical_subregion_crop_mean", "previous_available_wave", "training_global_mean"])
    return rounded(baselines.fallback_rates(long, ["model", "year"]))


@query("m03_older_baselines", "M3", sql(
    f"""select {PK}, fold, round(coalesce((select avg(b.yield_tons_ha) from rf b where b.fold <> a.fold and b.spatial_unit = a.spatial_unit), (select avg(b.yield_tons_ha) from rf b where b.fold <> a.fold)), 8) as historical_mean, round((select avg(b.yield_tons_ha) from rf b where b.fold <> a.fold), 8) as mean_predictor from rf a""",
    "targets", extra={"rf": "select *, year % 3 as fold from targets"}))
def older_baselines(spark, d):
    rows = I.targets(spark, d).withColumn("fold", F.col("year") % 3)
    return rounded(baselines.older_baselines(rows).select(*K.PANEL_KEY, "fold", "historical_mean", "mean_predictor"))


# --- metrics ------------------------------------------------------------------------------------
ERR = "sqrt(avg(pow(observed_yield - predicted_yield, 2))) as rmse, avg(abs(observed_yield - predicted_yield)) as mae, 1 - sum(pow(observed_yield - predicted_yield, 2)) / (count(*) * var_pop(observed_yield)) as r2"
RERR = "round(rmse, 8) as rmse, round(mae, 8) as mae, round(r2, 8) as r2"


@query("m04_error_metrics", "M4", sql(f"select model, fold, observations, {RERR} from (select model, fold, count(*) as observations, {ERR} from predictions group by all)", "predictions"))
def error_metrics(spark, d):
    return rounded(metrics.error_metrics(I.predictions(spark, d), ["model", "fold"]))


def with_means(spark, d):
    return I.predictions(spark, d).withColumns({"training_global_mean": F.lit(2.0), "training_crop_mean": 1.5 + F.length("crop") / 10})


@query("m05_skill_summary", "M5 M6", sql(
    f"""select model, 'raw' as feature_space, 'raw' as target_scale, observations, {RERR}, round(s1, 8) as skill_vs_training_global_mean, round(s2, 8) as skill_vs_training_crop_mean, 'overall' as result_scope, true as registered_primary_metric
    from (select model, count(*) as observations, {ERR}, 1 - sum(pow(observed_yield - predicted_yield, 2)) / sum(pow(observed_yield - 2.0, 2)) as s1, 1 - sum(pow(observed_yield - predicted_yield, 2)) / sum(pow(observed_yield - (1.5 + length(crop) / 10), 2)) as s2 from predictions group by 1)""", "predictions"))
def skill_summary(spark, d):
    return rounded(metrics.out_of_fold_summary(with_means(spark, d)))


@query("m07_macro_average", "M7", sql(
    f"select model, count(*) as observations, round(avg(rmse), 8) as rmse, round(avg(mae), 8) as mae, round(avg(r2), 8) as r2, 'macro_average' as result_scope from (select model, crop, {ERR} from predictions group by all) group by 1", "predictions"))
def macro(spark, d):
    per_crop = metrics.per_crop_metrics(I.predictions(spark, d), ["model"])
    return rounded(metrics.macro_average(per_crop, ["model"]))


RADIUS = """select fold, model, count(*) as n, least(1.0, ceil((count(*) + 1) * 0.9) / count(*)) as lvl from predictions group by all"""
RAD = {"lv": RADIUS, "radius": """select fold, model, n as calibration_size, e as conformal_radius from (select *, abs(observed_yield - predicted_yield) as e, row_number() over (partition by fold, model order by abs(observed_yield - predicted_yield)) as k from predictions) p
  join lv using (fold, model) where k = ceil(round(lvl * (n - 1), 9)) + 1"""}


@query("m09_conformal_radius", "M9", sql("select fold, model, calibration_size, round(conformal_radius, 8) as conformal_radius from radius", "predictions", extra=RAD))
def radius(spark, d):
    rows = I.predictions(spark, d).withColumn("absolute_residual", F.abs(F.col("observed_yield") - F.col("predicted_yield")))
    return rounded(metrics.conformal_radius(rows, ["fold", "model"], alpha=0.1))


@query("m08_interval_coverage", "M8", sql(
    """select case when grouping(crop) = 0 then 'crop' when grouping(season) = 0 then 'season' else 'overall' end as aggregation_level, model, 'raw' as feature_space, 'raw' as target_scale, coalesce(crop, '') as crop, coalesce(season, '') as season, 0.9::double as nominal_coverage,
    round(avg(case when observed_yield between predicted_yield - conformal_radius and predicted_yield + conformal_radius then 1.0 else 0 end), 8) as actual_coverage, round(avg(conformal_radius * 2), 8) as mean_interval_width, count(*) as observations,
    min(calibration_size) as calibration_size_min, min(fold) as calibration_group_count_min, max(fold) as calibration_group_count_max from predictions join radius using (fold, model) group by grouping sets ((model), (model, crop), (model, season))""", "predictions", extra=RAD))
def coverage(spark, d):
    p = I.predictions(spark, d)
    rows = p.withColumn("absolute_residual", F.abs(F.col("observed_yield") - F.col("predicted_yield")))
    rad = metrics.conformal_radius(rows, ["fold", "model"], alpha=0.1)
    full = metrics.add_intervals(p, rad, ["fold", "model"], 0.1).withColumn("calibration_group_count", F.col("fold"))
    return rounded(metrics.interval_coverage(full))


@query("m10_in_sample_interval", "M10", sql(
    "select model, round(q, 8) as interval_radius, round(avg(case when abs(observed_yield - predicted_yield) <= q then 1.0 else 0 end), 8) as interval_coverage, 'in_sample' as coverage_basis from predictions join (select model, quantile_cont(abs(observed_yield - predicted_yield), 0.95) as q from predictions group by 1) using (model) group by model, q", "predictions"))
def in_sample(spark, d):
    return rounded(metrics.in_sample_interval(I.predictions(spark, d), ["model"]))


@query("m11_anomaly_r2", "M11 E13", sql(
    "select model, round(1 - sum(pow(observed_yield - predicted_yield, 2)) / sum(pow(observed_yield - m, 2)), 8) as anomaly_r2 from (select *, avg(observed_yield) over (partition by model, spatial_unit) as m from predictions) group by 1", "predictions"))
def anomaly(spark, d):
    return rounded(metrics.anomaly_r2(I.predictions(spark, d), "spatial_unit", keys=["model"]))


@query("m12_cluster_bootstrap", "M12", None)
def bootstrap(spark, d):
    return rounded(metrics.cluster_bootstrap(with_means(spark, d), iterations=200), 6)


@query("m13_residuals", "M13", sql(
    f"select {PK}, model, round(observed_yield, 10) as observed_yield, round(predicted_yield, 10) as predicted_yield, round(observed_yield - predicted_yield, 10) as residual, round(abs(observed_yield - predicted_yield), 10) as absolute_error from predictions", "predictions"))
def residuals(spark, d):
    return rounded(metrics.residual_table(I.predictions(spark, d), [*K.PANEL_KEY, "model"]), 10)


@query("m14_model_agreement", "M14", sql("select model, round(avg(abs(observed_yield - predicted_yield)), 8) as mae, count(*) as n from predictions group by 1", "predictions"))
def agreement(spark, d):
    old = I.predictions(spark, d).withColumnsRenamed({"observed_yield": "y_true", "predicted_yield": "y_pred"})
    return rounded(metrics.model_agreement(old))


@query("m32_fold_mean_scores", "M32", sql(
    f"select model, count(*) as folds, round(avg(r2), 8) as mean_r2, round(sqrt(avg(rmse * rmse)), 8) as root_mean_mse from (select model, fold, {ERR} from predictions group by all) group by 1", "predictions"))
def fold_means(spark, d):
    return rounded(metrics.fold_mean_scores(I.predictions(spark, d), ["model"]))


@query("m33_fold_results", "M33", sql(
    f"select fold, model, 'raw' as feature_space, 'raw' as target_scale, test_rows, {RERR}, fold as calibration_size, cast(fold as varchar) as best_parameters from (select fold, model, count(*) as test_rows, {ERR} from predictions group by all)", "predictions"))
def fold_results(spark, d):
    p = I.predictions(spark, d).withColumns({"calibration_size": F.col("fold"), "best_parameters": F.create_map(F.lit("param"), F.col("fold").cast("string"))})
    out = metrics.fold_results(p)
    return rounded(out.withColumn("best_parameters", F.col("best_parameters")["param"]))


# --- components and diagnostics --------------------------------------------------------------------
SPEC2 = "select abs(corr(x1, x2)) as r, count(*)::double as n from vectors"


@query("m23_eigenvalues", "M23 L9 E14", sql(
    f"select cast(k as integer) as component, round((1 + case k when 1 then r else -r end) * n / (n - 1), 8) as eigenvalue, round((1 + case k when 1 then r else -r end) / 2, 8) as share, round(case k when 1 then (1 + r) / 2 else 1.0 end, 8) as cumulative_share from ({SPEC2}), range(1, 3) t(k)", "vectors"))
def eigenvalues(spark, d):
    return rounded(components.eigenvalues(I.vectors(spark, d), ["x1", "x2"]))


@query("m23_covariance_eigenvalues", "M23", sql(
    """select cast(k as integer) as component, round((a + c) / 2 + case k when 1 then 1 else -1 end * sqrt(pow((a - c) / 2, 2) + b * b), 8) as eigenvalue from (select var_samp(x1) as a, covar_samp(x1, x2) as b, var_samp(x2) as c from vectors), range(1, 3) t(k)""", "vectors"))
def covariance_eigenvalues(spark, d):
    return rounded(components.eigenvalues(I.vectors(spark, d), ["x1", "x2"], correlation=False).select("component", "eigenvalue"))


@query("m25_loadings", "M25 M28", sql(
    f"select cast(k as integer) as component, feature, round(sqrt((1 + case k when 1 then r else -r end) * n / (n - 1) / 2), 8) as loading_size, 50.0::double as contribution_pct from ({SPEC2}), range(1, 3) t(k), (values ('x1'), ('x2')) f(feature)", "vectors"))
def loadings(spark, d):
    t = components.loadings(I.vectors(spark, d), ["x1", "x2"])
    return rounded(t.select("component", "feature", F.abs("loading").alias("loading_size"), "contribution_pct"))


@query("m27_retention", "M27", sql(f"select case when (1 + r) / 2 < 0.85 then 2 else 1 end::bigint as by_share, 1::bigint as by_kaiser from ({SPEC2})", "vectors"))
def retention(spark, d):
    return components.retention(components.eigenvalues(I.vectors(spark, d), ["x1", "x2"]))


@query("m24_parallel_analysis", "M24 M27", None)
def parallel(spark, d):
    return rounded(components.parallel_analysis(I.vectors(spark, d, 6), [f"x{i}" for i in range(1, 7)], ["vec_id"]), 6)


@query("m26_bootstrap_components", "M26", None)
def bootstrap_components(spark, d):
    return rounded(components.bootstrap_components(I.vectors(spark, d, 6), [f"x{i}" for i in range(1, 7)], ["vec_id"], 3), 6)


ALL64 = [f"x{i}" for i in range(1, 65)]


@query("m24_null_spectrum", "M24", sql(
    "select cast(i as integer) as iter, 64::bigint as components, round(64.0 * n / (n - 1), 6) as trace from (select count(*) as n from vectors), range(1, 201) t(i)", "vectors"))
def null_spectrum(spark, d):
    """Every permuted correlation matrix keeps the trace p n / (n - 1), over all 64 columns."""
    grams = components.permuted_grams(I.vectors(spark, d, 64), ALL64, ["vec_id"])
    spectra = components._iteration_spectra(grams)
    return rounded(spectra.groupBy("iter").agg(F.count(F.lit(1)).alias("components"), F.sum("eigenvalue").alias("trace")), 6)


@query("m26_direction_bounds", "M26", sql(
    "select cast(c as integer) as component, 64::bigint as features, 1.0::double as length, true as ordered from range(1, 3) t(c) where (select count(*) from vectors) > 0", "vectors"))
def direction_bounds(spark, d):
    """Two aligned directions over all 64 columns: unit length, lower <= mean <= upper."""
    t = components.bootstrap_directions(I.vectors(spark, d, 64), ALL64, ["vec_id"], 2)
    inside = (F.col("lower") <= F.col("mean")) & (F.col("mean") <= F.col("upper"))
    return t.groupBy("component").agg(
        F.count(F.lit(1)).alias("features"), F.round(F.sum(F.col("reference") * F.col("reference")), 6).alias("length"), F.every(inside).alias("ordered"))


@query("m23_full_spectrum", "M23 M25", sql(
    "select 64::bigint as components, round(64.0 * n / (n - 1), 6) as trace, 6400.0::double as contributions from (select count(*) as n from vectors)", "vectors"))
def full_spectrum(spark, d):
    """Spectrum and contributions of all 64 columns."""
    t = components.loadings(I.vectors(spark, d, 64), ALL64)
    one = t.groupBy("component").agg(F.max("eigenvalue").alias("e"), F.sum("contribution_pct").alias("c"))
    return one.agg(F.count(F.lit(1)).alias("components"), F.round(F.sum("e"), 6).alias("trace"), F.round(F.sum("c"), 6).alias("contributions"))


@query("m18_coefficient_bounds", "M18", sql(
    "select unnest(['intercept', 'x1', 'x2']) as term, true as ordered where (select count(*) from vectors) > 0", "vectors"))
def coefficient_bounds(spark, d):
    t = components.bootstrap_coefficients(I.vectors(spark, d), ["x1", "x2"], "x3", ["vec_id"])
    return t.select("term", ((F.col("lower") <= F.col("mean")) & (F.col("mean") <= F.col("upper"))).alias("ordered"))


@query("m28_component_report", "M22 M24 M25 M26 M28", None)
def component_report(spark, d):
    rows = model_rows(spark, d)
    return rounded(components.component_report(rows, CLIMATE, K.ENVIRONMENT_KEY, 100), 6)


@query("m31_reconstruction_error", "M31", sql(
    """select vec_id, round(abs(z1 - sign(r) * z2) / sqrt(2), 8) as reconstruction_error from (select vec_id, (x1 - m1) / s1 as z1, (x2 - m2) / s2 as z2, r from vectors, (select avg(x1) as m1, avg(x2) as m2, stddev_pop(x1) as s1, stddev_pop(x2) as s2, corr(x1, x2) as r from vectors))""", "vectors"))
def reconstruction(spark, d):
    return rounded(components.reconstruction_error(I.vectors(spark, d), ["x1", "x2"], 1).select("vec_id", "reconstruction_error"))


@query("m15_variance_inflation", "M15", sql("select feature, round(1 / (1 - r * r), 8) as vif from (select corr(x1, x2) as r from vectors), (values ('x1'), ('x2')) f(feature)", "vectors"))
def vif(spark, d):
    return rounded(diagnostics.variance_inflation(I.vectors(spark, d), ["x1", "x2"]))


@query("m17_standardised_coefficients", "M17", sql(
    "select feature, round(coefficient, 8) as coefficient from (select 'x1' as feature, n * rho * sy / (n + 1) as coefficient from (select count(*) as n, stddev_pop(x2) as sy, corr(x1, x2) as rho from vectors))", "vectors"))
def standardised(spark, d):
    return rounded(linear.standardised_coefficients(linear.gram(I.vectors(spark, d), ["x1"], "x2"), ["x1"]))


@query("m18_bootstrap_coefficients", "M18", None)
def bootstrap_coefficients(spark, d):
    return rounded(components.bootstrap_coefficients(I.vectors(spark, d), ["x1", "x2"], "x3", ["vec_id"]), 6)


def linear_predictor(spark, d, features):
    m = linear.gram(model_rows(spark, d), features, "yield_tons_ha").first()["m"]
    coef = [float(c) for c in linear.fit_matrix(m, "ridge", 1.0)]
    expr = sum((F.lit(c) * F.col(f) for c, f in zip(coef[1:], features)), F.lit(coef[0]))
    return lambda rows: rows.withColumn("prediction", expr)


@query("m16_permutation_importance", "M16", None)
def permutation(spark, d):
    rows = model_rows(spark, d).withColumn("fold", F.pmod(F.xxhash64("spatial_unit"), F.lit(3)).cast("int"))
    rows = rows.dropna(subset=CLIMATE).withColumn("row_key", F.concat_ws("|", *K.PANEL_KEY, F.col("x1").cast("string")))
    return rounded(diagnostics.permutation_importance(rows, CLIMATE, linear_predictor(spark, d, CLIMATE), ["row_key"]), 6)


@query("m19_partial_dependence", "M19", None)
def partial_dependence(spark, d):
    return rounded(diagnostics.partial_dependence(model_rows(spark, d).dropna(subset=CLIMATE), "x1", linear_predictor(spark, d, CLIMATE), 10), 6)


@query("m20_robust_outliers", "M20", None)
def outliers(spark, d):
    return rounded(diagnostics.robust_outliers(I.vectors(spark, d), ["x1", "x2", "x3"]), 6)


@query("m29_complete_case_columns", "M29 B26", sql(
    """select unnest(['rain_mm', 'tmax_c', 'tmin_c']) as "column", unnest([count(*) - count(rain_mm), 0, count(*) - count(tmin_c)]) as missing_count, unnest([count(rain_mm) = count(*), true, count(tmin_c) = count(*)]) as complete from daily""", "daily"))
def complete_case(spark, d):
    return diagnostics.complete_case_table(I.daily(spark, d), ["rain_mm", "tmax_c", "tmin_c"])
