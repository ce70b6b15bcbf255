"""Fits by differences of moments against fits on copied rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonpanel.operators.folds import spatial_folds
from seasonpanel.operators.linear import solve
from seasonpanel.plans import held_out

FEATURES = ["x1", "x2", "x3"]
SPECS = (("ols", (0.0,)), ("ridge", (0.1, 10.0, 1000.0)))


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    out = []
    for i in range(160):
        # a hot unit with a third of the rows; gaps, NaN, repeated rows, missing targets and units
        unit = "hot" if i % 3 == 0 else None if i == 100 else f"u{i % 5}"
        x = [float(v) for v in rng.normal(1000.0, 1.0, 3)]
        y = x[0] - 0.5 * x[1] + float(rng.normal()) if i % 20 else None
        x[2] = None if i % 7 == 0 else float("nan") if i % 11 == 0 else x[2]
        out += [(i, unit, 2000 + i % 6, *x, y)] * (2 if i == 7 else 1)
    return spark.createDataFrame(out, "id int, spatial_unit string, year int, x1 double, x2 double, x3 double, y double").cache()


def copied(train, test):
    """(training X with means of the training rows, test X filled by the same means)."""
    fill = np.nanmean(train[:, :-1], axis=0)
    put = lambda a: np.where(np.isnan(a[:, :-1]), fill, a[:, :-1])
    return put(train), put(test)


def fit(train, kind, param):
    x, _ = copied(train, train)
    mean, s, y = x.mean(axis=0), x.std(axis=0), train[:, -1]
    z = (x - mean) / s
    b = solve(kind, z.T @ z, z.T @ (y - y.mean()), len(y), param) / s
    return y.mean() - mean @ b, b


def predict(train, test, kind, param):
    a, b = fit(train, kind, param)
    return a + copied(train, test)[1] @ b


def nested(train, inner, test, kind, params):
    """The plain way: rows copied for every fold, inner folds as (training, validation) rows."""
    errors = [np.mean([((predict(a, v, kind, p) - v[:, -1]) ** 2).mean() for a, v in inner]) for p in params]
    p = params[int(np.argmin(errors))]
    return p, min(errors), predict(train, test, kind, p)


def table(rows):
    local = rows.where("spatial_unit is not null and y is not null").orderBy("id").collect()
    values = np.array([[np.nan if r[c] is None else r[c] for c in [*FEATURES, "y"]] for r in local], float)
    return np.array([r["spatial_unit"] for r in local]), np.array([r["year"] for r in local]), values


def check(fits, predicted, fold, train, inner, test):
    for kind, params in SPECS:
        param, error, wanted = nested(train, inner, test, kind, params)
        f = fits[(*fold, kind)]
        assert f["param"] == param and f["train_rows"] == len(train)
        assert f["inner_mse"] == pytest.approx(error, rel=1e-6)
        got = sorted(predicted[(*fold, kind)])
        assert np.allclose(got, sorted(wanted), rtol=0, atol=1e-5)


def by_fold(df, fits, on):
    scored = held_out.predict_held_out(df.where("y is not null"), fits, FEATURES, on).collect()
    predicted = {}
    for r in scored:
        predicted.setdefault((*[r[c] for c in on], r["model"]), []).append(r["predicted_yield"])
    return {(*[r[c] for c in on], r["model"]): r for r in fits.collect()}, predicted


def test_leave_unit_out_equals_copies(spark, rows):
    fits, predicted = by_fold(rows, held_out.leave_unit_out_fits(rows, FEATURES, "y", specs=SPECS, inner=3), ["spatial_unit"])
    units, _, values = table(rows)
    group = {r["spatial_unit"]: r["fold"] for r in spatial_folds(rows.where("y is not null"), 3).collect()}
    dealt = np.array([group[u] for u in units])
    assert {k[0] for k in fits} == set(units)
    for u in set(units):
        inner = [(values[(units != u) & (dealt != g)], values[(units != u) & (dealt == g)]) for g in (1, 2, 3)]
        inner = [(a, v) for a, v in inner if len(a) and len(v)]
        check(fits, predicted, (u,), values[units != u], inner, values[units == u])


def test_future_unseen_equals_copies(spark, rows):
    on = ["spatial_unit", "year"]
    fits, predicted = by_fold(rows, held_out.future_unseen_fits(rows, FEATURES, "y", specs=SPECS, minimum_years=3), on)
    units, years, values = table(rows)
    assert {k[:2] for k in fits} == {(u, int(y)) for u, y in zip(units, years) if y >= 2003}
    for u, t in {k[:2] for k in fits}:
        apart = units != u
        inner = [(values[apart & (years < s)], values[apart & (years == s)]) for s in range(2001, t)]
        inner = [(a, v) for a, v in inner if len(a) and len(v)]
        check(fits, predicted, (u, t), values[apart & (years < t)], inner, values[~apart & (years == t)])


def test_left_out_rows_do_not_change_their_fit(spark, rows):
    changed = rows.withColumn("y", F.when(F.col("spatial_unit") == "u1", F.lit(-500.0)).otherwise(F.col("y")))
    changed = changed.withColumn("x3", F.when(F.col("spatial_unit") == "u1", F.lit(None)).otherwise(F.col("x3")))
    a, b = (held_out.leave_unit_out_fits(df.where("y is not null"), FEATURES, "y", specs=SPECS).where("spatial_unit = 'u1'").orderBy("model").collect() for df in (rows, changed))
    for x, y in zip(a, b, strict=True):
        assert np.allclose([x["intercept"], *x["coef"], *x["fill"]], [y["intercept"], *y["coef"], *y["fill"]], rtol=1e-5)


def test_no_row_is_multiplied(spark, rows):
    plan = held_out.predict_held_out(rows, held_out.leave_unit_out_fits(rows, FEATURES, "y", specs=SPECS), FEATURES)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Cartesian" not in plan


def test_constant_and_empty_columns(spark, rows):
    flat = rows.withColumns({"x2": F.lit(3.7), "x3": F.lit(None).cast("double")})
    for fits in (held_out.leave_unit_out_fits(flat, FEATURES, "y"), held_out.future_unseen_fits(flat, FEATURES, "y")):
        got = fits.collect()
        assert got and all(r["coef"][1:] == [0.0, 0.0] and np.isfinite(r["intercept"]) for r in got)


def test_few_units_and_empty_tables(spark, rows):
    with pytest.raises(ValueError):
        held_out.leave_unit_out_fits(rows.where("spatial_unit = 'u1'"), FEATURES, "y")
    assert held_out.future_unseen_fits(rows.where("spatial_unit = 'u1'"), FEATURES, "y").count() == 0
    assert held_out.future_unseen_fits(rows.limit(0), FEATURES, "y").count() == 0
