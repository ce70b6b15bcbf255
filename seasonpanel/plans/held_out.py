"""Leave-one-unit-out and future-and-unseen fits of linear models without a copy of any row.

One pass over the rows leaves a matrix of moments per unit, or per unit and year. Matrices add
and subtract, so the training side of a fold is the total minus the unit's own part, or the
running sum over earlier years minus the unit's own running sum. Missing predictors take the
mean of the training rows of their fold: the moments are kept over the rows in which both
columns of a pair are present, and from those the matrix of the filled columns follows for any
fill. Penalties are chosen inside each fold from such matrices alone; inner validation rows
take part in neither the means nor the scales of their inner fit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.folds import spatial_folds
from ..operators.linear import blocked_gram, fit_matrix, squared_error
from ..operators.ranks import null_safe_join
from ..session import settled

SPECS = (("ols", (0.0,)), ("ridge", (0.01, 0.1, 1.0, 10.0, 100.0)))
FIT = "model string, param double, train_rows long, inner_mse double, intercept double, coef array<double>, fill array<double>"


def present(column: str) -> Column:
    """The value as a double, null where it is missing or NaN."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def moments(df: DataFrame, features: Sequence[str], target: str, groups: Sequence[str], centre: Sequence[float]) -> DataFrame:
    """(groups, n, m): sums of products of (1, presence of each feature, features less ``centre``
    with 0 where missing, target) over rows with a target. ``centre`` only keeps numbers small."""
    values = [present(c) - float(mid) for c, mid in zip(features, centre)]
    have = {f"_a{i}": v.isNotNull().cast("double") for i, v in enumerate(values)}
    less = {f"_b{i}": F.coalesce(v, F.lit(0.0)) for i, v in enumerate(values)}
    rows = df.withColumn("_y", present(target)).where("_y is not null").withColumns({**have, **less})
    # no column is null here; a test for nulls over so many aliases would stall the optimizer
    return blocked_gram(rows.withColumn("_w", F.lit(1.0)), [*have, *less, "_y"], list(groups))


def fill_means(m: np.ndarray) -> np.ndarray:
    """Mean of each feature over the rows that have it; 0 where none has."""
    p = len(m) // 2 - 1
    n = m[0, 1 : p + 1]
    return np.where(n > 0.5, m[0, p + 1 : 2 * p + 1] / np.maximum(n, 1.0), 0.0)


def filled(m: np.ndarray, fill: np.ndarray, noise: np.ndarray | None = None) -> np.ndarray:
    """Matrix over (1, features less ``fill``, target) when missing values take ``fill``.

    Columns whose sum of squares is within ``noise``, what a difference of large sums leaves of
    a constant column, become exactly 0.
    """
    p = len(m) // 2 - 1
    a, b = slice(1, p + 1), slice(p + 1, 2 * p + 1)
    out = np.empty((p + 2, p + 2))
    cross = m[b, a] * fill[None, :]
    out[1:-1, 1:-1] = m[b, b] - cross - cross.T + m[a, a] * np.outer(fill, fill)
    for row, at in ((0, 0), (p + 1, 2 * p + 1)):
        out[row, 1:-1] = out[1:-1, row] = m[at, b] - fill * m[at, a]
    out[0, 0], out[-1, -1] = m[0, 0], m[-1, -1]
    out[0, -1] = out[-1, 0] = m[0, -1]
    if noise is not None:
        still = np.flatnonzero(np.diag(out)[1:-1] <= noise) + 1
        out[still, :] = out[:, still] = 0.0
    return out


def fit_parts(train: np.ndarray, kind: str, param: float, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(intercept and coefficients on filled, centred columns; fill)."""
    fill = fill_means(train)
    return fit_matrix(filled(train, fill, noise).ravel(), kind, param), fill


def inner_errors(pairs: Sequence[tuple[np.ndarray, np.ndarray]], specs: Sequence[tuple[str, Sequence[float]]], noise: np.ndarray) -> np.ndarray:
    """Mean squared error of every (training, validation) pair and parameter; NaN without rows."""
    flat = [(kind, param) for kind, params in specs for param in params]
    out = np.full((len(pairs), len(flat)), np.nan)
    for i, (train, valid) in enumerate(pairs):
        if train[0, 0] < 0.5 or valid[0, 0] < 0.5:
            continue
        for j, (kind, param) in enumerate(flat):
            coef, fill = fit_parts(train, kind, param, noise)
            out[i, j] = squared_error(filled(valid, fill).ravel(), coef) / valid[0, 0]
    return out


def chosen_fits(train: np.ndarray, errors: np.ndarray, specs: Sequence[tuple[str, Sequence[float]]], noise: np.ndarray, centre: np.ndarray) -> list[tuple]:
    """One row per model kind: the parameter of least mean inner error, the first of equals and
    the first where no inner fold has rows, fitted on the whole training side."""
    seen = ~np.isnan(errors).all(axis=1) if len(errors) else np.zeros(0, bool)
    mean = errors[seen].mean(axis=0) if seen.any() else np.full(errors.shape[1], np.nan)
    rows, at = [], 0
    for kind, params in specs:
        own = mean[at : at + len(params)]
        best = 0 if np.isnan(own).all() else int(np.nanargmin(own))
        coef, fill = fit_parts(train, kind, params[best], noise)
        error = None if np.isnan(own[best]) else float(own[best])
        fill = fill + centre
        rows.append((kind, float(params[best]), int(round(train[0, 0])), error, float(coef[0] - coef[1:] @ fill), coef[1:].tolist(), fill.tolist()))
        at += len(params)
    return rows


def _centre(df: DataFrame, features: Sequence[str]) -> np.ndarray:
    row = df.agg(*[F.coalesce(F.avg(present(c)), F.lit(0.0)).alias(f"_{i}") for i, c in enumerate(features)]).first()
    return np.array(row, float)


def _square(m) -> np.ndarray:
    q = int(round(len(m) ** 0.5))
    return np.asarray(m, float).reshape(q, q)


def _noise(total: np.ndarray) -> np.ndarray:
    p = len(total) // 2 - 1
    return 1e-13 * np.diag(total)[p + 1 : 2 * p + 1]


def leave_unit_out_fits(
    df: DataFrame, features: Sequence[str], target: str, unit: str = "spatial_unit", specs: Sequence[tuple[str, Sequence[float]]] = SPECS, inner: int = 4, seed: int = 42,
) -> DataFrame:
    """(unit, model, param, train_rows, inner_mse, intercept, coef, fill): one fit per unit and
    model kind on the rows of all other units.

    Rows without a unit or target take no part. Units are dealt into ``inner`` folds; the fold of
    each other unit in turn validates. The driver holds one matrix per inner fold, a task one unit
    at a time. A unit that is alone has no fit.
    """
    rows = df.where(F.col(unit).isNotNull() & present(target).isNotNull())
    centre = _centre(rows, features)
    dealt = spatial_folds(rows, inner, unit, seed)
    own = settled(moments(rows, features, target, [unit], centre).join(dealt.withColumnRenamed("fold", "_inner"), unit))
    parts = {r["_inner"]: _square(r["m"]) for r in _sums(own, "_inner").collect()}
    total = sum(parts.values())
    noise = _noise(total)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, m, mine in zip(pdf[unit], pdf["m"], pdf["_inner"]):
                train = total - _square(m)
                if train[0, 0] < 0.5:
                    continue
                valid = [part - _square(m) if k == mine else part for k, part in parts.items()]
                errors = inner_errors([(train - v, v) for v in valid], specs, noise)
                out += [(name, *fitted) for fitted in chosen_fits(train, errors, specs, noise, centre)]
            yield pd.DataFrame(out, columns=[unit, *(c.split()[0] for c in FIT.split(", "))])

    return own.select(unit, "_inner", "m").mapInPandas(fit, f"`{unit}` {dict(df.dtypes)[unit]}, {FIT}")


def future_unseen_fits(
    df: DataFrame, features: Sequence[str], target: str, unit: str = "spatial_unit", year: str = "year", specs: Sequence[tuple[str, Sequence[float]]] = SPECS,
    minimum_years: int = 3,
) -> DataFrame:
    """(unit, year, model, ...) as above: one fit per tested year and unit on earlier years of the
    other units. The first ``minimum_years`` years are only trained on.

    Inner folds roll over the earlier years: a year validates what the years before it give, both
    without the unit. Their errors are computed once per unit and year and serve all later folds.
    The driver holds one matrix per year, a task the years of one unit.
    """
    rows = df.where(F.col(unit).isNotNull() & F.col(year).isNotNull() & present(target).isNotNull())
    centre = _centre(rows, features)
    own = settled(moments(rows, features, target, [unit, year], centre))
    by_year = sorted((r[year], _square(r["m"])) for r in _sums(own, year).select(year, "m").collect())
    years = [y for y, _ in by_year]
    whole = [m for _, m in by_year]
    noise = _noise(sum(whole)) if whole else np.zeros(len(features))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = {y: _square(m) for y, m in zip(pdf[year], pdf["m"])}
        before = np.zeros_like(whole[0])
        pairs, errors, out = [], np.zeros((0, sum(len(params) for _, params in specs))), []
        for position, (y, m) in enumerate(zip(years, whole)):
            others = m - mine[y] if y in mine else m
            if position >= minimum_years and y in mine and before[0, 0] > 0.5:
                errors = np.vstack([errors, inner_errors(pairs[len(errors) :], specs, noise)])
                out += [(pdf[unit].iloc[0], y, *fitted) for fitted in chosen_fits(before, errors, specs, noise, centre)]
            pairs.append((before.copy(), others))
            before = before + others
        return pd.DataFrame(out, columns=[unit, year, *(c.split()[0] for c in FIT.split(", "))])

    types = dict(df.dtypes)
    return own.select(unit, year, "m").groupBy(unit).applyInPandas(fit, f"`{unit}` {types[unit]}, `{year}` {types[year]}, {FIT}")


def _sums(own: DataFrame, by: str) -> DataFrame:
    """Matrices added up per value of ``by``, with partial sums in the tasks."""
    return own.groupBy(by).agg(Summarizer.sum(array_to_vector("m")).alias("_v")).select(by, vector_to_array("_v").alias("m"))


def predict_held_out(df: DataFrame, fits: DataFrame, features: Sequence[str], on: Sequence[str] = ("spatial_unit",), out: str = "predicted_yield") -> DataFrame:
    """Rows once per model kind with the prediction of the fit that left them out; rows whose
    fold has no fit are left out. Catalyst broadcasts the fits if they are small; a unit with very many
    rows is split by the skew join."""
    joined = null_safe_join(df, fits.select(*on, "model", "param", "intercept", "coef", "fill"), list(on), "inner")
    value = F.col("intercept")
    for i, c in enumerate(features, 1):
        value = value + F.element_at("coef", i) * F.coalesce(present(c), F.element_at("fill", i))
    return joined.withColumn(out, value).drop("intercept", "coef", "fill")
