"""Linear models from Gram matrices.

One aggregate per group gives M = sum(w * z z') with z = (1, x1..xp, y). Every
linear fit, every penalty, every fold complement and every error of a fit on
another group follows from such matrices, so one pass over the rows serves all
folds and all parameters. The matrices are rows of a small table; solving them
is a pandas step over that table, one p x p problem at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checks import complete_rows

GROUPS_IN_TASK = 256


def gram(df: DataFrame, features: Sequence[str], target: str, groups: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Per group: ``n`` (sum of weights) and ``m``, the flattened (p+2) x (p+2)
    matrix over (1, features, target). Rows with a missing value are left out.
    Without groups there is always one row; if no row is left, both are null."""
    cols = [*features, target]
    rows = complete_rows(df, cols).withColumn("_w", weight if weight is not None else F.lit(1.0))
    return blocked_gram(rows, cols, list(groups))


def blocked_gram(rows: DataFrame, cols: list[str], groups: list[str]) -> DataFrame:
    """Matrix products per Arrow batch inside each task, then a vector sum."""
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*[f"`{g}` {fields[g]}" for g in groups], "m array<double>"])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(*k, v.ravel().tolist()) for k, v in held.items()], columns=[*groups, "m"])
            held.clear()
            return out

        for pdf in batches:
            parts = pdf.groupby(groups, dropna=False, sort=False) if groups else [((), pdf)]
            for key, part in parts:
                key = key if isinstance(key, tuple) else (key,)
                z = np.column_stack([np.ones(len(part)), part[cols].to_numpy(float)])
                m = z.T @ (z * part["_w"].to_numpy(float)[:, None])
                held[key] = held[key] + m if key in held else m
            if len(held) > GROUPS_IN_TASK:
                yield flush()
        if held:
            yield flush()

    partial = rows.select(*groups, *[F.col(c).cast("double").alias(c) for c in cols], "_w").mapInPandas(products, schema)
    # grouped in any case: over no rows at all Summarizer fails
    summed = partial.groupBy(*(groups or [F.lit(True)])).agg(Summarizer.sum(array_to_vector("m")).alias("v"))
    out = summed.select(*groups, vector_to_array("v").alias("m"))
    out = out if groups else out.agg(F.first("m").alias("m"))
    return out.select(*groups, F.element_at("m", 1).alias("n"), "m")


def sum_grams(grams: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Element-wise sum of matrices; the table has one small row per fold."""
    cells = grams.select(*groups, F.posexplode("m").alias("pos", "v")).groupBy(*groups, "pos").agg(F.sum("v").alias("v"))
    packed = cells.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("c"))
    m = F.transform("c", lambda x: x["v"])
    return packed.select(*groups, F.element_at(m, 1).alias("n"), m.alias("m"))


def complement_grams(grams: DataFrame, fold: str = "fold", groups: Sequence[str] = ()) -> DataFrame:
    """Training matrix of each fold: the total of its group minus its own."""
    total = sum_grams(grams, groups).withColumnRenamed("m", "_t").drop("n")
    joined = grams.join(total, list(groups), "inner") if groups else grams.join(F.broadcast(total), F.lit(True), "inner")
    rest = F.zip_with("_t", "m", lambda t, m: t - m)
    return joined.select(*groups, fold, (F.element_at("_t", 1) - F.col("n")).alias("n"), rest.alias("m"))


def earlier_grams(grams: DataFrame, year: str = "year", first_test: int | None = None) -> DataFrame:
    """Training matrix of each test year: the running sum over strictly earlier years.
    A cell of the matrix has one row per year, so a window is as long as there are years."""
    cells = grams.select(year, F.posexplode("m").alias("pos", "v")).groupBy(year, "pos").agg(F.sum("v").alias("v"))
    before = Window.partitionBy("pos").orderBy(year).rowsBetween(Window.unboundedPreceding, -1)
    running = cells.withColumn("v", F.sum("v").over(before)).filter("v is not null")
    if first_test is not None:
        running = running.filter(F.col(year) >= first_test)
    packed = running.groupBy(year).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("c"))
    m = F.transform("c", lambda x: x["v"])
    return packed.select(year, F.element_at(m, 1).alias("n"), m.alias("m"))


# --- small dense algebra on one matrix -------------------------------------------


def square(m: Sequence[float] | None) -> np.ndarray:
    """The matrix that ``m`` is the flattened form of."""
    if m is None:
        raise ValueError("no row has all values, so there is no matrix")
    q = int(round(len(m) ** 0.5))
    return np.asarray(m, float).reshape(q, q)


def unpack(m: Sequence[float]) -> tuple[float, np.ndarray, float, np.ndarray, np.ndarray, float]:
    """n, feature means, target mean, centred X'X, centred X'y, centred y'y."""
    a = square(m)
    n = a[0, 0]
    mean = a[0, 1:] / n
    centred = a[1:, 1:] - n * np.outer(mean, mean)
    return n, mean[:-1], mean[-1], centred[:-1, :-1], centred[:-1, -1], centred[-1, -1]


def scales(xx: np.ndarray, n: float) -> np.ndarray:
    """Population standard deviations; a constant column scales by 1."""
    var = np.clip(np.diag(xx) / n, 0.0, None)
    tiny = var <= 1e-14 * max(1.0, float(np.max(np.abs(xx), initial=0.0)) / n)
    return np.where(tiny, 1.0, np.sqrt(np.where(tiny, 1.0, var)))


def eigen(xx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and vectors as columns, largest entry positive."""
    values, vectors = np.linalg.eigh(xx)
    order = np.argsort(values)[::-1]
    values, vectors = np.clip(values[order], 0.0, None), vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * np.where(signs == 0, 1.0, signs)


def components_for_share(values: np.ndarray, share: float) -> int:
    """Smallest k whose cumulative share exceeds ``share``."""
    total = values.sum()
    if total <= 0:
        return 1
    return int(min(len(values), np.searchsorted(np.cumsum(values) / total, share, side="right") + 1))


def pls_coefficients(xx: np.ndarray, xy: np.ndarray, k: int) -> np.ndarray:
    """PLS1 from cross-products: deflation needs only X'X and X'y."""
    p = len(xy)
    c, g = xy.copy(), xx.copy()
    weights, loadings, q = [], [], []
    for _ in range(min(k, p)):
        norm = np.linalg.norm(c)
        if norm < 1e-12:
            break
        w = c / norm
        t2 = w @ g @ w
        if t2 < 1e-12:
            break
        load = g @ w / t2
        qq = (c @ w) / t2
        weights.append(w)
        loadings.append(load)
        q.append(qq)
        g = g - t2 * np.outer(load, load)
        c = c - t2 * qq * load
    if not weights:
        return np.zeros(p)
    w, load = np.array(weights).T, np.array(loadings).T
    return w @ np.linalg.solve(load.T @ w, np.array(q))


def solve(kind: str, xx: np.ndarray, xy: np.ndarray, n: float, param: float) -> np.ndarray:
    """Coefficients on centred columns. ``param`` is the ridge penalty, the share of
    variance (below 1) or component count for pcr, or the component count for pls."""
    if kind == "dummy_mean":
        return np.zeros(len(xy))
    if kind == "ols":
        return np.linalg.lstsq(xx, xy, rcond=1e-10)[0]
    if kind == "ridge":
        return np.linalg.solve(xx + param * np.eye(len(xy)), xy)
    if kind == "pls":
        return pls_coefficients(xx, xy, int(param))
    if kind == "pcr":
        values, vectors = eigen(xx)
        k = components_for_share(values, param) if param < 1 else int(param)
        k = max(1, min(k, int((values > 1e-10 * max(values[0], 1e-300)).sum())))
        v = vectors[:, :k]
        return v @ ((v.T @ xy) / values[:k])
    raise ValueError(f"unknown model kind {kind}")


def fit_matrix(m: Sequence[float], kind: str, param: float = 0.0, standardise: bool = True) -> np.ndarray:
    """(intercept, coefficients) in original units."""
    n, mean, y_mean, xx, xy, _ = unpack(m)
    s = scales(xx, n) if standardise else np.ones(len(mean))
    b = solve(kind, xx / np.outer(s, s), xy / s, n, param) / s
    return np.concatenate([[y_mean - mean @ b], b])


def squared_error(m: Sequence[float], coef: np.ndarray) -> float:
    """Sum of squared errors of given coefficients on the rows behind a matrix."""
    q = len(coef) + 1
    a = np.asarray(m, float).reshape(q, q)
    v = np.concatenate([coef, [-1.0]])
    return float(max(v @ a @ v, 0.0))


def fit_table(
    grams: DataFrame, features: Sequence[str], specs: Sequence[tuple[str, float]], groups: Sequence[str] = (), standardise: bool = True
) -> DataFrame:
    """Long coefficient table: groups, model, param, term, position, coefficient.
    A matrix that is null, for want of rows, gives null coefficients."""
    terms = ["intercept", *features]
    fields = dict(grams.dtypes)
    schema = ", ".join([*[f"`{g}` {fields[g]}" for g in groups], "model string, param double, term string, position int, coefficient double, n double"])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                for kind, param in specs:
                    coef = fit_matrix(rec["m"], kind, param, standardise) if rec["m"] is not None else np.full(len(terms), np.nan)
                    rows += [(*[rec[g] for g in groups], kind, float(param), t, i, float(c), float(rec["n"])) for i, (t, c) in enumerate(zip(terms, coef))]
            yield pd.DataFrame(rows, columns=[*groups, "model", "param", "term", "position", "coefficient", "n"])

    return grams.mapInPandas(fit, schema)


def coefficient_vectors(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per fit with its coefficients as an array, intercept first."""
    packed = table.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", "coefficient"))).alias("c"))
    return packed.select(*keys, F.transform("c", lambda x: x["coefficient"]).alias("coef"))


def linear_prediction(features: Sequence[str], coef: str = "coef") -> Column:
    """Intercept plus dot product as one column expression."""
    c = F.col(coef)
    out = F.element_at(c, 1)
    for i, name in enumerate(features, 2):
        out = out + F.element_at(c, i) * F.col(name)
    return out


def score(rows: DataFrame, table: DataFrame, features: Sequence[str], on: Sequence[str] = ("fold",), out: str = "predicted_yield") -> DataFrame:
    """Predictions of every fit for the rows of its fold. The coefficient table has
    one row per fold, model and parameter, which bounds the broadcast."""
    fits = coefficient_vectors(table, [*on, "model", "param"])
    joined = rows.join(F.broadcast(fits), list(on), "inner") if on else rows.join(F.broadcast(fits), F.lit(True), "inner")
    return joined.withColumn(out, linear_prediction(features)).drop("coef")


def leave_one_row_out(df: DataFrame, features: Sequence[str], target: str, alpha: float = 0.0) -> DataFrame:
    """Leave-one-out prediction of a linear model for every row in closed form:
    y - e / (1 - h), with the leverage h from the inverse Gram matrix.

    The matrix is one row; its inverse and the coefficients become literals of a
    column expression, so scoring is a projection of the rows.
    """
    a = square(gram(df, features, target).first()["m"])
    q = len(a)
    penalty = np.diag([0.0, *[alpha] * (q - 2)])
    inverse = np.linalg.pinv(a[:-1, :-1] + penalty)
    coef = inverse @ a[:-1, -1]
    z = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    fitted = sum((F.lit(float(c)) * x for c, x in zip(coef, z)), F.lit(0.0))
    leverage = sum(
        (F.lit(float(inverse[i, j] * (1 if i == j else 2))) * z[i] * z[j] for i in range(q - 1) for j in range(i, q - 1)), F.lit(0.0)
    )
    error = F.col(target) - fitted
    return df.dropna(subset=[*features, target]).withColumn("loo_prediction", F.col(target) - error / (1 - leverage))


def standardised_coefficients(grams: DataFrame, features: Sequence[str], kind: str = "ridge", param: float = 1.0) -> DataFrame:
    """Coefficients per standard deviation of the feature, largest first by size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for m in pdf["m"]:
                n, _, _, xx, xy, _ = unpack(m)
                s = scales(xx, n)
                b = solve(kind, xx / np.outer(s, s), xy / s, n, param)
                yield pd.DataFrame({"feature": list(features), "coefficient": b})

    return grams.select("m").mapInPandas(run, "feature string, coefficient double").orderBy(F.abs("coefficient").desc())


def component_sweep(grams: DataFrame, features: Sequence[str], counts: Sequence[int] = (2, 3, 4, 5, 6, 8, 10), groups: Sequence[str] = ()) -> DataFrame:
    """Principal-component regressions on the first k components for each k."""
    usable = [k for k in counts if k <= len(features)]
    return fit_table(grams, features, [("pcr", float(k)) for k in usable], groups)


def gram_errors(tests: DataFrame, table: DataFrame, on: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Squared error of every fit on its test matrix, without a pass over rows."""
    fits = coefficient_vectors(table, [*on, "model", "param"])
    joined = tests.join(fits, list(on), "inner")
    fields = dict(joined.dtypes)
    keys = [*groups, *[c for c in on if c not in groups], "model", "param"]
    schema = ", ".join([*[f"`{k}` {fields[k]}" for k in keys], "rows double, sse double"])

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["sse"] = [squared_error(m, np.asarray(c)) for m, c in zip(pdf["m"], pdf["coef"])]
            yield pdf.rename(columns={"n": "rows"})[[*keys, "rows", "sse"]]

    return joined.mapInPandas(errors, schema)


def grid_search(inner_grams: DataFrame, features: Sequence[str], specs: Sequence[tuple[str, float]], outer: str = "fold", inner: str = "inner") -> DataFrame:
    """Mean inner-fold RMSE of every (model, param) per outer fold, best first flag.

    ``inner_grams`` has one matrix per (outer, inner); the training matrix of an
    inner fold is the complement inside its outer fold.
    """
    train = complement_grams(inner_grams, inner, [outer])
    fits = fit_table(train, features, specs, [outer, inner])
    errors = gram_errors(inner_grams, fits, [outer, inner])
    scores = errors.groupBy(outer, "model", "param").agg(F.avg(F.sqrt(F.col("sse") / F.col("rows"))).alias("inner_rmse"))
    best = scores.groupBy(outer, "model").agg(F.min_by("param", F.struct("inner_rmse", "param")).alias("_best"))
    return scores.join(best, [outer, "model"], "inner").withColumn("is_best", F.col("param") == F.col("_best")).drop("_best")


def weighted_fit_metrics(
    train: DataFrame, test: DataFrame, features: Sequence[str], target: str, cv: str, kind: str = "ols", param: float = 0.0, least: float = 1e-6
) -> DataFrame:
    """(rmse, r2, n_test, uncertainty_weight_column) on ``test`` of a fit that weighs each training
    row by 1 / cv^2. A missing cv counts as the training median, one below ``least`` as ``least``."""
    from .ranks import group_quantiles

    known = train.withColumn("_cv", F.col(cv).cast("double"))
    middle = group_quantiles(known, "_cv", {"_median": 0.5}).select("_median")
    # one row
    weighed = known.join(F.broadcast(middle), F.lit(True), "left")
    weight = 1 / F.pow(F.greatest(F.coalesce("_cv", "_median"), F.lit(least)), 2)
    coef = [float(c) for c in fit_matrix(gram(weighed, features, target, weight=weight).first()["m"], kind, param)]
    predicted = sum((F.lit(c) * F.col(f) for c, f in zip(coef[1:], features)), F.lit(coef[0]))
    error = F.pow(F.col(target) - predicted, 2)
    rows = test.dropna(subset=[*features, target])
    return rows.agg(
        F.sqrt(F.avg(error)).alias("rmse"),
        (1 - F.sum(error) / F.nullif(F.count(F.lit(1)) * F.var_pop(target), F.lit(0.0))).alias("r2"),
        F.count(F.lit(1)).alias("n_test"), F.lit(cv).alias("uncertainty_weight_column"))
