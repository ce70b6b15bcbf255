"""Sensitivity tables, collinearity, outliers, permutation and partial dependence."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .agg import missingness
from .calendar import season_days
from .components import feature_gram
from .linear import scales, unpack
from .prep import unpivot_values
from .ranks import first_per_key, hash_rank, order_statistics


def season_window_sensitivity(daily: DataFrame, calendars: DataFrame, rain: str = "rain_mm") -> DataFrame:
    """Windows and mean seasonal total per calendar shift, all shifts in one join."""
    days = season_days(daily, calendars)
    totals = days.groupBy("spatial_unit", "year", "season", "shift_days").agg(F.sum(F.coalesce(rain, F.lit(0.0))).alias("total"))
    return totals.groupBy("shift_days").agg(F.count(F.lit(1)).alias("windows"), F.avg("total").alias("mean_rain_total_mm"))


def environment_rows(panel: DataFrame, order: str = "crop") -> DataFrame:
    """One row per unit, year and season, so that each environment weighs the same."""
    return first_per_key(panel, K.ENVIRONMENT_KEY, [F.col(order)])


def uncertainty_retention(df: DataFrame, cv: str = "cv_production_pct", maximum: float = 30.0, groups: Sequence[str] = ()) -> DataFrame:
    """Rows kept and dropped by the uncertainty filter."""
    kept = F.count_if(F.col(cv) <= maximum)
    n = F.count(F.lit(1))
    return df.groupBy(*groups).agg(
        n.alias("total_rows"), kept.alias("kept"), (n - kept).alias("dropped"), (1 - kept / n).alias("dropped_fraction")
    )


# --- collinearity, outliers, permutation, partial dependence -------------------


def variance_inflation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, vif) from one Gram matrix over complete rows. Fewer than two columns
    give no rows; too few rows give NULLs; exact collinearity is capped."""
    cols = list(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for m in pdf["m"]:
                n, _, _, xx, _, _ = unpack(m)
                if len(cols) < 2:
                    continue
                rows = []
                for i, name in enumerate(cols):
                    rest = [j for j in range(len(cols)) if j != i]
                    explained = xx[rest, i] @ np.linalg.pinv(xx[np.ix_(rest, rest)], rcond=1e-12) @ xx[rest, i]
                    unexplained = 1.0 - explained / xx[i, i] if xx[i, i] > 0 else 1.0
                    vif = 1.0 / max(unexplained, np.finfo(float).eps) if n > len(cols) else None
                    rows.append((name, vif))
                yield pd.DataFrame(rows, columns=["feature", "vif"])

    return feature_gram(df, cols).select("m").mapInPandas(run, "feature string, vif double")


def gamma_cdf(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function by its power series."""
    if x <= 0:
        return 0.0
    term = total = 1.0 / a
    k = 0
    while term > total * 1e-16 and k < 10_000:
        k += 1
        term *= x / (a + k)
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def chi_square_quantile(q: float, df: int) -> float:
    low, high = 0.0, max(10.0, 4.0 * df + 100.0)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_cdf(df / 2, mid / 2) < q else (low, mid)
    return (low + high) / 2


def mahalanobis_column(columns: Sequence[str], location: np.ndarray, covariance: np.ndarray) -> Column:
    """Squared distance as a column expression with literal location and precision."""
    precision = np.linalg.pinv(covariance)
    diff = [F.col(c) - float(v) for c, v in zip(columns, location)]
    terms = [
        F.lit(float(precision[i, j] * (1 if i == j else 2))) * diff[i] * diff[j] for i in range(len(diff)) for j in range(i, len(diff))
    ]
    return F.greatest(sum(terms, F.lit(0.0)), F.lit(0.0))


def location_scatter(rows: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    n, mean, _, xx, _, _ = unpack(feature_gram(rows, columns).first()["m"])
    return mean, xx / n


def _closest(z: np.ndarray, location: np.ndarray, covariance: np.ndarray, h: int) -> np.ndarray:
    diff = z - location
    d2 = np.einsum("ij,jk,ik->i", diff, np.linalg.pinv(covariance), diff)
    return z[np.argsort(d2, kind="stable")[:h]]


def _moments(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return z.mean(axis=0), np.atleast_2d(np.cov(z.T, bias=True))


def subsample_starts(z: np.ndarray, share: float, starts: int, best: int, seed: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(determinant, location, scatter) of the ``best`` random starts on one subsample, after two
    concentration steps each, the best run on until the determinant stops falling. A start is p + 1
    random rows, and more while their scatter is singular."""
    n, p = z.shape
    h = max(min(n, p + 1), int(np.ceil(n * share)))
    rng = np.random.default_rng(seed)
    found: dict[tuple, tuple] = {}
    for _ in range(starts):
        order = rng.permutation(n)
        k = min(n, p + 1)
        location, covariance = _moments(z[order[:k]])
        while np.linalg.det(covariance) <= 1e-12 and k < n:
            k += 1
            location, covariance = _moments(z[order[:k]])
        for _ in range(2):
            location, covariance = _moments(_closest(z, location, covariance, h))
        found.setdefault(tuple(np.round(location, 9)), (float(np.linalg.det(covariance)), location, covariance))
    out = []
    for now, location, covariance in sorted(found.values(), key=lambda c: c[0])[:best]:
        for _ in range(100):
            next_location, next_covariance = _moments(_closest(z, location, covariance, h))
            after = float(np.linalg.det(next_covariance))
            if not after < now:
                break
            now, location, covariance = after, next_location, next_covariance
        out.append((now, location, covariance))
    return out


def candidate_starts(
    scaled: DataFrame, names: Sequence[str], n: int, h: int, key: Sequence[str], subsamples: int = 5, size: int = 300, starts: int = 100, best: int = 2, seed: int = 42,
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Locations and scatters to start from: ``best`` of each of ``subsamples`` disjoint subsamples.

    The subsamples are the subsamples x size rows with the smallest hash of ``key``, dealt by that hash,
    so they are a bounded sample and a retry gives the same; they are fewer where n rows don't fill them. Each is searched in its own task; the driver gets
    subsamples x best small matrices. Only starts come from the sample: all later steps read all rows.
    """
    p = len(names)
    subsamples = max(1, min(subsamples, n // size))
    digest = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in key]).alias("_hash")
    sample = scaled.select(*names, digest).orderBy("_hash", *names).limit(subsamples * size)
    sample = sample.withColumn("_part", F.pmod("_hash", F.lit(subsamples)))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        z = pdf.sort_values(["_hash", *names])[list(names)].to_numpy(float)
        rows = []
        if len(z) > p + 1:
            rows = [(d, m.tolist(), c.ravel().tolist()) for d, m, c in subsample_starts(z, h / n, starts, best, seed + int(pdf["_part"].iloc[0]))]
        return pd.DataFrame(rows, columns=["d", "m", "c"])

    found = sample.groupBy("_part").applyInPandas(search, "d double, m array<double>, c array<double>").collect()
    return [(np.array(r["m"]), np.array(r["c"]).reshape(p, p)) for r in sorted(found, key=lambda r: (r["d"], r["m"]))]


def concentrate(scaled: DataFrame, names: Sequence[str], candidates: Sequence[tuple[np.ndarray, np.ndarray]], h: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """One concentration step of all candidates over all rows: the h-th smallest distance of each
    (one job of order statistics), then location and scatter of the rows within it (one pass that
    leaves a matrix per candidate and task)."""
    d2 = [f"_d{k}" for k in range(len(candidates))]
    distance = scaled.select(*names, *[mahalanobis_column(names, m, c).alias(d) for d, (m, c) in zip(d2, candidates)])
    cuts = order_statistics(unpivot_values(distance, d2, []), "value", ["feature"]).at({"cut": F.lit(h)})
    cut = {r["feature"]: float(r["cut"]) for r in cuts.collect()}
    inside = distance.select(*names, F.array(*[F.col(d) <= F.lit(cut[d]) for d in d2]).alias("_in"))
    q = len(names) + 1

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(candidates), q, q))
        for pdf in batches:
            if len(pdf):
                z = np.column_stack([np.ones(len(pdf)), pdf[list(names)].to_numpy(float)])
                kept = np.stack(pdf["_in"].to_numpy()).astype(float)
                for k in range(len(candidates)):
                    total[k] += z.T @ (z * kept[:, k, None])
        yield pd.DataFrame({"k": range(len(candidates)), "m": [t.ravel().tolist() for t in total]})

    summed = inside.mapInPandas(products, "k int, m array<double>").groupBy("k").agg(Summarizer.sum(array_to_vector("m")).alias("v"))
    out = []
    for r in sorted(summed.select("k", vector_to_array("v").alias("m")).collect(), key=lambda r: r["k"]):
        m = np.array(r["m"]).reshape(q, q)
        mean = m[0, 1:] / m[0, 0]
        out.append((mean, m[1:, 1:] / m[0, 0] - np.outer(mean, mean)))
    return out


def minimum_determinant(
    scaled: DataFrame, names: Sequence[str], h: int, candidates: Sequence[tuple[np.ndarray, np.ndarray]], steps: int = 30, finalists: int = 2,
) -> tuple[np.ndarray, np.ndarray]:
    """Location and scatter of least determinant: two steps of all candidates, then the
    ``finalists`` until no determinant falls."""
    now = [(np.inf, c) for c in candidates]
    for step in range(steps):
        after = [(float(np.linalg.det(c[1])), c) for c in concentrate(scaled, names, [c for _, c in now], h)]
        moved = any(a < b * (1 - 1e-9) for (a, _), (b, _) in zip(after, now))
        now = [a if a[0] <= b[0] else b for a, b in zip(after, now)]
        if step == 1:
            now = sorted(now, key=lambda c: c[0])[:finalists]
        if not moved:
            break
    return min(now, key=lambda c: c[0])[1]


def robust_outliers(df: DataFrame, columns: Sequence[str], significance: float = 0.01, steps: int = 30, seed: int = 42) -> DataFrame:
    """Complete rows with robust squared Mahalanobis distance, threshold and flag.

    Minimum covariance determinant: random starts on disjoint hashed subsamples, searched inside
    tasks, and medians with median absolute deviations are the candidates; concentration steps
    over all rows keep the h rows closest to each and refit location and scatter until the
    determinant stops falling. The raw scatter is scaled to be consistent, then refitted on rows
    inside the 97.5 % bound. The driver holds a few p x p matrices.
    """
    cols, p = list(columns), len(columns)
    rows = df.dropna(subset=cols)
    n, mean, _, xx, _, _ = unpack(feature_gram(rows, cols).first()["m"])
    if n <= p:
        raise ValueError("too few observations for multivariate outlier analysis")
    s = scales(xx, n)
    names = [f"_z{i}" for i in range(p)]
    scaled = rows.withColumns({z: (F.col(c) - float(mu)) / float(sd) for z, c, mu, sd in zip(names, cols, mean, s)})
    h = int((n + p + 1) // 2)

    long = unpivot_values(scaled, names, [])
    medians = order_statistics(long, "value", ["feature"]).quantiles({"median": 0.5})
    centre = {r["feature"]: r["median"] for r in medians.collect()}
    location = np.array([centre[z] for z in names])
    spread = scaled.withColumns({z: F.abs(F.col(z) - float(centre[z])) for z in names})
    mad = order_statistics(unpivot_values(spread, names, []), "value", ["feature"]).quantiles({"median": 0.5})
    width = {r["feature"]: max(r["median"], 1e-6) for r in mad.collect()}
    plain = (location, np.diag([width[z] ** 2 for z in names]))
    hashable = [c for c, kind in df.dtypes if not kind.startswith("map")]
    candidates = [plain, *candidate_starts(scaled, names, int(n), h, hashable, seed=seed)]
    location, covariance = minimum_determinant(scaled, names, h, candidates, steps)

    distance = scaled.withColumn("_d2", mahalanobis_column(names, location, covariance))
    middle = order_statistics(distance, "_d2").quantiles({"m": 0.5}).first()["m"]
    consistent = covariance * (middle / chi_square_quantile(0.5, p))
    bound = chi_square_quantile(0.975, p)
    inner = scaled.withColumn("_d2", mahalanobis_column(names, location, consistent)).filter(F.col("_d2") < bound)
    location, covariance = location_scatter(inner, names)
    threshold = chi_square_quantile(1 - significance, p)
    d2 = mahalanobis_column(names, location, covariance)
    return scaled.withColumns(
        {"mahalanobis_distance_squared": d2, "mahalanobis_threshold": F.lit(threshold), "is_multivariate_outlier": d2 > threshold}
    ).drop(*names)


def permutation_importance(
    rows: DataFrame,
    features: Sequence[str],
    predict: Callable[[DataFrame], DataFrame],
    key: Sequence[str],
    target: str = "yield_tons_ha",
    groups: Sequence[str] = ("fold",),
    repeats: int = 5,
    seed: int = 42,
    prediction: str = "prediction",
) -> DataFrame:
    """(groups, feature, importance_mean, importance_std): rise of the RMSE of held-out
    rows when one feature is shuffled.

    A shuffle pairs two seeded hash ranks of the rows of a group, so it is an
    equi-join on rank. Each row then appears once per feature with that feature
    exchanged, and the fitted model scores all of them in one pass.
    """
    keys, cols = list(groups), list(features)
    base = rows.select(*dict.fromkeys([*keys, *key, *cols, target]))
    copies = base.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    to = hash_rank(copies, key, [*keys, "repeat"], F.col("repeat") + seed, "_to")
    source = hash_rank(copies, key, [*keys, "repeat"], F.col("repeat") + seed + 7919, "_to")
    source = source.select(*keys, "repeat", "_to", *[F.col(c).alias(f"_p_{c}") for c in cols])
    paired = to.join(source, [*keys, "repeat", "_to"], "inner")
    variants = paired.withColumn("feature", F.explode(F.array(*[F.lit(c) for c in cols])))
    swapped = variants.withColumns({c: F.when(F.col("feature") == c, F.col(f"_p_{c}")).otherwise(F.col(c)) for c in cols})
    rmse = F.sqrt(F.avg(F.pow(F.col(target) - F.col(prediction), 2)))
    shuffled = predict(swapped.drop(*[f"_p_{c}" for c in cols], "_to")).groupBy(*keys, "feature", "repeat").agg(rmse.alias("_after"))
    before = predict(base).groupBy(*keys).agg(rmse.alias("_before"))
    joined = shuffled.join(F.broadcast(before), keys, "inner") if keys else shuffled.join(F.broadcast(before), F.lit(True), "inner")
    rise = F.col("_after") - F.col("_before")
    return joined.groupBy(*keys, "feature").agg(F.avg(rise).alias("importance_mean"), F.stddev_pop(rise).alias("importance_std"))


def partial_dependence(
    rows: DataFrame, feature: str, predict: Callable[[DataFrame], DataFrame], points: int = 20, prediction: str = "prediction"
) -> DataFrame:
    """(feature, grid, mean_prediction): even grid between the 5 % and 95 % quantiles."""
    ends = order_statistics(rows, feature).quantiles({"lo": 0.05, "hi": 0.95}).first()
    grid = np.linspace(ends["lo"], ends["hi"], points)
    spread = rows.withColumn(feature, F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    return predict(spread).groupBy(F.col(feature).alias("grid")).agg(F.avg(prediction).alias("mean_prediction")).withColumn("feature", F.lit(feature))


def complete_case_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each candidate column with its missing count and whether it is complete."""
    return missingness(df, columns).select("column", "missing_count", (F.col("missing_count") == 0).alias("complete"))
