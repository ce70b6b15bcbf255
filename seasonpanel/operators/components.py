"""Principal components from cross-products: eigenvalues, loadings, resampling.

The data are read once per analysis. Resampled matrices are built beside the
data: each task turns its Arrow batches into one weighted matrix per iteration
(a single matrix product) and only those matrices are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checks import complete_rows
from ..session import settled
from .linear import components_for_share, eigen, gram, scales, unpack
from .series import cumulative_share

BLOCK_ROWS = 4096
#: Numbers of an array that a task holds while it weighs rows: bounds it whatever an Arrow batch holds.
CELLS = 1 << 21


def feature_gram(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Gram matrix of features alone (a constant target keeps one layout)."""
    return gram(df.withColumn("_zero", F.lit(0.0)), columns, "_zero", groups)


def component_matrix(m: Sequence[float], correlation: bool = True) -> tuple[float, np.ndarray]:
    """n and the matrix whose eigenvalues are S^2 / (n - 1) of the scaled data."""
    n, _, _, xx, _, _ = unpack(m)
    s = scales(xx, n) if correlation else np.ones(len(xx))
    return n, xx / np.outer(s, s) / (n - 1)


def eigenvalues(df: DataFrame, columns: Sequence[str], correlation: bool = True) -> DataFrame:
    """(component, eigenvalue, share, cumulative_share)."""
    return cumulative_share(_spectrum(feature_gram(df, columns), columns, correlation).select("component", "eigenvalue").distinct(), "eigenvalue", "component")


def _spectrum(grams: DataFrame, columns: Sequence[str], correlation: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for m in pdf["m"]:
                values, vectors = eigen(component_matrix(m, correlation)[1])
                yield pd.DataFrame(
                    [(k + 1, float(values[k]), c, float(vectors[j, k])) for k in range(len(values)) for j, c in enumerate(columns)],
                    columns=["component", "eigenvalue", "feature", "weight"],
                )

    return grams.select("m").mapInPandas(run, "component int, eigenvalue double, feature string, weight double")


def loadings(df: DataFrame, columns: Sequence[str], correlation: bool = True) -> DataFrame:
    """(component, feature, loading, contribution_pct): loading = weight * sqrt(eigenvalue);
    contributions of a component sum to 100."""
    table = _spectrum(feature_gram(df, columns), columns, correlation)
    return table.select(
        "component",
        "feature",
        "eigenvalue",
        (F.col("weight") * F.sqrt("eigenvalue")).alias("loading"),
        (100 * F.col("weight") * F.col("weight")).alias("contribution_pct"),
    )


def retention(spectrum: DataFrame, parallel: DataFrame | None = None, share: float = 0.85) -> DataFrame:
    """Components kept by the cumulative share, by eigenvalue above 1 and, when a
    parallel analysis is given, by its threshold."""
    rows = spectrum if parallel is None else spectrum.join(parallel.select("component", "threshold"), "component", "left")
    by_share = F.count_if(F.col("cumulative_share") < share) + 1
    out = [
        F.least(by_share, F.count(F.lit(1))).alias("by_share"),
        F.count_if(F.col("eigenvalue") > 1).alias("by_kaiser"),
    ]
    if parallel is not None:
        out.append(F.greatest(F.count_if(F.col("eigenvalue") > F.col("threshold")), F.lit(1)).alias("by_parallel"))
    return rows.agg(*out)


def mix(key: np.ndarray, stream: np.ndarray) -> np.ndarray:
    """Uniform numbers in [0, 1) from row hashes and stream numbers (splitmix64)."""
    with np.errstate(over="ignore"):
        z = key.astype(np.uint64)[:, None] + (stream.astype(np.uint64)[None, :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(float) / float(1 << 53)


def poisson_counts(uniform: np.ndarray) -> np.ndarray:
    from .metrics import POISSON_ONE

    return np.searchsorted(np.asarray(POISSON_ONE), uniform, side="right").astype(float)


def _sum_iterations(partial: DataFrame) -> DataFrame:
    summed = partial.groupBy("iter").agg(Summarizer.sum(array_to_vector("m")).alias("v"))
    out = summed.select("iter", vector_to_array("v").alias("m"))
    return out.withColumn("n", F.element_at("m", 1))


def bootstrap_grams(df: DataFrame, columns: Sequence[str], key: Sequence[str], iterations: int = 500, seed: int = 42) -> DataFrame:
    """(iter, n, m): matrices over (1, columns) of bootstrap samples. Each row enters
    an iteration a Poisson(1) number of times, drawn from a hash of its key, so a
    retried task draws the same sample."""
    cols, streams = list(columns), np.arange(iterations)
    step = max(1, CELLS // max((len(cols) + 1) ** 2, iterations))
    rows = complete_rows(df, cols).select(F.xxhash64(F.lit(seed), *key).alias("_k"), *[F.col(c).cast("double").alias(c) for c in cols])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            x, keys = pdf[cols].to_numpy(float), pdf["_k"].to_numpy()
            for at in range(0, len(x), step):
                z = np.column_stack([np.ones(len(x[at : at + step])), x[at : at + step]])
                outer = (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)
                m = poisson_counts(mix(keys[at : at + step], streams)).T @ outer
                total = m if total is None else np.add(total, m, out=total)
        if total is not None:
            yield pd.DataFrame({"iter": streams + 1, "m": list(total)})

    return _sum_iterations(rows.mapInPandas(run, "iter int, m array<double>"))


def permuted_grams(df: DataFrame, columns: Sequence[str], key: Sequence[str], iterations: int = 200, seed: int = 42) -> DataFrame:
    """(iter, n, m): matrices after every column is permuted on its own.

    Rows fall into random blocks of about ``BLOCK_ROWS``. Inside a block the deviations from
    the block's means are permuted column by column; the means become rows of a table that is
    smaller by ``BLOCK_ROWS`` and is permuted in the same way, until one block holds it all.
    So no pairing of columns survives, neither of rows nor of block means, and the spread of
    the correlations is that of a permutation of all rows. Blocks are drawn by hash.
    """
    cols = list(columns)
    rows = complete_rows(df, cols).select(F.xxhash64(F.lit(seed), *key).alias("_k"), F.lit(1.0).alias("_w"), *[F.col(c).cast("double").alias(c) for c in cols])
    fields = ", ".join(["_k long", "_w double", *[f"`{c}` double" for c in cols]])

    def permuted(last: bool, weight: float):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_k")
            x, k = pdf[cols].to_numpy(float), pdf["_k"].to_numpy()
            x = x if last else x - np.average(x, axis=0, weights=pdf["_w"])
            out = []
            for i in range(iterations):
                order = np.argsort(mix(k, i * len(cols) + np.arange(len(cols))), axis=0, kind="stable")
                z = np.column_stack([np.full(len(x), float(last)), np.take_along_axis(x, order, axis=0), np.zeros(len(x))])
                out.append((i + 1, (z.T @ z * weight).ravel().tolist()))
            return pd.DataFrame(out, columns=["iter", "m"])

        return run

    def means(pdf: pd.DataFrame) -> pd.DataFrame:
        mean = np.average(pdf[cols].to_numpy(float), axis=0, weights=pdf["_w"])
        return pd.DataFrame([(int(pdf["_k"].min()), float(pdf["_w"].sum()), *mean)], columns=["_k", "_w", *cols])

    parts = []
    while True:
        count, total = rows.agg(F.count(F.lit(1)), F.sum("_w")).first()
        blocks, weight = max(1, round(count / BLOCK_ROWS)), (total or 0.0) / max(count, 1)
        last = blocks == 1
        blocked = rows.withColumn("_b", F.pmod(F.shiftrightunsigned("_k", 17), F.lit(blocks)))
        parts.append(blocked.groupBy("_b").applyInPandas(permuted(last, weight), "iter int, m array<double>"))
        if last:
            break
        # at the next level the key of a block is a hash of its own
        rows = settled(blocked.groupBy("_b").applyInPandas(means, fields).withColumn("_k", F.xxhash64(F.lit(seed + len(parts)), "_k")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return _sum_iterations(every)


def parallel_analysis(df: DataFrame, columns: Sequence[str], key: Sequence[str], iterations: int = 200, percentile: float = 0.95, seed: int = 42) -> DataFrame:
    """(component, eigenvalue, threshold, retained): observed eigenvalues beside the
    percentile of those of column-permuted data."""
    cols = list(columns)
    null = permuted_grams(df, cols, key, iterations, seed)
    spectra = _iteration_spectra(null)
    # one number per iteration and component: the percentile state is bounded
    threshold = spectra.groupBy("component").agg(F.percentile("eigenvalue", percentile).alias("threshold"))
    observed = eigenvalues(df, cols).select("component", "eigenvalue")
    return observed.join(threshold, "component", "inner").withColumn("retained", F.col("eigenvalue") > F.col("threshold"))


def _iteration_spectra(grams: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for it, m in zip(pdf["iter"], pdf["m"]):
                values, _ = eigen(component_matrix(m)[1])
                rows += [(int(it), k + 1, float(v)) for k, v in enumerate(values)]
            yield pd.DataFrame(rows, columns=["iter", "component", "eigenvalue"])

    return grams.select("iter", "m").mapInPandas(run, "iter int, component int, eigenvalue double")


def best_matches(target: np.ndarray, other: np.ndarray) -> list[int]:
    """Column of ``other`` for each column of ``target`` with the largest total absolute
    inner product: the assignment problem, solved by shortest augmenting paths."""
    cost = -np.abs(target.T @ other)
    rows, cols = cost.shape
    by_row, by_col = np.zeros(rows), np.zeros(cols)
    owner = np.full(cols, -1)
    for start in range(rows):
        # grow a tree of tight pairs from ``start`` until it reaches a free column
        gap, came, reached = np.full(cols, np.inf), np.full(cols, -1), np.zeros(cols, bool)
        row, via = start, -1
        while True:
            slack = cost[row] - by_row[row] - by_col
            better = ~reached & (slack < gap)
            gap[better], came[better] = slack[better], via
            col = int(np.where(reached, np.inf, gap).argmin())
            step = gap[col]
            by_row[start] += step
            by_row[owner[reached]] += step
            by_col[reached] -= step
            gap[~reached] -= step
            reached[col] = True
            if owner[col] < 0:
                break
            row, via = int(owner[col]), col
        while col >= 0:
            before = int(came[col])
            owner[col] = owner[before] if before >= 0 else start
            col = before
    match = [-1] * rows
    for col, row in enumerate(owner):
        if row >= 0:
            match[int(row)] = col
    return match


def align_components(target: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Columns of ``other`` reordered and sign-flipped to agree with ``target``."""
    picked = other[:, best_matches(target, other)]
    signs = np.sign((target * picked).sum(axis=0))
    return picked * np.where(signs == 0, 1.0, signs)


def bootstrap_components(
    df: DataFrame, columns: Sequence[str], key: Sequence[str], k: int = 3, iterations: int = 500, seed: int = 42, align: bool = True
) -> DataFrame:
    """Bootstrap intervals and means of eigenvalues and loadings, every draw standardised on
    its own: (component, feature, loading_lower, loading_upper, loading_mean,
    eigenvalue_lower, eigenvalue_upper, eigenvalue_mean). Loadings carry the root of their
    eigenvalue. See :func:`bootstrap_directions` for draws of data that are scaled once."""
    cols = list(columns)
    values, vectors = eigen(component_matrix(feature_gram(df, cols).first()["m"])[1])
    estimate = vectors[:, :k] * np.sqrt(values[:k])
    grams = bootstrap_grams(df.withColumn("_zero", F.lit(0.0)), [*cols, "_zero"], key, iterations, seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for it, m in zip(pdf["iter"], pdf["m"]):
                lam, vec = eigen(component_matrix(m)[1])
                load = vec[:, :k] * np.sqrt(lam[:k])
                load = align_components(estimate, load) if align else load
                rows += [(int(it), c + 1, f, float(load[j, c]), float(lam[c])) for c in range(k) for j, f in enumerate(cols)]
            yield pd.DataFrame(rows, columns=["iter", "component", "feature", "loading", "eigenvalue"])

    draws = grams.select("iter", "m").mapInPandas(run, "iter int, component int, feature string, loading double, eigenvalue double")
    bounds = [F.percentile(c, q).alias(f"{c}_{side}") for c in ("loading", "eigenvalue") for side, q in (("lower", 0.025), ("upper", 0.975))]
    return draws.groupBy("component", "feature").agg(*bounds, F.avg("loading").alias("loading_mean"), F.avg("eigenvalue").alias("eigenvalue_mean"))


def bootstrap_directions(df: DataFrame, columns: Sequence[str], key: Sequence[str], k: int = 2, iterations: int = 500, seed: int = 42) -> DataFrame:
    """(component, feature, reference, mean, lower, upper) of the first ``k`` unit directions.

    Columns are scaled once by the whole table. Each draw's directions are matched with the
    reference ones and turned to their side, so two that swap places are put back.
    """
    cols = list(columns)
    n, _, _, xx, _, _ = unpack(feature_gram(df, cols).first()["m"])
    s = scales(xx, n)
    scale = np.outer(s, s)
    reference = eigen(xx / scale)[1][:, :k]
    grams = bootstrap_grams(df.withColumn("_zero", F.lit(0.0)), [*cols, "_zero"], key, iterations, seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for m in pdf["m"]:
                found = align_components(reference, eigen(unpack(m)[3] / scale)[1][:, :k])
                rows += [(c + 1, f, float(reference[j, c]), float(found[j, c])) for c in range(found.shape[1]) for j, f in enumerate(cols)]
            yield pd.DataFrame(rows, columns=["component", "feature", "reference", "direction"])

    draws = grams.select("m").mapInPandas(run, "component int, feature string, reference double, direction double")
    return draws.groupBy("component", "feature").agg(
        F.max("reference").alias("reference"), F.avg("direction").alias("mean"),
        F.percentile("direction", 0.025).alias("lower"), F.percentile("direction", 0.975).alias("upper"))


def bootstrap_coefficients(
    df: DataFrame, columns: Sequence[str], target: str, key: Sequence[str], fit: Callable[[Sequence[float]], np.ndarray] | None = None,
    iterations: int = 500, seed: int = 42,
) -> DataFrame:
    """(term, lower, upper, mean): coefficient intervals. ``fit`` maps a matrix over
    (1, columns, target) to the intercept and coefficients; OLS by default."""
    from .linear import fit_matrix

    solver = fit or (lambda m: fit_matrix(m, "ols"))
    terms = ["intercept", *columns]
    grams = bootstrap_grams(df, [*columns, target], key, iterations, seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(t, float(c)) for m in pdf["m"] for t, c in zip(terms, solver(m))], columns=["term", "coefficient"])

    draws = grams.select("m").mapInPandas(run, "term string, coefficient double")
    return draws.groupBy("term").agg(
        F.percentile("coefficient", 0.025).alias("lower"), F.percentile("coefficient", 0.975).alias("upper"), F.avg("coefficient").alias("mean")
    )


def component_report(panel: DataFrame, columns: Sequence[str], key: Sequence[str], iterations: int = 100) -> DataFrame:
    """First-component report over one row per environment: loading, contribution, share,
    environment count, components that a parallel analysis retains (at least one), and the
    mean and interval of the first of two aligned bootstrap directions; largest loading first."""
    from .diagnostics import environment_rows

    env = settled(complete_rows(environment_rows(panel), columns).select(*key, *columns))
    first = loadings(env, columns).filter("component = 1").select("feature", "loading", "contribution_pct")
    spectrum = eigenvalues(env, columns)
    share = spectrum.filter("component = 1").select("share")
    kept = retention(spectrum, parallel_analysis(env, columns, key, iterations)).select(F.col("by_parallel").alias("retained_components_parallel"))
    count = env.agg(F.count(F.lit(1)).alias("environments"))
    stability = bootstrap_directions(env, columns, key, min(2, len(columns)), iterations).filter("component = 1")
    stability = stability.select("feature", F.col("mean").alias("direction_mean"), F.col("lower").alias("direction_lower"), F.col("upper").alias("direction_upper"))
    # three one-row aggregates
    one_row = share.join(F.broadcast(count), F.lit(True), "inner").join(F.broadcast(kept), F.lit(True), "inner")
    return first.join(stability, "feature").join(F.broadcast(one_row), F.lit(True), "inner").orderBy(F.abs("loading").desc())


def reconstruction_error(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """Adds ``reconstruction_error``: root of the squared length of the standardised
    row minus that of its first k scores."""
    n, mean, _, xx, _, _ = unpack(feature_gram(df, columns).first()["m"])
    s = scales(xx, n)
    _, vectors = eigen(xx / np.outer(s, s))
    z = [(F.col(c) - float(mu)) / float(sd) for c, mu, sd in zip(columns, mean, s)]
    square = lambda e: e * e
    length = sum((square(x) for x in z), F.lit(0.0))
    kept = sum((square(sum((F.lit(float(w)) * x for w, x in zip(vectors[:, j], z)), F.lit(0.0))) for j in range(k)), F.lit(0.0))
    return df.withColumn("reconstruction_error", F.sqrt(F.greatest(length - kept, F.lit(0.0))))


def components_needed(df: DataFrame, columns: Sequence[str], share: float = 0.90) -> int:
    values, _ = eigen(component_matrix(feature_gram(df, columns).first()["m"])[1])
    return components_for_share(values, share)
