"""Leakage-safe folds as membership tables joined by key, never as row positions.

Units are shuffled by a seeded hash, so a retry or another partitioning gives
the same folds. Leave-one-out and future-and-unseen training sets are described
by "total minus own" sums; no pair of train and test rows is ever formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import dense_fold, hash_rank


def spatial_folds(df: DataFrame, folds: int = 5, unit: str = "spatial_unit", seed: int = 42) -> DataFrame:
    """(unit, fold): each unit is tested in exactly one of min(folds, units) folds."""
    table = dense_fold(df.filter(F.col(unit).isNotNull()), unit, folds, (), seed)
    if len(table.limit(2).collect()) < 2:
        raise ValueError("spatial folds need at least two units")
    return table.select(unit, "fold")


def with_folds(df: DataFrame, folds: DataFrame, unit: str = "spatial_unit") -> DataFrame:
    return df.join(folds, unit, "inner")


def leave_one_unit_out(df: DataFrame, target: str = "yield_tons_ha", unit: str = "spatial_unit") -> DataFrame:
    """One fold per unit: row counts and the mean of all other units."""
    own = df.groupBy(unit).agg(F.count(F.lit(1)).alias("test_rows"), F.sum(target).alias("_s"), F.count(target).alias("_c"))
    total = own.agg(F.sum("test_rows").alias("_n"), F.sum("_s").alias("_ts"), F.sum("_c").alias("_tc"))
    return own.join(F.broadcast(total), F.lit(True), "inner").select(
        F.col(unit).alias("fold"),
        "test_rows",
        (F.col("_n") - F.col("test_rows")).alias("train_rows"),
        ((F.col("_ts") - F.col("_s")) / F.nullif(F.col("_tc") - F.col("_c"), F.lit(0))).alias("training_mean"),
    )


def year_table(df: DataFrame, year: str = "year") -> DataFrame:
    """Distinct years with their position and row counts; years are few by nature."""
    counts = df.filter(F.col(year).isNotNull()).groupBy(year).agg(F.count(F.lit(1)).alias("test_rows"))
    w = Window.partitionBy().orderBy(year)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        F.col(year).alias("test_year"),
        F.row_number().over(w).alias("position"),
        "test_rows",
        F.coalesce(F.sum("test_rows").over(before), F.lit(0)).alias("train_rows"),
    )


def rolling_origin(df: DataFrame, minimum_years: int = 3, year: str = "year", minimum_folds: int = 1) -> DataFrame:
    """(fold, test_year, train_rows, test_rows): train on strictly earlier years."""
    table = year_table(df, year).filter(F.col("position") > minimum_years)
    table = table.select((F.col("position") - minimum_years).alias("fold"), "test_year", "train_rows", "test_rows")
    if len(table.limit(minimum_folds).collect()) < minimum_folds:
        raise ValueError("too few years for rolling-origin folds")
    return table


def inner_temporal(df: DataFrame, year: str = "year") -> DataFrame:
    return rolling_origin(df, 2, year, minimum_folds=2)


def rolling_membership(df: DataFrame, folds: DataFrame, year: str = "year") -> DataFrame:
    """Each row once per fold that uses it, with its role. The fold table holds one
    row per year, so the copies of a row are bounded by the number of years."""
    years = folds.agg(F.sort_array(F.collect_list(F.struct("test_year", "fold"))).alias("_folds"))
    rows = df.join(F.broadcast(years), F.lit(True), "inner")
    rows = rows.withColumn("_f", F.explode(F.filter("_folds", lambda f: f["test_year"] >= F.col(year))))
    role = F.when(F.col(year) == F.col("_f.test_year"), "test").otherwise("train")
    return rows.withColumns({"fold": F.col("_f.fold"), "role": role}).drop("_folds", "_f")


def future_unseen(df: DataFrame, target: str = "yield_tons_ha", unit: str = "spatial_unit", year: str = "year", minimum_years: int = 3) -> DataFrame:
    """One fold per (year, unit): training rows are earlier and of other units. The first
    ``minimum_years`` years are only trained on.

    Their count and mean are the running totals of all units minus the running
    totals of the unit itself.
    """
    cell = df.groupBy(unit, year).agg(F.count(F.lit(1)).alias("test_rows"), F.sum(target).alias("_s"), F.count(target).alias("_c"))
    before = lambda w: w.orderBy(year).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    own_w = before(Window.partitionBy(unit))
    own = cell.withColumns({f"_o{c}": zero(F.sum(c).over(own_w)) for c in ("test_rows", "_s", "_c")})
    years = cell.groupBy(year).agg(*[F.sum(c).alias(f"_y{c}") for c in ("test_rows", "_s", "_c")])
    all_w = before(Window.partitionBy())
    totals = years.select(
        year,
        F.row_number().over(Window.partitionBy().orderBy(year)).alias("_position"),
        *[zero(F.sum(f"_y{c}").over(all_w)).alias(f"_a{c}") for c in ("test_rows", "_s", "_c")],
    )
    out = own.join(totals, year, "inner").withColumn("train_rows", F.col("_atest_rows") - F.col("_otest_rows"))
    mean = (F.col("_a_s") - F.col("_o_s")) / F.nullif(F.col("_a_c") - F.col("_o_c"), F.lit(0))
    return out.filter((F.col("train_rows") > 0) & (F.col("_position") > minimum_years)).select(year, unit, "test_rows", "train_rows", mean.alias("training_mean"))


def calibration_split(unit_folds: DataFrame, unit: str = "spatial_unit", share: float = 0.2, seed: int = 42) -> DataFrame:
    """(fold, unit, role): in each fold the tested units, and the others split into
    proper training and calibration by a hash seeded with seed + fold."""
    folds = unit_folds.agg(F.collect_set("fold").alias("_all"))
    pairs = unit_folds.join(F.broadcast(folds), F.lit(True), "inner").select(
        F.col(unit), F.col("fold").alias("_own"), F.explode("_all").alias("fold")
    )
    test = pairs.filter(F.col("_own") == F.col("fold")).select("fold", unit, F.lit("test").alias("role"))
    train = pairs.filter(F.col("_own") != F.col("fold")).select("fold", unit)
    ranked = hash_rank(train, [unit], ["fold"], F.col("fold") + seed, "_rank", total="_n")
    role = F.when(F.col("_rank") > F.col("_n") - F.ceil(F.col("_n") * share), "calibration").otherwise("proper")
    return test.unionByName(ranked.select("fold", unit, role.alias("role")))


def inner_spatial(roles: DataFrame, folds: int = 4, unit: str = "spatial_unit", seed: int = 42) -> DataFrame:
    """(fold, unit, inner): inner folds among the proper-training units of each fold."""
    proper = roles.filter("role = 'proper'").select(F.col("fold").alias("outer"), unit)
    dealt = dense_fold(proper, unit, folds, ["outer"], seed)
    return dealt.select(F.col("outer").alias("fold"), unit, F.col("fold").alias("inner"))


def random_folds(df: DataFrame, key: Sequence[str], folds: int = 5, seed: int = 42) -> DataFrame:
    """Rows dealt evenly into folds by a hash of their unique key."""
    ranked = hash_rank(df, key, (), seed, "_rank")
    return ranked.withColumn("fold", (F.pmod(F.col("_rank") - 1, F.lit(folds)) + 1).cast("int")).drop("_rank")


def _deal(load: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of ``size`` rows each fold gets when every group goes to
    the fold with the least rows, the first of equals. The k-th group of a fold goes there at
    load + (k - 1) * size, so the ``count`` smallest such numbers are the placements."""
    before = lambda limit: [max(0, -(-(limit - x) // size)) for x in load]
    low, high = min(load), max(load) + size * count + 1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if sum(before(mid)) <= count else (low, mid)
    given = before(low)
    for f, x in enumerate(load):
        if sum(given) < count and x + given[f] * size == low:
            given[f] += 1
    return given


def balanced_group_folds(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """(group, fold): largest group first, each to the lightest fold.

    Only the distinct group sizes and how many groups have them come to the driver; n rows
    have fewer than sqrt(2 n) sizes. Each size's groups are dealt out there by number, and a
    group finds its fold by its hashed rank among the groups of its size.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    load, dealt = [0] * folds, []
    for size, count in sorted((tuple(r) for r in sizes.groupBy("n").count().collect()), reverse=True):
        given = _deal(load, size, count)
        load = [x + size * g for x, g in zip(load, given)]
        dealt.append((size, [sum(given[: f + 1]) for f in range(folds)]))
    table = df.sparkSession.createDataFrame(dealt, "n long, _upto array<long>")
    ranked = hash_rank(sizes, [group], ["n"], 42, "_rank").join(table, "n")
    fold = F.size(F.filter("_upto", lambda upto: upto < F.col("_rank"))) + 1
    return ranked.select(group, fold.cast("int").alias("fold"))


def year_pair(df: DataFrame, train_year: int, test_year: int, year: str = "year") -> DataFrame:
    """Train on one year, test on another."""
    role = F.when(F.col(year) == train_year, "train").when(F.col(year) == test_year, "test")
    return df.withColumn("role", role).filter("role is not null")


def temporal_calibration(membership: DataFrame, minimum_rows: int = 5, year: str = "year") -> DataFrame:
    """Training rows of the latest training year become calibration rows; a fold
    whose latest year is too thin is left without calibration (role ``train``)."""
    train = membership.filter("role = 'train'")
    per_year = train.groupBy("fold", year).agg(F.count(F.lit(1)).alias("_n"))
    latest = per_year.groupBy("fold").agg(F.max(F.struct(year, "_n")).alias("_l"))
    latest = latest.filter(F.col("_l._n") >= minimum_rows).select("fold", F.col(f"_l.{year}").alias("_year"))
    out = membership.join(latest, "fold", "left")
    role = (
        F.when(F.col("role") != "train", F.col("role"))
        .when(F.col("_year").isNull(), "train")
        .when(F.col(year) == F.col("_year"), "calibration")
        .otherwise("proper")
    )
    return out.withColumn("role", role).drop("_year")
