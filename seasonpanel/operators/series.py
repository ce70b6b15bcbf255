"""Ordered daily series: runs, rolling sums, onset, cessation, season length.

Input rows are unique per group and date, so a group is at most one season of
days. All windows share one partitioning and one order: the whole feature set
needs a single shuffle, and the closing groupBy reuses it.

Dry runs need no run ids. ``row number - row number of the last non-dry row`` is
the length of the dry run so far; a run passes each length exactly once, so
"runs of at least k" is a count of rows where that length equals k.
Frames count rows, not calendar days: a missing day compresses the series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K

SEASON_KEY = ["spatial_unit", "year", "season"]


def series_window(keys: Sequence[str], date: str = "date"):
    return Window.partitionBy(*keys).orderBy(date)


def run_so_far(flag: Column, keys: Sequence[str], date: str = "date") -> Column:
    """Length of the run of true rows that ends at this row (0 on a false row).

    Needs the ``_rn`` column of ``with_row_number``.
    """
    w = series_window(keys, date).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last_break = F.max(F.when(~F.coalesce(flag, F.lit(False)), F.col("_rn"))).over(w)
    return (F.col("_rn") - F.coalesce(last_break, F.lit(0))).cast("int")


def with_row_number(df: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(series_window(keys, date)))


def run_groups(df: DataFrame, flag: Column, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Gaps and islands: adds ``flag`` (missing counts as false) and ``run_id``,
    which grows by one whenever the flag changes."""
    w = series_window(keys, date)
    flagged = df.withColumn("flag", F.coalesce(flag, F.lit(False)))
    change = (F.col("flag") != F.lag("flag").over(w)).cast("int")
    marked = flagged.withColumn("_chg", F.coalesce(change, F.lit(1)))
    return marked.withColumn("run_id", F.sum("_chg").over(w)).drop("_chg")


def run_list(df: DataFrame, flag: Column, keys: Sequence[str], date: str = "date") -> DataFrame:
    """One row per run of true rows: 0-based start position, start date, length."""
    runs = with_row_number(run_groups(df, flag, keys, date), keys, date)
    return (
        runs.filter("flag")
        .groupBy(*keys, "run_id")
        .agg(
            (F.min("_rn") - 1).cast("int").alias("start_index"),
            F.min(date).alias("start_date"),
            F.count(F.lit(1)).alias("run_length"),
        )
        .drop("run_id")
    )


def longest_run(df: DataFrame, flag: Column, keys: Sequence[str], date: str = "date") -> DataFrame:
    runs = with_row_number(df, keys, date).withColumn("_run", run_so_far(flag, keys, date))
    return runs.groupBy(*keys).agg(F.max("_run").alias("longest_run"))


def count_runs(
    df: DataFrame, flag: Column, keys: Sequence[str], lengths: Sequence[int] = (7, 10), date: str = "date"
) -> DataFrame:
    """Number of runs of at least each length."""
    runs = with_row_number(df, keys, date).withColumn("_run", run_so_far(flag, keys, date))
    return runs.groupBy(*keys).agg(*[F.count_if(F.col("_run") == n).alias(f"runs_{n}") for n in lengths])


def rolling_sum(col: Column | str, keys: Sequence[str], rows: int = K.ROLLING_DAYS, date: str = "date") -> Column:
    """Sum over this and the previous rows; missing values are skipped."""
    return F.sum(col).over(series_window(keys, date).rowsBetween(-(rows - 1), 0))


def maximum_rolling_sum(
    df: DataFrame, value: str, keys: Sequence[str], rows: int = K.ROLLING_DAYS, date: str = "date"
) -> DataFrame:
    rolled = df.withColumn("_roll", rolling_sum(value, keys, rows, date))
    return rolled.groupBy(*keys).agg(F.max("_roll").alias("maximum_rolling_sum"))


def mark_rain_series(
    df: DataFrame,
    keys: Sequence[str],
    rain: str = "rain_mm",
    date: str = "date",
    rule: str = "max_allowed_run",
    doy_window: Column | None = None,
    total_mm: float = K.ONSET_TOTAL_MM,
    days: int = K.ONSET_DAYS,
    followup: int = K.ONSET_FOLLOWUP_DAYS,
    dry_spell: int = K.DRY_SPELL_DAYS,
    dry_mm: float = K.WET_DAY_MM,
) -> DataFrame:
    """Window columns from which every rainfall feature is aggregated.

    ``max_allowed_run`` (current rule): a missing day is a dry day; the follow-up
    may hold a dry run of exactly ``dry_spell``; a start needs the whole
    follow-up plus ``days`` rows behind it. ``reject_run`` (older rule): a missing
    day is neither dry nor wet; a run of ``dry_spell`` rejects; a short follow-up
    is judged on the rows that remain; starts lie inside ``doy_window``.

    The follow-up frame holds a run of n dry rows exactly when some row at least
    n - 1 rows into the frame ends a run of n or more.
    """
    current = rule == "max_allowed_run"
    limit = dry_spell + 1 if current else dry_spell
    value = F.coalesce(F.col(rain).cast("double"), F.lit(0.0)) if current else F.col(rain).cast("double")
    w = series_window(keys, date)
    out = with_row_number(df.withColumn("_rain", value), keys, date)
    ahead = w.rowsBetween(0, days - 1)
    out = out.withColumns(
        {
            "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
            "_start_total": F.when(F.count("_rain").over(ahead) == days, F.sum("_rain").over(ahead)),
            "_roll": F.sum("_rain").over(w.rowsBetween(-(K.ROLLING_DAYS - 1), 0)),
            "_dry_run": run_so_far(F.col("_rain") < dry_mm, keys, date),
            "_run_start": F.lag(date, dry_spell - 1).over(w),
        }
    )
    follow_dry = F.max("_dry_run").over(w.rowsBetween(days + limit - 1, days + followup - 1))
    allowed = F.col("_rn") <= F.col("_n") - followup - days if current else doy_window
    out = out.withColumns(
        {
            "_candidate": F.coalesce((F.col("_start_total") >= total_mm) & allowed, F.lit(False)),
            "_rejected": F.coalesce(follow_dry >= limit, F.lit(False)),
        }
    )
    onset = F.min(F.when(F.col("_candidate") & ~F.col("_rejected"), F.col(date))).over(Window.partitionBy(*keys))
    return out.withColumn("_onset", onset)


def rainfall_features(days: DataFrame, keys: Sequence[str] = SEASON_KEY, rain: str = "rain_mm", date: str = "date") -> DataFrame:
    """Seasonal rainfall summary, one row per group, current rules."""
    m = mark_rain_series(days, keys, rain, date)
    wet = F.when(F.col("_rain") >= K.WET_DAY_MM, F.col("_rain"))
    ending = F.when(
        (F.col("_dry_run") == K.DRY_SPELL_DAYS)
        & (F.col("_onset").isNull() | (F.col("_run_start") >= F.col("_onset"))),
        F.col("_run_start"),
    )
    last_wet = F.max(F.when(F.col("_rain") >= K.WET_DAY_MM, F.col(date)))
    summary = m.groupBy(*keys).agg(
        F.sum("_rain").alias("rain_total_mm"),
        F.avg("_rain").alias("rain_mean_daily_mm"),
        F.count_if(F.col("_rain") >= K.WET_DAY_MM).alias("rainy_days_1mm"),
        F.count_if(F.col("_rain") >= K.RAINY_DAY_MM).alias("rainy_days_10mm"),
        F.count_if(F.col("_rain") >= K.HEAVY_RAIN_MM).alias("heavy_rain_days_20mm"),
        F.max("_rain").alias("maximum_1day_rainfall_mm"),
        F.max("_roll").alias("maximum_5day_rainfall_mm"),
        F.max("_dry_run").alias("longest_dry_spell_days"),
        F.when((F.count(wet) >= 2) & (F.avg(wet) > 0), F.stddev_samp(wet) / F.avg(wet)).alias("wet_day_rainfall_cv"),
        F.max("_onset").alias("rainfall_onset_date"),
        F.coalesce(F.max(ending), last_wet).alias("rainfall_cessation_date"),
    )
    return summary.withColumns(
        {
            "onset_day_of_year": F.dayofyear("rainfall_onset_date"),
            "cessation_day_of_year": F.dayofyear("rainfall_cessation_date"),
            "season_length_days": F.datediff("rainfall_cessation_date", "rainfall_onset_date") + 1,
        }
    )


def older_season_rows(daily: DataFrame, unit: str = "district", date: str = "date") -> DataFrame:
    """Rows of the two older seasons (month lists) with year and season keys."""
    month = F.month(date)
    season = F.when(month.isin(*K.FIRST_MONTHS), "first").when(month.isin(*K.SECOND_MONTHS), "second")
    return daily.withColumns({"year": F.year(date), "season": season}).filter(F.col("season").isNotNull())


def older_doy_window(date: str = "date") -> Column:
    doy = F.dayofyear(date)
    return F.when(F.col("season") == "first", doy.between(*K.FIRST_WINDOW_DOY)).otherwise(doy.between(*K.SECOND_WINDOW_DOY))


def older_rainfall_features(
    daily: DataFrame, unit: str = "district", rain: str = "rain_mm", date: str = "date"
) -> DataFrame:
    """Older seasonal feature row per unit, year and season, days of year as numbers."""
    keys = [unit, "year", "season"]
    inside = older_doy_window(date)
    m = mark_rain_series(older_season_rows(daily, unit, date), keys, rain, date, rule="reject_run", doy_window=inside)
    # the closing dry spell is sought among the rows of the day-of-year window only
    w = series_window(keys, date)
    dry_inside = inside & F.coalesce(F.col("_rain") < K.WET_DAY_MM, F.lit(False))
    window_break = F.max(F.when(~dry_inside, F.col("_rn"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    m = m.withColumns(
        {"_inside": inside, "_window_run": F.when(inside, F.col("_rn") - F.coalesce(window_break, F.lit(0)))}
    )
    wet = F.when(F.col("_rain") >= K.WET_DAY_MM, F.col("_rain"))
    ending = F.when(
        (F.col("_window_run") == K.DRY_SPELL_DAYS)
        & (F.col("_onset").isNull() | (F.dayofyear("_run_start") >= F.dayofyear("_onset"))),
        F.dayofyear("_run_start"),
    )
    last_wet = F.max(F.when(F.col("_inside") & (F.col("_rain") >= K.WET_DAY_MM), F.dayofyear(date)))
    out = m.groupBy(*keys).agg(
        F.coalesce(F.sum("_rain"), F.lit(0.0)).alias("season_total_mm"),
        F.max("_dry_run").alias("longest_dry_spell_days"),
        F.count_if(F.col("_dry_run") == 7).alias("dry_spell_count_7d"),
        F.count_if(F.col("_dry_run") == 10).alias("dry_spell_count_10d"),
        F.count_if(F.col("_rain") >= K.WET_DAY_MM).alias("rain_days_1mm"),
        F.count_if(F.col("_rain") >= K.RAINY_DAY_MM).alias("rain_days_10mm"),
        F.count_if(F.col("_rain") >= K.HEAVY_RAIN_MM).alias("rain_days_20mm"),
        F.coalesce(F.avg(wet), F.lit(0.0)).alias("mean_wet_day_rainfall"),
        F.max("_roll").alias("maximum_5day_rainfall"),
        F.dayofyear(F.max("_onset")).alias("season_onset_day"),
        F.coalesce(F.max(ending), last_wet).alias("season_cessation_day"),
        F.coalesce(
            F.min_by(F.col("_rejected").cast("int"), F.when(F.col("_candidate"), F.col("_rn"))), F.lit(0)
        ).alias("false_onset_flag"),
    )
    length = F.col("season_cessation_day") - F.col("season_onset_day") + 1
    return out.withColumn("season_length_days", F.when(length >= 1, length))


def heatwave_count(
    daily: DataFrame, keys: Sequence[str], tmax: str = "tmax_c", threshold: float = K.OLDER_HEAT_C,
    days: int = K.HEATWAVE_DAYS, date: str = "date",
) -> DataFrame:
    """Number of runs of at least ``days`` hot rows. Rows without a reading are
    removed first, so a run bridges them."""
    rows = daily.filter(F.col(tmax).isNotNull())
    return count_runs(rows, F.col(tmax) >= threshold, keys, [days], date).withColumnRenamed(
        f"runs_{days}", "heatwave_count"
    )


def centred(value: str, groups: Sequence[str]) -> Column:
    """Value minus its group mean. For groups bounded by a season or year; use
    ``anomalies`` where a group may be large."""
    return F.col(value) - F.avg(value).over(Window.partitionBy(*groups))


def anomalies(df: DataFrame, values: Sequence[str], groups: Sequence[str], suffix: str = "_anomaly") -> DataFrame:
    """Value minus group mean as aggregate plus join, so that a hot group is
    pre-aggregated and never sorted in one task."""
    means = df.groupBy(*groups).agg(*[F.avg(v).alias(f"_mean_{v}") for v in values])
    joined = df.join(means, list(groups), "left")
    return joined.withColumns({f"{v}{suffix}": F.col(v) - F.col(f"_mean_{v}") for v in values}).drop(
        *[f"_mean_{v}" for v in values]
    )


def cumulative_share(df: DataFrame, value: str, order: str, groups: Sequence[str] = ()) -> DataFrame:
    """Share and running share of the total. Rows are components or features, so
    a group holds at most one row per column of a matrix."""
    whole = Window.partitionBy(*groups)
    upto = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(value).over(whole)
    return df.withColumns({"share": F.col(value) / total, "cumulative_share": F.sum(value).over(upto) / total})
