"""Series operators against plain Python, and the known traps one by one."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from seasonpanel.operators import calendar, series

DAY0 = dt.date(2020, 3, 1)
KEYS = ["spatial_unit", "year", "season"]


def frame(spark, rains: dict[str, list]):
    rows = [(k, 2020, "first_season", DAY0 + dt.timedelta(days=i), v) for k, vs in rains.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "spatial_unit string, year int, season string, date date, rain_mm double")


def runs(flags):
    out, start = [], None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        if not f and start is not None:
            out.append((start, i - start))
            start = None
    return out


def expected(values):
    """Independent restatement of the current rules."""
    x = [v if v is not None else 0.0 for v in values]
    n = len(x)
    onset = None
    for s in range(max(0, n - 18)):
        longest = max((length for _, length in runs([v < 1 for v in x[s + 3 : s + 18]])), default=0)
        if sum(x[s : s + 3]) >= 20 and longest <= 7:
            onset = s
            break
    dry = runs([v < 1 for v in x])
    ends = [s for s, length in dry if length >= 7 and (onset is None or s >= onset)]
    wet = [i for i, v in enumerate(x) if v >= 1]
    end = ends[-1] if ends else (wet[-1] if wet else None)
    return {
        "onset": onset,
        "end": end,
        "longest": max((length for _, length in dry), default=0),
        "five": max(sum(x[max(0, i - 4) : i + 1]) for i in range(n)),
        "total": sum(x),
    }


def test_random_series_match_plain_python(spark):
    rng = random.Random(7)
    rains = {}
    for i in range(120):
        n = rng.choice([1, 5, 18, 19, 25, 40, 80, 130])
        wet = rng.choice([0.15, 0.35, 0.6])
        rains[f"u{i}"] = [None if rng.random() < 0.05 else (round(rng.random() * 24, 1) if rng.random() < wet else rng.choice([0.0, 0.5])) for _ in range(n)]
    got = {r["spatial_unit"]: r for r in series.rainfall_features(frame(spark, rains)).collect()}
    as_index = lambda d: None if d is None else (d - DAY0).days
    for name, values in rains.items():
        e, g = expected(values), got[name]
        assert as_index(g["rainfall_onset_date"]) == e["onset"], name
        assert as_index(g["rainfall_cessation_date"]) == e["end"], name
        assert g["longest_dry_spell_days"] == e["longest"], name
        assert g["maximum_5day_rainfall_mm"] == pytest.approx(e["five"])
        assert g["rain_total_mm"] == pytest.approx(e["total"])


def test_dry_run_of_exactly_seven_splits_the_two_rules(spark):
    rain = [10.0, 10.0, 5.0] + [0.0] * 7 + [5.0] * 15
    days = frame(spark, {"a": rain})
    assert series.rainfall_features(days).first()["rainfall_onset_date"] == DAY0
    older = days.select(F.col("spatial_unit").alias("district"), "date", "rain_mm")
    row = series.older_rainfall_features(older).first()
    assert row["season_onset_day"] is None or row["season_onset_day"] > 61
    assert row["false_onset_flag"] == 1


def test_eight_dry_days_reject_and_short_series_have_no_onset(spark):
    wet19, wet18 = [10.0] * 19, [10.0] * 18
    eight = [10.0, 10.0, 5.0] + [0.0] * 8 + [0.4] + [5.0] * 4 + [2.0] * 10
    got = {r["spatial_unit"]: r["rainfall_onset_date"] for r in series.rainfall_features(frame(spark, {"a": wet19, "b": wet18, "c": eight})).collect()}
    assert got["a"] == DAY0
    assert got["b"] is None
    assert got["c"] != DAY0


def test_no_wet_day_gives_dry_spell_or_nothing(spark):
    got = {r["spatial_unit"]: r for r in series.rainfall_features(frame(spark, {"a": [0.0] * 5, "b": [0.0] * 9})).collect()}
    assert got["a"]["rainfall_cessation_date"] is None
    assert got["b"]["rainfall_cessation_date"] == DAY0
    assert got["a"]["season_length_days"] is None


def test_heatwave_bridges_a_missing_day(spark):
    rows = [("d", DAY0 + dt.timedelta(days=i), v) for i, v in enumerate([31.0, None, 31.0, 31.0, 20.0, 31.0])]
    df = spark.createDataFrame(rows, "district string, date date, tmax_c double")
    assert series.heatwave_count(df, ["district"]).first()["heatwave_count"] == 1


def test_run_list_positions(spark):
    df = frame(spark, {"a": [0.0, 0.0, 5.0, None, 0.0, 5.0, 0.0]})
    got = sorted((r["start_index"], r["run_length"]) for r in series.run_list(df, F.col("rain_mm") < 1, KEYS).collect())
    assert got == [(0, 2), (4, 1), (6, 1)]


def test_overlapping_windows_and_empty_window(spark):
    units = spark.createDataFrame([("a",), ("b",)], "spatial_unit string")
    cal = calendar.season_calendar(units, [2020])
    assert cal.count() == 6
    daily = spark.createDataFrame([("a", dt.date(2020, 3, 1), 1.0), ("a", dt.date(2020, 7, 15), 2.0), ("a", dt.date(2020, 8, 1), 3.0)], "spatial_unit string, date date, rain_mm double")
    days = calendar.season_days(daily, cal)
    assert sorted((r["season"], r["rain_mm"]) for r in days.collect()) == [
        ("annual", 1.0), ("annual", 2.0), ("annual", 3.0), ("first_season", 1.0), ("first_season", 2.0)]
    assert calendar.season_days(daily, cal, month_key=False).count() == 5
    with pytest.raises(ValueError, match="no daily records"):
        calendar.assert_no_empty_windows(cal, days)


def test_season_days_never_collects_the_calendar(spark):
    """The windows listed by month are shuffled: their number is not seen by size estimates."""
    from seasonpanel.operators.calendar import season_calendar, season_days

    units = spark.range(40).selectExpr("concat('U', id) as spatial_unit")
    daily = units.selectExpr("spatial_unit", "explode(sequence(date'2001-02-27', date'2001-03-02')) as date")
    found = season_days(daily, season_calendar(units, [2001]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    seasons = {(r["season"], r["n"]) for r in found.groupBy("season").count().withColumnRenamed("count", "n").collect()}
    assert seasons == {("annual", 160), ("first_season", 80)}
