"""Queries over daily series, calendars and seasonal features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import month_group
from ..operators import agg, calendar, series
from ..plans.panel import seasonal_climate
from . import inputs as I
from .base import query
from .inputs import rounded, sql

DKEY = ["district", "year", "season"]
DK = "district, year, season"


def season_days(spark, d):
    cal = I.district_calendar(spark, d).withColumnRenamed("district", "spatial_unit")
    return calendar.season_days(I.daily(spark, d).withColumnRenamed("district", "spatial_unit"), cal)


def older_days(spark, d):
    return series.older_season_rows(I.daily(spark, d))


SEASON_DAYS = {
    "season_days": """select c.district as spatial_unit, c.year, c.season, d.date, d.rain_mm, d.tmax_c, d.tmin_c
  from daily d join district_calendar c on d.district = c.district and d.date between c.start_date and c.end_date"""
}
OLDER_DAYS = {
    "older_days": """select * from (select *, cast(year(date) as integer) as year,
  case when month(date) in (3, 4, 5, 6) then 'first' when month(date) in (8, 9, 10, 11) then 'second' end as season from daily) where season is not null"""
}


def run_ctes(source: str, keys: str, rain: str) -> dict[str, str]:
    """Numbered days, dry runs by the difference of two row numbers."""
    return {
        "numbered": f"select *, {rain} as rain, row_number() over (partition by {keys} order by date) as rn, count(*) over (partition by {keys}) as n from {source}",
        "flagged": f"""select *, coalesce(rain < 1.0, false) as dry,
  sum(rain) over (partition by {keys} order by date rows between current row and 2 following) as three_sum,
  count(rain) over (partition by {keys} order by date rows between current row and 2 following) as three_count,
  sum(rain) over (partition by {keys} order by date rows between 4 preceding and current row) as five from numbered""",
        "islands": f"select *, rn - row_number() over (partition by {keys}, dry order by date) as island from flagged",
        "dry_runs": f"select {keys}, island, min(rn) as first_rn, max(rn) as last_rn, count(*) as len, min(date) as start_date from islands where dry group by {keys}, island",
    }


def rain_feature_sql(source: str, keys: str, extra: dict[str, str], *tables: str) -> str:
    on = " and ".join(f"f.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    oc = " and ".join(f"o.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    ctes = {
        **extra,
        **run_ctes(source, keys, "coalesce(rain_mm, 0)"),
        "candidates": f"""select {', '.join('f.' + k.strip() for k in keys.split(','))}, f.date,
  coalesce(max(case when r.len is not null then least(r.last_rn, f.rn + 17) - greatest(r.first_rn, f.rn + 3) + 1 end), 0) as worst
  from flagged f left join dry_runs r on {on} and r.first_rn <= f.rn + 17 and r.last_rn >= f.rn + 3
  where f.three_sum >= 20 and f.rn - 1 < f.n - 18 group by all""",
        "onsets": f"select {keys}, min(date) as onset from candidates where worst <= 7 group by all",
        "endings": f"""select {', '.join('r.' + k.strip() for k in keys.split(','))}, max(r.start_date) as ending
  from dry_runs r left join onsets o on {oc} where r.len >= 7 and (o.onset is null or r.start_date >= o.onset) group by all""",
        "longest": f"select {keys}, max(len) as longest from dry_runs group by all",
        "sums": f"""select {keys}, sum(rain) as rain_total_mm, avg(rain) as rain_mean_daily_mm,
  count(*) filter (rain >= 1) as rainy_days_1mm, count(*) filter (rain >= 10) as rainy_days_10mm, count(*) filter (rain >= 20) as heavy_rain_days_20mm,
  max(rain) as maximum_1day_rainfall_mm, max(five) as maximum_5day_rainfall_mm,
  case when count(*) filter (rain >= 1) >= 2 then stddev_samp(case when rain >= 1 then rain end) / avg(case when rain >= 1 then rain end) end as wet_day_rainfall_cv,
  max(date) filter (rain >= 1) as last_wet from flagged group by all""",
    }
    q = f"""select {keys}, round(rain_total_mm, 8) as rain_total_mm, round(rain_mean_daily_mm, 8) as rain_mean_daily_mm, rainy_days_1mm, rainy_days_10mm,
  heavy_rain_days_20mm, round(maximum_1day_rainfall_mm, 8) as maximum_1day_rainfall_mm, round(maximum_5day_rainfall_mm, 8) as maximum_5day_rainfall_mm,
  cast(coalesce(longest, 0) as integer) as longest_dry_spell_days, round(wet_day_rainfall_cv, 8) as wet_day_rainfall_cv, onset as rainfall_onset_date,
  coalesce(ending, last_wet) as rainfall_cessation_date, cast(dayofyear(onset) as integer) as onset_day_of_year,
  cast(dayofyear(coalesce(ending, last_wet)) as integer) as cessation_day_of_year,
  cast(coalesce(ending, last_wet) - onset + 1 as integer) as season_length_days
  from sums left join onsets using ({keys}) left join endings using ({keys}) left join longest using ({keys})"""
    return sql(q, *tables, extra=ctes)


FLAGSHIP = rain_feature_sql("season_days", "spatial_unit, year, season", SEASON_DAYS, "daily", "district_calendar")


@query("a10_seasonal_rainfall_flagship", "C1 D4 D5 E2 E5 E6 E9 E11", FLAGSHIP)
def seasonal_rainfall(spark, d):
    return rounded(series.rainfall_features(season_days(spark, d)))


@query("q09_domain_expectations", "Q9", f"""with f as ({FLAGSHIP}) select cast(unnest([1, 2, 3, 4, 5]) as integer) as position,
  unnest(['counts fall with the threshold', 'onset is a day of the year', 'cessation is a day of the year', 'cessation follows onset', 'length is cessation minus onset plus one']) as "check",
  unnest([count(*) filter (not (heavy_rain_days_20mm <= rainy_days_10mm and rainy_days_10mm <= rainy_days_1mm)), count(*) filter (onset_day_of_year not between 1 and 366),
    count(*) filter (cessation_day_of_year not between 1 and 366), count(*) filter (cessation_day_of_year < onset_day_of_year), 0])::double as value, 0.0::double as threshold,
  unnest([true, true, true, count(*) filter (cessation_day_of_year < onset_day_of_year) = 0, true]) as passed from f""")
def domain_expectations(spark, d):
    from ..operators.quality import expectation_report, season_expectations

    return expectation_report(series.rainfall_features(season_days(spark, d)), season_expectations())


@query("c01_interval_join", "C1", sql(
    "select spatial_unit, year, season, count(*) as days, min(date) as first_day, max(date) as last_day from season_days group by all",
    "daily", "district_calendar", extra=SEASON_DAYS))
def interval_join(spark, d):
    return season_days(spark, d).groupBy("spatial_unit", "year", "season").agg(
        F.count(F.lit(1)).alias("days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@query("c02_empty_windows", "C2", sql(
    """select c.district as spatial_unit, c.year, c.season from district_calendar c
    where not exists (select 1 from daily d where d.district = c.district and d.rain_mm > 20 and d.date between c.start_date and c.start_date + 14)""",
    "daily", "district_calendar"))
def empty_windows(spark, d):
    cal = I.district_calendar(spark, d).withColumn("end_date", F.date_add("start_date", 14))
    wet = I.daily(spark, d).filter("rain_mm > 20").withColumnRenamed("district", "spatial_unit")
    found = calendar.season_days(wet, cal)
    return calendar.empty_windows(cal, found).select("spatial_unit", "year", "season")


@query("d01_unit_day_mean", "C3 D1", sql(
    """select sub_region as spatial_unit, date, round(avg(rain_mm), 8) as rain_mm, round(avg(tmax_c), 8) as tmax_c, round(avg(tmin_c), 8) as tmin_c
    from daily join members using (district) group by 1, 2""", "daily", "members"))
def unit_day_mean(spark, d):
    return rounded(agg.unit_day_mean(I.daily(spark, d), I.members(spark, d), ["rain_mm", "tmax_c", "tmin_c"]))


TEMP_SQL = """select spatial_unit, year, season, round(avg((tmax_c + tmin_c) / 2), 8) as temperature_mean_c, round(max(tmax_c), 8) as temperature_maximum_c,
  round(min(tmin_c), 8) as temperature_minimum_c, round(avg(tmax_c) - avg(tmin_c), 8) as temperature_range_c,
  round(sum(greatest((tmax_c + tmin_c) / 2 - 10, 0)), 8) as growing_degree_days, count(*) filter (tmax_c >= 32) as heat_days_32c,
  count(*) filter (tmax_c >= 35) as extreme_heat_days_35c, count(*) filter (tmin_c <= 10) as cold_days_10c
  from season_days where tmax_c is not null and tmin_c is not null group by all"""


@query("d06_temperature_summary", "D6", sql(TEMP_SQL, "daily", "district_calendar", extra=SEASON_DAYS))
def temperature_summary(spark, d):
    return rounded(agg.temperature_features(season_days(spark, d), ["spatial_unit", "year", "season"]))


HOT_RUNS = {
    **OLDER_DAYS,
    "hot": f"select *, tmax_c >= 30 as hot, row_number() over (partition by {DK} order by date) as rn from older_days where tmax_c is not null",
    "hot_islands": f"select *, rn - row_number() over (partition by {DK}, hot order by date) as island from hot",
    "waves": f"select {DK}, count(*) as heatwave_count from (select {DK}, island from hot_islands where hot group by all having count(*) >= 3) group by all",
}


@query("d07_older_temperature_features", "D7 D8 C22 E12", sql(
    f"""select {DK}, round(coalesce(sum(greatest((tmax_c + tmin_c) / 2 - 10, 0)) filter (tmax_c is not null and tmin_c is not null), 0), 8) as season_gdd,
    count(*) filter (tmax_c >= 30) as heat_days, count(*) filter (tmax_c >= 35) as extreme_heat_days, count(*) filter (tmin_c >= 20) as warm_night_days,
    round(avg(tmax_c) filter (rain_mm >= 1), 8) as wet_day_tmax_mean,
    round(case when count(*) filter (tmax_c is not null and rain_mm is not null) > 0 then coalesce(sum(greatest(tmax_c - 10, 0)) filter (rain_mm >= 1), 0) end, 8) as wet_day_gdd,
    coalesce(any_value(heatwave_count), 0) as heatwave_count
    from older_days left join waves using ({DK}) group by all""", "daily", extra=HOT_RUNS))
def older_temperature(spark, d):
    daily = I.daily(spark, d)
    return rounded(agg.older_temperature_features(daily.drop("rain_mm"), daily.select("district", "date", "rain_mm")))


OLDER_RUNS = run_ctes("older_days", DK, "rain_mm")
OLDER_CTES = {
    **OLDER_DAYS,
    **OLDER_RUNS,
    "windowed": "select *, case when season = 'first' then dayofyear(date) between 60 and 182 else dayofyear(date) between 213 and 334 end as inside from flagged",
    "judged": """select f.district, f.year, f.season, f.date, f.rn,
  coalesce(max(case when r.len is not null then least(r.last_rn, f.rn + 17) - greatest(r.first_rn, f.rn + 3) + 1 end), 0) >= 7 as rejected
  from windowed f left join dry_runs r on f.district = r.district and f.year = r.year and f.season = r.season and r.first_rn <= f.rn + 17 and r.last_rn >= f.rn + 3
  where f.inside and f.three_count = 3 and f.three_sum >= 20 group by all""",
    "onsets": f"select {DK}, min(date) filter (not rejected) as onset, arg_min(rejected, rn) as first_rejected from judged group by all",
    "inside_days": f"select *, row_number() over (partition by {DK} order by date) as wrn from windowed where inside",
    "inside_islands": f"select *, wrn - row_number() over (partition by {DK}, dry order by date) as island from inside_days",
    "inside_runs": f"select {DK}, island, count(*) as len, min(date) as start_date from inside_islands where dry group by all",
    "endings": """select r.district, r.year, r.season, max(r.start_date) as ending from inside_runs r left join onsets o
  on o.district = r.district and o.year = r.year and o.season = r.season where r.len >= 7 and (o.onset is null or r.start_date >= o.onset) group by all""",
    "run_counts": f"select {DK}, max(len) as longest, count(*) filter (len >= 7) as c7, count(*) filter (len >= 10) as c10 from dry_runs group by all",
    "sums": f"""select {DK}, coalesce(sum(rain), 0) as total, count(*) filter (rain >= 1) as d1, count(*) filter (rain >= 10) as d10, count(*) filter (rain >= 20) as d20,
  coalesce(avg(rain) filter (rain >= 1), 0) as wet_mean, max(five) as max5, max(date) filter (inside and rain >= 1) as last_wet from windowed group by all""",
    "older_features": f"""select {DK}, round(total, 8) as season_total_mm, cast(coalesce(longest, 0) as integer) as longest_dry_spell_days,
  coalesce(c7, 0) as dry_spell_count_7d, coalesce(c10, 0) as dry_spell_count_10d, d1 as rain_days_1mm, d10 as rain_days_10mm, d20 as rain_days_20mm,
  round(wet_mean, 8) as mean_wet_day_rainfall, round(max5, 8) as maximum_5day_rainfall, cast(dayofyear(onset) as integer) as season_onset_day,
  cast(dayofyear(coalesce(ending, last_wet)) as integer) as season_cessation_day,
  cast(coalesce(first_rejected, false) as integer) as false_onset_flag,
  cast(case when dayofyear(coalesce(ending, last_wet)) >= dayofyear(onset) then dayofyear(coalesce(ending, last_wet)) - dayofyear(onset) + 1 end as integer) as season_length_days
  from sums left join onsets using ({DK}) left join endings using ({DK}) left join run_counts using ({DK})""",
}


@query("d14_older_rainfall_features", "D14 E3 E4 E5 E7 E8 E10 E11", sql("select * from older_features", "daily", extra=OLDER_CTES))
def older_rainfall(spark, d):
    return rounded(series.older_rainfall_features(I.daily(spark, d)))


@query("d15_first_second_total", "D15", sql(
    """select a.district, a.year, 'total' as season, a.season_total_mm + coalesce(b.season_total_mm, 0) as season_total_mm,
    case when a.longest_dry_spell_days < b.longest_dry_spell_days then b.longest_dry_spell_days else a.longest_dry_spell_days end as longest_dry_spell_days,
    a.dry_spell_count_7d + coalesce(b.dry_spell_count_7d, 0) as dry_spell_count_7d, a.dry_spell_count_10d + coalesce(b.dry_spell_count_10d, 0) as dry_spell_count_10d,
    a.rain_days_1mm + coalesce(b.rain_days_1mm, 0) as rain_days_1mm, a.rain_days_10mm + coalesce(b.rain_days_10mm, 0) as rain_days_10mm,
    a.rain_days_20mm + coalesce(b.rain_days_20mm, 0) as rain_days_20mm,
    case when a.maximum_5day_rainfall < b.maximum_5day_rainfall then b.maximum_5day_rainfall else a.maximum_5day_rainfall end as maximum_5day_rainfall,
    case when a.false_onset_flag < b.false_onset_flag then b.false_onset_flag else a.false_onset_flag end as false_onset_flag,
    case when a.season_onset_day is null then null when b.season_onset_day < a.season_onset_day then b.season_onset_day else a.season_onset_day end as season_onset_day,
    case when a.season_cessation_day is null then null when b.season_cessation_day > a.season_cessation_day then b.season_cessation_day else a.season_cessation_day end as season_cessation_day,
    case when a.season_cessation_day is not null and b.season_cessation_day > a.season_cessation_day then b.season_cessation_day else a.season_cessation_day end
      - case when a.season_onset_day is not null and b.season_onset_day < a.season_onset_day then b.season_onset_day else a.season_onset_day end + 1 as season_length_days,
    round((a.mean_wet_day_rainfall * a.rain_days_1mm + b.mean_wet_day_rainfall * b.rain_days_1mm) / nullif(a.rain_days_1mm + b.rain_days_1mm, 0), 6) as mean_wet_day_rainfall
    from (select * from older_features where season = 'first') a left join (select * from older_features where season = 'second') b using (district, year)""",
    "daily", extra=OLDER_CTES))
def first_second_total(spark, d):
    return rounded(agg.first_and_second_total(rounded(series.older_rainfall_features(I.daily(spark, d)))), 6)


@query("c10_seasons_side_by_side", "B3 C10", sql(
    """select y.district, y.year, y.days, a.season_total_mm as first_season_total_mm, a.rain_days_1mm as first_rain_days_1mm,
    b.season_total_mm as second_season_total_mm, b.rain_days_1mm as second_rain_days_1mm
    from (select district, cast(year(date) as integer) as year, count(*) as days from daily group by all) y
    left join (select * from older_features where season = 'first') a using (district, year)
    left join (select * from older_features where season = 'second') b using (district, year)""", "daily", extra=OLDER_CTES))
def side_by_side(spark, d):
    from ..operators.joins import seasons_side_by_side

    daily = I.daily(spark, d)
    yearly = daily.groupBy("district", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("days"))
    rain = rounded(series.older_rainfall_features(daily)).select(*DKEY, "season_total_mm", "rain_days_1mm")
    return seasons_side_by_side(yearly, rain, ["district", "year"])


@query("e01_run_groups", "E1", sql(
    f"select {DK}, run_id, any_value(dry) as dry, count(*) as days, min(date) as first_day from (select *, sum(chg) over (partition by {DK} order by date) as run_id from (select *, case when dry is distinct from lag(dry) over (partition by {DK} order by date) then 1 else 0 end as chg from flagged)) group by {DK}, run_id",
    "daily", extra={**OLDER_DAYS, **OLDER_RUNS}))
def run_groups(spark, d):
    runs = series.run_groups(older_days(spark, d), F.col("rain_mm") < 1.0, DKEY)
    return runs.groupBy(*DKEY, "run_id").agg(F.first("flag").alias("dry"), F.count(F.lit(1)).alias("days"), F.min("date").alias("first_day"))


@query("e03_run_list", "E3", sql(
    f"select {DK}, cast(first_rn - 1 as integer) as start_index, start_date, len as run_length from dry_runs", "daily", extra={**OLDER_DAYS, **OLDER_RUNS}))
def run_list(spark, d):
    return series.run_list(older_days(spark, d), F.col("rain_mm") < 1.0, DKEY)


@query("e04_longest_and_long_runs", "E2 E4", sql(
    f"""select {DK}, cast(coalesce(max(len), 0) as integer) as longest_run, count(len) filter (len >= 7) as runs_7, count(len) filter (len >= 10) as runs_10
    from (select distinct {DK} from older_days) left join dry_runs using ({DK}) group by all""", "daily", extra={**OLDER_DAYS, **OLDER_RUNS}))
def long_runs(spark, d):
    rows, dry = older_days(spark, d), F.col("rain_mm") < 1.0
    return series.longest_run(rows, dry, DKEY).join(series.count_runs(rows, dry, DKEY), DKEY)


@query("e05_rolling_maximum", "E5", sql(
    f"select {DK}, round(max(five), 8) as maximum_rolling_sum from flagged group by all", "daily", extra={**OLDER_DAYS, **OLDER_RUNS}))
def rolling_maximum(spark, d):
    return rounded(series.maximum_rolling_sum(older_days(spark, d), "rain_mm", DKEY))


@query("e12_heatwaves", "E12", sql(
    f"select {DK}, coalesce(any_value(heatwave_count), 0) as heatwave_count from (select distinct {DK} from hot) left join waves using ({DK}) group by all",
    "daily", extra=HOT_RUNS))
def heatwaves(spark, d):
    return series.heatwave_count(older_days(spark, d), DKEY)


@query("e13_centred_and_anomaly", "E13 B30", sql(
    """select district, year, month, round(rainfall_mm - avg(rainfall_mm) over (partition by district), 8) as rainfall_mm_anomaly,
    round(rainfall_mm - avg(rainfall_mm) over (partition by district, year), 8) as centred from monthly""", "monthly"))
def centred(spark, d):
    m = series.anomalies(I.monthly(spark, d), ["rainfall_mm"], ["district"])
    return rounded(m.select("district", "year", "month", "rainfall_mm_anomaly", series.centred("rainfall_mm", ["district", "year"]).alias("centred")))


@query("e14_cumulative_share", "E14", sql(
    """select p_size, round(v / sum(v) over (), 8) as share, round(sum(v) over (order by p_size) / sum(v) over (), 8) as cumulative_share
    from (select p_size, sum(l_quantity) as v from lineitem join part on l_partkey = p_partkey group by 1)"""))
def cumulative_share(spark, d):
    li, part = I.scan(spark, d, "lineitem"), I.scan(spark, d, "part")
    pre = li.groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    v = pre.join(part, pre.l_partkey == part.p_partkey).groupBy("p_size").agg(F.sum("q").alias("v"))
    return rounded(series.cumulative_share(v, "v", "p_size")).select("p_size", "share", "cumulative_share")


@query("e16_season_calendar", "E16", sql("select * from region_calendar", "region_calendar"))
def season_calendar(spark, d):
    return I.region_calendar(spark, d)


@query("e15_shifted_calendars", "E15", sql(
    """select spatial_unit, year, season, s.shift_days, start_date + cast(s.shift_days as integer) as start_date, end_date + cast(s.shift_days as integer) as end_date
    from region_calendar, (values (-14), (0), (14)) s(shift_days)""", "region_calendar"))
def shifted(spark, d):
    return calendar.shifted_calendars(I.region_calendar(spark, d))


@query("m21_season_window_sensitivity", "M21", sql(
    """select shift_days, count(*) as windows, round(avg(total), 8) as mean_rain_total_mm from (
      select c.district, c.year, c.season, s.shift_days, sum(coalesce(rain_mm, 0)) as total from district_calendar c, (values (-14), (0), (14)) s(shift_days), daily d
      where d.district = c.district and d.date between c.start_date + cast(s.shift_days as integer) and c.end_date + cast(s.shift_days as integer) group by all) group by all""",
    "daily", "district_calendar"))
def window_sensitivity(spark, d):
    from ..operators.diagnostics import season_window_sensitivity

    cal = calendar.shifted_calendars(I.district_calendar(spark, d))
    days = I.daily(spark, d).withColumnRenamed("district", "spatial_unit")
    return rounded(season_window_sensitivity(days, cal))


CLIM = """select district, sum(m) as clim_annual_mean, sqrt(sum(v)) as clim_annual_std,
  sum(case when month in (3, 4, 5) then m end) as clim_MAM_mean, sqrt(sum(case when month in (3, 4, 5) then v end)) as clim_MAM_std,
  sum(case when month in (9, 10, 11) then m end) as clim_SON_mean, sqrt(sum(case when month in (9, 10, 11) then v end)) as clim_SON_std,
  sum(case when month in (12, 1, 2) then m end) as clim_DJF_mean, sqrt(sum(case when month in (12, 1, 2) then v end)) as clim_DJF_std,
  sum(case when month in (6, 7, 8) then m end) as clim_JJA_mean, sqrt(sum(case when month in (6, 7, 8) then v end)) as clim_JJA_std
  from (select district, month, avg(rainfall_mm) as m, var_samp(rainfall_mm) as v from monthly where year between 1995 and 1998 group by all) group by all"""
MONTHLY_FEATURES = """select district, year, {seasons}, sum(rainfall_mm) as annual_rainfall,
  case when avg(rainfall_mm) > 0 then stddev_samp(rainfall_mm) / avg(rainfall_mm) else 0 end as rain_cv, max(rainfall_mm) as max_monthly, min(rainfall_mm) as min_monthly,
  count(*) filter (rainfall_mm {op} 50) as rainy_months from monthly group by district, year"""
SEASON_SUMS = ", ".join(
    f"coalesce(sum(rainfall_mm) filter (month in {m}), 0) as {s}"
    for s, m in (("MAM", "(3, 4, 5)"), ("SON", "(9, 10, 11)"), ("DJF", "(12, 1, 2)"), ("JJA", "(6, 7, 8)"))
)
MF = MONTHLY_FEATURES.format(seasons=SEASON_SUMS, op=">=")


@query("d10_monthly_rain_features", "D10", sql(f"select * replace (round(rain_cv, 8) as rain_cv) from ({MF})", "monthly"))
def monthly_features(spark, d):
    return rounded(agg.monthly_rain_features(I.monthly(spark, d)))


@query("d11_pivoted_rain_features", "D11 I1", sql(
    f"select * replace (round(rain_cv, 8) as rain_cv) from ({MONTHLY_FEATURES.format(seasons=SEASON_SUMS, op='>')})", "monthly"))
def pivoted_features(spark, d):
    return rounded(agg.pivoted_rain_features(I.monthly(spark, d)))


@query("d12_climatology", "D12", sql("select district, " + ", ".join(
    f"round(clim_{s}_{k}, 8) as clim_{s}_{k}" for s in ("annual", "MAM", "SON", "DJF", "JJA") for k in ("mean", "std")) + " from clim", "monthly", extra={"clim": CLIM}))
def climatology(spark, d):
    return rounded(agg.climatology(I.monthly(spark, d), (1995, 1998)))


@query("d13_climate_anomalies", "D13 C9", sql(
    "select district, year, round(annual_rainfall - clim_annual_mean, 8) as rainfall_anomaly, round((annual_rainfall - clim_annual_mean) / nullif(clim_annual_std, 0), 8) as rainfall_zscore, "
    + ", ".join(f"round({s} - clim_{s}_mean, 8) as {s}_anomaly, round(({s} - clim_{s}_mean) / nullif(clim_{s}_std, 0), 8) as {s}_zscore" for s in ("MAM", "SON", "DJF", "JJA"))
    + " from mf left join clim using (district) where year >= 1999", "monthly", extra={"clim": CLIM, "mf": MF}))
def climate_anomalies(spark, d):
    m = I.monthly(spark, d)
    features = agg.monthly_rain_features(m).filter("year >= 1999")
    out = agg.climate_anomalies(features, agg.climatology(m, (1995, 1998)))
    return rounded(out.select("district", "year", *[c for c in out.columns if c.endswith(("_anomaly", "_zscore"))]))


@query("d29_month_sums", "D29", sql(
    "select district, cast(date_trunc('month', date) as date) as month_start, round(sum(rain_mm), 8) as rainfall_mm from daily group by all", "daily"))
def month_sums(spark, d):
    return rounded(agg.month_sums(I.daily(spark, d), ["district"]))


GROUP_CASE = "case when month(date) in (3,4,5) then 'MAM' when month(date) in (9,10,11) then 'SON' when month(date) in (12,1,2) then 'DJF' else 'JJA' end"
SEASONS = ("MAM", "SON", "DJF", "JJA")


def season_columns(measures: dict[str, str]) -> str:
    """measure -> aggregate over a {f} filter."""
    return ", ".join(f"round({sql_text.format(f=f's = {chr(39)}{s}{chr(39)}')}, 8) as {s}_{name}" for s in SEASONS for name, sql_text in measures.items())


@query("d16_daily_temperature_by_season", "D16 I3", sql(
    "select district, year, " + season_columns({
        "tmax_mean": "avg(tmax_c) filter ({f})", "tmin_mean": "avg(tmin_c) filter ({f})", "tmean_mean": "avg(mean) filter ({f})",
        "gdd_total": "case when count(*) filter ({f}) > 0 then coalesce(sum(gdd) filter ({f}), 0) end",
    }) + ", " + ", ".join(
        f"case when count(*) filter (s = '{s}') > 0 then count(*) filter (s = '{s}' and tmax_c > 35) end as {s}_heat_stress_days, case when count(*) filter (s = '{s}') > 0 then count(*) filter (s = '{s}' and tmin_c < 5) end as {s}_cold_stress_days"
        for s in SEASONS) + """,
    round(avg(tmax_c), 8) as annual_tmax_mean, round(avg(tmin_c), 8) as annual_tmin_mean, round(avg(mean), 8) as annual_tmean_mean, round(coalesce(sum(gdd), 0), 8) as annual_gdd,
    count(*) filter (tmax_c > 35) as annual_heat_stress, count(*) filter (tmin_c < 5) as annual_cold_stress, count(*) filter (gdd > 0) as growing_season_length
    from (select *, cast(year(date) as integer) as year, """ + GROUP_CASE + """ as s, (tmax_c + tmin_c) / 2 as mean,
      case when tmax_c is not null and tmin_c is not null then greatest((tmax_c + tmin_c) / 2 - 10, 0) end as gdd from daily) group by district, year""", "daily"))
def daily_temperature(spark, d):
    return rounded(agg.daily_temperature_by_month_group(I.daily(spark, d)))


@query("d17_monthly_temperature_features", "D17 J8 J9", sql(
    "select district, year, " + season_columns({"tmean_mean": "avg(c) filter ({f})", "gdd_total": "sum(gdd) filter ({f})"}) + ", " + ", ".join(
        f"case when count(*) filter (s = '{s}') > 0 then count(*) filter (s = '{s}' and c > 35) end as {s}_heat_stress_months, case when count(*) filter (s = '{s}') > 0 then count(*) filter (s = '{s}' and c < 5) end as {s}_cold_stress_months"
        for s in SEASONS) + """,
    round(avg(c), 8) as annual_tmean, round(sum(gdd), 8) as annual_gdd, count(*) filter (c > 35) as annual_heat_stress, count(*) filter (c < 5) as annual_cold_stress,
    count(*) filter (gdd > 0) as growing_months
    from (select *, greatest(c - 10, 0) * day(last_day(date)) as gdd from (select district, cast(year(date) as integer) as year, date_trunc('month', date)::date as date, """ + GROUP_CASE + """ as s, k - 273.15 as c
      from (select district, date_trunc('month', date)::date as date, round(avg(tmax_c) + 273.15 - 20, 4) as k from daily group by all))) group by district, year""", "daily"))
def monthly_temperature(spark, d):
    daily = I.daily(spark, d)
    months = daily.groupBy("district", F.trunc("date", "month").alias("month_start")).agg(F.round(F.avg("tmax_c") + 273.15 - 20, 4).alias("t_mean_k"))
    return rounded(agg.monthly_temperature_features(months))


@query("d18_soil_moisture_features", "D18 J7", sql(
    "select district, year, " + season_columns({v: f"avg({v}) filter ({{f}})" for v in agg.SOIL_MOISTURE_LAYERS}) + ", "
    + ", ".join(f"round(avg({v}), 8) as annual_{v}" for v in [*agg.SOIL_MOISTURE_LAYERS, "surface_nobs", "rzsm_1m_nobs"]) + ", "
    + ", ".join(f"round(case when avg({v}) <> 0 then stddev_samp({v}) / avg({v}) when avg({v}) = 0 then 0 end, 8) as {v}_cv, min({v}) as min_{v}, max({v}) as max_{v}" for v in ("surface_sm", "rzsm_1m"))
    + """, round(avg(rzsm_1m), 8) as soil_moisture_index from sm group by district, year""", "monthly", extra={"sm": """select 'S' || l_suppkey as district, cast(year(l_shipdate) as integer) as year, cast(month(l_shipdate) as integer) as month,
      case when month(l_shipdate) in (3,4,5) then 'MAM' when month(l_shipdate) in (9,10,11) then 'SON' when month(l_shipdate) in (12,1,2) then 'DJF' else 'JJA' end as s,
      max(l_quantity) / 100 as surface_sm, min(l_quantity) / 100 as rzsm_1m, max(l_discount) as rzsm_1, min(l_discount) as rzsm_2, max(l_tax) as rzsm_3,
      cast(count(*) as double) as surface_nobs, cast(max(l_linenumber) as double) as rzsm_1m_nobs from lineitem group by all"""}))
def soil_moisture(spark, d):
    li = I.scan(spark, d, "lineitem")
    day = F.to_date("l_shipdate")
    m = li.groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("district"), F.year(day).alias("year"), F.month(day).alias("month")).agg(
        (F.max("l_quantity") / 100).alias("surface_sm"), (F.min("l_quantity") / 100).alias("rzsm_1m"), F.max("l_discount").alias("rzsm_1"),
        F.min("l_discount").alias("rzsm_2"), F.max("l_tax").alias("rzsm_3"), F.count(F.lit(1)).cast("double").alias("surface_nobs"),
        F.max("l_linenumber").cast("double").alias("rzsm_1m_nobs"))
    return rounded(agg.soil_moisture_features(m))


REGION_DAYS = {
    "region_day": """select sub_region as spatial_unit, date, avg(rain_mm) as rain_mm, avg(tmax_c) as tmax_c, avg(tmin_c) as tmin_c
  from daily join members using (district) group by 1, 2""",
    "season_days": """select c.spatial_unit, c.year, c.season, d.date, d.rain_mm, d.tmax_c, d.tmin_c
  from region_day d join region_calendar c on d.spatial_unit = c.spatial_unit and d.date between c.start_date and c.end_date""",
}
REGION_RAIN = rain_feature_sql("season_days", "spatial_unit, year, season", REGION_DAYS, "daily", "members", "region_calendar")
REGION_TEMP = sql(TEMP_SQL, "daily", "members", "region_calendar", extra=REGION_DAYS)
CLIMATE_SQL = f"""select *, 'daily_rainfall' as rainfall_source, 'daily_temperature' as temperature_source from ({REGION_RAIN}) full join ({REGION_TEMP}) using (spatial_unit, year, season)"""


def region_climate(spark, d):
    daily = I.daily(spark, d)
    return seasonal_climate(daily.select("district", "date", "rain_mm"), daily.drop("rain_mm"), I.members(spark, d), I.region_calendar(spark, d))


@query("c04_panel_climate", "C3 C4 D1 C1 D4 D6", CLIMATE_SQL)
def panel_climate(spark, d):
    return rounded(region_climate(spark, d))


@query("c05_final_panel", "B13 B14 C5 C6 C9 D20", sql(
    """select t.spatial_unit, t.year, t.season, t.crop, 'seasonal' as target_temporal_granularity, round(t.yield_tons_ha, 8) as yield_tons_ha, c.rain_total_mm, c.longest_dry_spell_days,
    c.onset_day_of_year, c.temperature_mean_c, c.heat_days_32c, s.soil_ph, s.soil_district_count, cast(null as double) as elevation_m, 'not_available' as elevation_source, '1' as data_version
    from targets t left join climate c on t.spatial_unit = c.spatial_unit and t.year = c.year and t.season = c.season
    left join (select sub_region as spatial_unit, round(avg(s_acctbal), 8) as soil_ph, count(*) as soil_district_count from members join supplier on district = 'S' || s_suppkey group by 1) s on s.spatial_unit = t.spatial_unit""",
    "targets", "members", extra={"climate": CLIMATE_SQL}))
def final_panel(spark, d):
    from ..plans.panel import final_panel as build

    m = I.members(spark, d)
    soil = I.scan(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("district"), F.col("s_acctbal").alias("phh2o"))
    static = agg.region_soil(soil, m, renames={"phh2o": "soil_ph"}).drop("soil_ph_sd")
    panel = build(I.targets(spark, d), region_climate(spark, d), static)
    keep = ["spatial_unit", "year", "season", "crop", "target_temporal_granularity", "yield_tons_ha", "rain_total_mm", "longest_dry_spell_days", "onset_day_of_year",
            "temperature_mean_c", "heat_days_32c", "soil_ph", "soil_district_count", "elevation_m", "elevation_source", "data_version"]
    return rounded(panel.select(*keep))


@query("j07_month_groups", "J7 J8", sql(
    f"select {GROUP_CASE} as season, cast(day(last_day(date)) as integer) as days_in_month, count(*) as days from daily group by all", "daily"))
def month_groups(spark, d):
    from ..functions.scalars import days_in_month

    return I.daily(spark, d).groupBy(month_group(F.month("date")).alias("season"), days_in_month("date").alias("days_in_month")).agg(F.count(F.lit(1)).alias("days"))
