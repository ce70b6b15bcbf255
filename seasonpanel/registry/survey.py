"""Queries over survey targets: cleaning, flags, unions, selections, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..checks import duplicate_keys
from ..functions import scalars as S
from ..operators import agg, clean, joins, quality, ranks, sets
from . import inputs as I
from .base import query
from .inputs import exact_sum, r, rounded, sql

PK = "spatial_unit, year, season, crop"
ROUND_T = "round(yield_tons_ha, 8) as yield_tons_ha"

RAW_SURVEY = {
    "raw_survey": """select ' ' || upper(crop) || ' ' as crop, sub_region, case when year = 2000 and season = 'first_season' then 'first_season_2020'
      when year = 2000 then 'second_season_2020' else 'total_2020' end as season_group,
      cast(area_planted_ha as varchar) as area_planted_ha, case when production_mt > 500 then cast(area_harvested_ha as varchar) else 'n/a' end as area_harvested_ha,
      production_mt, cv_area_planted_pct, cv_area_harvested_pct, cv_production_pct from survey where year >= 2000"""
}


def raw_survey(spark, d):
    """Survey rows as they come from a sheet: padded labels, numbers as text, totals mixed in."""
    s = I.survey(spark, d).filter("year >= 2000")
    block = F.when(F.col("year") == 2000, F.concat(F.col("season"), F.lit("_2020"))).otherwise("total_2020")
    return s.select(
        F.concat(F.lit(" "), F.upper("crop"), F.lit(" ")).alias("crop"), "sub_region", block.alias("season_group"),
        F.col("area_planted_ha").cast("string").alias("area_planted_ha"),
        F.when(F.col("production_mt") > 500, F.col("area_harvested_ha").cast("string")).otherwise("n/a").alias("area_harvested_ha"),
        "production_mt", "cv_area_planted_pct", "cv_area_harvested_pct", "cv_production_pct",
    )


@query("b04_seasonal_targets", "A1 B4 B5 B8 B9 B11 J11", sql(
    """select sub_region as spatial_unit, 2020 as year, replace(season_group, '_2020', '') as season, trim(lower(crop)) as crop,
    round(production_mt / h, 8) as yield_tons_ha, round(production_mt / p, 8) as yield_tons_ha_planted, round(h / p, 8) as harvested_fraction,
    round(p, 8) as area_planted_ha, round(h, 8) as area_harvested_ha, round(production_mt, 8) as production_mt, cv_area_planted_pct, cv_area_harvested_pct, cv_production_pct,
    'survey_2020' as target_source, 'official_aggregate' as target_source_type, 'sub_region' as target_geographic_level, 'sub_region' as predictor_geographic_level,
    'production_mt_divided_by_area_harvested_ha' as target_definition, 2020 as target_year, replace(season_group, '_2020', '') as target_season,
    false as is_proxy, false as is_synthetic, false as is_geographically_assigned, 'surveyed_seasonal_block' as season_definition, true as yield_consistency_ok
    from (select *, try_cast(area_harvested_ha as double) as h, try_cast(area_planted_ha as double) as p from raw_survey)
    where season_group not like 'total%' and sub_region <> 'NATION_3' and h > 0 and production_mt is not null""", "survey", extra=RAW_SURVEY))
def seasonal_targets(spark, d):
    return rounded(clean.seasonal_targets(raw_survey(spark, d), 2020, "survey_2020", national="NATION_3", strict=False))


@query("h01_combined_targets", "B6 B7 B13 H1 H2", sql(
    f"""select {PK}, case when season = 'annual' then 'annual' else 'seasonal' end as target_temporal_granularity, {ROUND_T}, yield_consistency_ok from (
      select spatial_unit, year, season, crop, yield_tons_ha, true as yield_consistency_ok from targets where year between 1999 and 2000 and crop in ('promo', 'small')
      union all select sub_region, 1998, 'annual', crop, 1.5 + sum(area_planted_ha) / 1000, false from survey where year = 1998 and crop in ('promo', 'small') group by 1, crop having sum(area_harvested_ha) > 0)""",
    "targets", "survey"))
def combined_targets(spark, d):
    seasonal = clean.year_window(clean.keep_members(I.targets(spark, d), "crop", ["promo", "small"]), 1999, 2000)
    s = I.survey(spark, d).filter("year = 1998")
    yearly = s.groupBy("crop", "sub_region").agg(
        *[F.sum(c).alias(c) for c in ("area_planted_ha", "area_harvested_ha", "production_mt")],
        F.lit(None).cast("double").alias("cv_production_pct"), (1.5 + F.sum("area_planted_ha") / 1000).alias("yield_over_harvested"))
    annual = clean.annual_targets(yearly, 1998, "annual_survey", crops=["PROMO", "Small"])
    both = sets.stack_tables([seasonal.withColumn("yield_consistency_ok", F.lit(True)), annual], allow_missing=True)
    both = both.withColumn("target_temporal_granularity", clean.granularity())
    return rounded(both.select(*K.PANEL_KEY, "target_temporal_granularity", "yield_tons_ha", "yield_consistency_ok"))


@query("b10_harvest_loss", "B10 B2 B1", sql(
    "select crop, sub_region as region, year, season, round(1 - area_harvested_ha / nullif(area_planted_ha, 0), 8) as harvest_loss from survey", "survey"))
def harvest_loss(spark, d):
    s = I.survey(spark, d).withColumnsRenamed({"sub_region": "region"}).withColumn("harvest_loss", clean.harvest_loss())
    return rounded(clean.keep_columns(s, ["crop", "region", "year", "season"], ["harvest_loss", "not_there"]))


@query("b08_unmapped_labels", "B8", sql("select distinct p_type from part where p_type not in ('PROMO', 'SMALL', 'LARGE')"))
def unmapped(spark, d):
    return clean.unmapped_values(I.scan(spark, d, "part"), "p_type", {"PROMO": 1, "SMALL": 2, "LARGE": 3})


@query("b16_override_with_source", "B16", sql(
    f"""select {PK}, round(coalesce(case when area_planted_ha > 400 then production_mt / area_planted_ha end, yield_tons_ha), 8) as yield_tons_ha,
    round(yield_tons_ha, 8) as original_yield_tons_ha, case when area_planted_ha > 400 then 'survey' else 'model' end as yield_tons_ha_source from targets""", "targets"))
def override(spark, d):
    t = I.targets(spark, d).withColumn("other", F.when(F.col("area_planted_ha") > 400, F.col("production_mt") / F.col("area_planted_ha")))
    out = t.withColumns(clean.override_with_source("yield_tons_ha", "other", "survey", "model"))
    return rounded(out.select(*K.PANEL_KEY, "yield_tons_ha", "original_yield_tons_ha", "yield_tons_ha_source"))


@query("b17_repair_numbers", "B17", sql(
    f"""select {PK}, round(case when junk then production_mt / area_harvested_ha else try_cast(raw as double) end, 8) as yield_over_harvested, junk as is_imputed,
    case when junk then 'C' else 'A' end as data_quality_score, case when junk then 'recomputed from totals' else '' end as data_quality_note
    from (select *, raw is not null and try_cast(raw as double) is null as junk from (select *, case when year = 1997 then '#REF' || crop when year = 1998 then null else cast(cast(area_planted_ha as integer) as varchar) end as raw from targets))""", "targets"))
def repair(spark, d):
    raw = F.when(F.col("year") == 1997, F.concat(F.lit("#REF"), F.col("crop"))).when(F.col("year") != 1998, F.col("area_planted_ha").cast("int").cast("string"))
    out = clean.repair_numbers(I.targets(spark, d).withColumn("raw", raw), "raw", "production_mt", "area_harvested_ha")
    return rounded(out.select(*K.PANEL_KEY, "yield_over_harvested", "is_imputed", "data_quality_score", "data_quality_note"))


@query("b18_reliability", "B18 B19", sql(
    f"""select {PK}, cv_production_pct as target_cv, round(case when cv_production_pct = 0 then 10 when cv_production_pct is not null then least(100 / cv_production_pct, 10) end, 8) as target_reliability_weight,
    case when cv_production_pct >= 30 then 1 else 0 end as high_uncertainty_flag,
    coalesce(production_mt / area_harvested_ha = 0 or abs(production_mt / area_harvested_ha - pub) <= 0.02 * abs(pub), false) as yield_consistency_ok
    from (select *, case when crop <> 'medium' then floor(yield_tons_ha * 20) / 20 end as pub from targets)""", "targets"))
def reliability(spark, d):
    t = I.targets(spark, d).withColumn("yield_over_harvested", F.when(F.col("crop") != "medium", F.floor(F.col("yield_tons_ha") * 20) / 20))
    out = clean.reliability(t)
    return rounded(out.select(*K.PANEL_KEY, "target_cv", "target_reliability_weight", "high_uncertainty_flag", "yield_consistency_ok"))


@query("b20_certain_targets", "B20 M29", sql(
    "select crop, count(*) as total_rows, count(*) filter (cv_production_pct <= 15) as kept, count(*) - count(*) filter (cv_production_pct <= 15) as dropped, round(1 - count(*) filter (cv_production_pct <= 15) * 1.0 / count(*), 8) as dropped_fraction from targets group by crop", "targets"))
def certain(spark, d):
    from ..operators.diagnostics import uncertainty_retention

    return rounded(uncertainty_retention(I.targets(spark, d), maximum=15.0, groups=["crop"]))


@query("b20_certain_rows", "B20", sql("select crop, year, count(*) as rows, round(max(cv_production_pct), 8) as largest from targets where cv_production_pct <= 15 group by all", "targets"))
def certain_rows(spark, d):
    kept = clean.certain_targets(I.targets(spark, d), maximum=15.0)
    return rounded(kept.groupBy("crop", "year").agg(F.count(F.lit(1)).alias("rows"), F.max("cv_production_pct").alias("largest")))


@query("b21_quality_band", "B21", sql(
    """select quality_band, count(*) as n from (select case when w is null then null when w <= 15 then 'higher_precision' when w <= 30 then 'moderate_precision' when w <= 50 then 'low_precision' else 'very_low_precision' end as quality_band
    from (select greatest(cv_area_harvested_pct, cv_production_pct) as w from survey)) group by 1""", "survey"))
def band(spark, d):
    return I.survey(spark, d).groupBy(S.quality_band("cv_area_harvested_pct", "cv_production_pct").alias("quality_band")).agg(F.count(F.lit(1)).alias("n"))


@query("b22_vegetation_qualifier", "B22", sql(
    """select o_orderkey, case when o_orderdate::date <= d then 'pre_harvest' else 'retrospective' end as feature_timing, try_cast(o_orderpriority as double) as ndvi_mean
    from (select *, case when o_orderstatus <> 'P' then cast('1998-06-01' as date) end as d from orders)"""))
def vegetation(spark, d):
    o = I.scan(spark, d, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("observation_date"), F.when(F.col("o_orderstatus") != "P", F.lit("1998-06-01").cast("date")).alias("harvest_date"),
        F.col("o_orderpriority").alias("ndvi_mean"))
    return clean.vegetation_qualifier(o).select("o_orderkey", "feature_timing", "ndvi_mean")


GRADE = "case {c} when 'AAS2020_subregion' then 'A' when 'AAS2020_zardi' then 'B' when 'UBOS_station' then 'D' when 'synthetic_generator' then 'E' else 'F' end"


@query("b24_provenance", "B23 B24 D27", sql(
    f"""select "column", value, count(*) as "count" from (select unnest([{{'c': 'yield_source', 'v': ys}}, {{'c': 'rainfall_source', 'v': 'CHIRPS_v2.0_monthly'}}, {{'c': 'data_quality_score', 'v': {GRADE.format(c='ys')}}},
      {{'c': 'is_proxy', 'v': 'false'}}, {{'c': 'soil_source', 'v': null}}]) as p from (select coalesce(case p_type when 'PROMO' then 'AAS2020_zardi' when 'SMALL' then 'synthetic_generator' when 'LARGE' then 'unheard_of' when 'MEDIUM' then 'UBOS_station' end, 'AAS2020_subregion') as ys from part)) t,
      lateral (select p.c as "column", p.v as value) group by 1, 2"""))
def provenance(spark, d):
    source = F.col("p_type")
    ys = F.when(source == "PROMO", "AAS2020_zardi").when(source == "SMALL", "synthetic_generator").when(source == "LARGE", "unheard_of").when(source == "MEDIUM", "UBOS_station")
    p = I.scan(spark, d, "part").select("p_partkey", ys.alias("yield_source"))
    out = clean.add_provenance(p, {"yield_source": "AAS2020_subregion", "rainfall_source": "CHIRPS_v2.0_monthly"})
    return agg.value_counts(out, ["yield_source", "rainfall_source", "data_quality_score", "is_proxy", "soil_source"])


@query("b25_covered_predictors", "B25", sql(
    """select * from (select unnest(['cv_area_harvested_pct', 'cv_production_pct', 'area_planted_ha', 'crop', 'sparse']) as feature,
    round(unnest([avg(case when cv_area_harvested_pct is not null then 1.0 else 0 end), avg(case when cv_production_pct is not null then 1.0 else 0 end), 1.0, 0.0, avg(case when year = 1999 then 1.0 else 0 end)]), 8) as non_null_fraction from survey) where non_null_fraction >= 0.6""", "survey"))
def coverage(spark, d):
    s = I.survey(spark, d).select("cv_area_harvested_pct", "cv_production_pct", "area_planted_ha", "crop", F.when(F.col("year") == 1999, F.lit("3")).alias("sparse"))
    return rounded(clean.covered_predictors(s)[0])


@query("b26_complete_columns", "B26", sql(
    """select c as "column" from (select unnest(['crop', 'year', 'area_planted_ha', 'masked']) as c, unnest([count(*) - count(crop), count(*) - count(year), count(*) - count(area_planted_ha),
    count(*) - count(case when crop <> 'promo' then area_planted_ha end)]) as m from survey) where m = 0""", "survey"))
def complete_columns(spark, d):
    s = I.survey(spark, d).withColumn("masked", F.when(F.col("crop") != "promo", F.col("area_planted_ha")))
    return clean.complete_case_columns(s, ["crop", "year", "area_planted_ha", "masked", "not_there"])


@query("b32_complete_rows", "B32", sql(
    "select count(*) filter (tmin_c is not null and rain_mm is not null) as kept, count(*) filter (tmin_c is null or rain_mm is null) as dropped from daily", "daily"))
def complete_rows(spark, d):
    return clean.complete_rows(I.daily(spark, d), ["tmin_c", "rain_mm"])[1]


@query("b33_fill_from_lookup", "B33", sql(
    """select s_suppkey, coalesce(case when s_suppkey % 3 = 0 then s_acctbal end, case when n_nationkey < 20 then n_regionkey * 1.0 end) as lat,
    case when s_suppkey % 3 = 0 or n_nationkey < 20 then 'ok' else 'empty_values' end as lookup_status from supplier join nation on n_nationkey = s_nationkey"""))
def fill_lookup(spark, d):
    s = I.scan(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_acctbal")).alias("lat"))
    lookup = I.scan(spark, d, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("name"), F.col("n_regionkey").cast("double").alias("lat"))
    return clean.fill_from_lookup(s, lookup, "name", ["lat"]).select("s_suppkey", "lat", "lookup_status")


@query("b31_strip_provenance", "B31 B15", sql(
    "select s_suppkey, s_name, cast(null as double) as elevation_m, cast(s_nationkey as bigint) as s_nationkey from supplier"))
def strip_provenance(spark, d):
    s = I.scan(spark, d, "supplier").withColumns({"yield_source": F.lit("x"), "is_proxy": F.lit(False)})
    return clean.conform(clean.drop_provenance(s), {"s_suppkey": "bigint", "s_name": "string", "elevation_m": "double", "s_nationkey": "bigint"})


@query("b14_pinned_panel", "B13 B14 C5 C6", sql(
    f"""select {PK}, 'seasonal' as target_temporal_granularity, {ROUND_T}, area_planted_ha, area_harvested_ha, round(production_mt, 8) as production_mt, cv_production_pct,
    soil as soil_ph, cast(null as double) as elevation_m, cast(null as double) as elevation_m_sd, 'not_available' as elevation_source, 'v1' as data_version, 'p1' as processing_version
    from targets left join (select n_name as spatial_unit, round(avg(s_acctbal), 4) as soil from supplier join nation on n_nationkey = s_nationkey where s_nationkey < 20 group by 1) using (spatial_unit)""", "targets"))
def pinned_panel(spark, d):
    s, n = I.scan(spark, d, "supplier").filter("s_nationkey < 20"), I.scan(spark, d, "nation")
    soil = s.join(n, s.s_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("spatial_unit")).agg(F.round(F.avg("s_acctbal"), 4).alias("soil_ph"))
    panel = joins.attach_elevation(joins.attach_static(I.targets(spark, d), soil), None)
    return rounded(clean.pin_order(panel, "v1", "p1"))


@query("b29_wide_by_crop", "B29 C11", sql(
    """select spatial_unit, year, season, round(promo, 8) as promo, round(small, 8) as small, round(promo - small, 8) as promo_minus_small from
    (select spatial_unit, year, season, yield_tons_ha as promo from targets where crop = 'promo') join (select spatial_unit, year, season, yield_tons_ha as small from targets where crop = 'small') using (spatial_unit, year, season)""", "targets"))
def wide_by_crop(spark, d):
    wide = joins.wide_by_crop(I.targets(spark, d), ["promo", "small"], ["spatial_unit", "year", "season"])
    return rounded(clean.target_gaps(wide, ["promo", "small"]))


@query("a09_first_usable_source", "A9", sql(
    "select crop, sub_region, year, season, round(coalesce(a, b), 4) as v from (select *, case when year > 1999 then cv_production_pct end as a, cv_area_planted_pct as b from survey)", "survey"))
def first_source(spark, d):
    s = I.survey(spark, d)
    keys = ["crop", "sub_region", "year", "season"]
    first = joins.first_usable([s.select("crop"), s.select(*keys, F.when(F.col("year") > 1999, F.col("cv_production_pct")).alias("cv"))], keys, "v", ["cv"])
    second = s.select(*keys, F.col("cv_area_planted_pct").alias("v"))
    return rounded(joins.coalesce_sources(s.select(*keys), [first, second], keys, "v"), 4)


@query("c20_coalesce_join", "C20", sql(
    """select district, year, coalesce(a, b) as total, months from (select district, year, case when year <> 1997 then sum(rainfall_mm) end as a from monthly group by district, year)
    left join (select district, year, max(rainfall_mm) as b, count(*) as months from monthly where year >= 1997 group by all) using (district, year)""", "monthly"))
def coalesce_join(spark, d):
    m = I.monthly(spark, d)
    a = m.groupBy("district", "year").agg(F.when(F.col("year") != 1997, F.sum("rainfall_mm")).alias("total"))
    b = m.filter("year >= 1997").groupBy("district", "year").agg(F.max("rainfall_mm").alias("total"), F.count(F.lit(1)).alias("months"))
    return joins.coalesce_join(a, b, ["district", "year"])


@query("c07_region_means", "C7 D2", sql(
    "select sub_region, round(avg(s_acctbal), 8) as s_acctbal, round(avg(s_nationkey), 8) as s_nationkey from supplier left join (select 'S' || s_suppkey as k, 'G' || (s_suppkey % 7) as sub_region from supplier where s_suppkey % 7 < 6) on k = 'S' || s_suppkey where sub_region is not null group by 1"))
def region_means(spark, d):
    s = I.scan(spark, d, "supplier")
    region = s.filter("s_suppkey % 7 < 6").select("s_suppkey", F.concat(F.lit("G"), (F.col("s_suppkey") % 7).cast("string")).alias("sub_region"))
    return rounded(agg.group_means(s.join(region, "s_suppkey", "left"), ["sub_region"], exclude=["s_suppkey"]))


@query("c08_assign_to_members", "C8", sql(
    f"""select district, {PK}, round(yield_tons_ha, 8) as yield_tons_ha, s_acctbal as soil_ph, 'B' as data_quality_score from targets join members on sub_region = spatial_unit
    left join supplier on district = 'S' || s_suppkey""", "targets", "members"))
def assign(spark, d):
    panel = I.targets(spark, d).withColumns({"sub_region": F.col("spatial_unit"), "soil_ph": F.lit(0.0)})
    soil = I.scan(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("district"), F.col("s_acctbal").alias("soil_ph"))
    out = joins.assign_to_members(panel, I.members(spark, d), soil)
    return rounded(out.select("district", *K.PANEL_KEY, "yield_tons_ha", "soil_ph", "data_quality_score"))


@query("c12_latest_before", "C12", sql(
    f"""select spatial_unit, season, crop, year, round(arg_max(y, py), 8) as previous_value, max(py) as previous_value_year from (
    select t.spatial_unit, t.season, t.crop, t.year, p.yield_tons_ha as y, p.year as py from targets t left join targets p on p.spatial_unit = t.spatial_unit and p.crop = t.crop and p.season = t.season and p.year < t.year and p.year in (1995, 1997, 1998)
    where t.year >= 1997) group by all""", "targets"))
def latest_before(spark, d):
    t = I.targets(spark, d)
    out = joins.latest_before(t.filter("year >= 1997"), t.filter("year in (1995, 1997, 1998)"), ["spatial_unit", "crop", "season"])
    return rounded(out.select("spatial_unit", "season", "crop", "year", "previous_value", "previous_value_year"))


@query("c13_fallback_means", "C13", sql(
    f"""select {PK}, round(coalesce(a.m, b.m, c.m), 8) as prediction, case when a.m is not null then 'none' when b.m is not null then 'training_crop_mean' else 'training_global_mean' end as fallback_level, a.m is not null as applicable
    from (select * from targets where year >= 1999) t left join (select spatial_unit, crop, avg(yield_tons_ha) as m from tr group by all) a using (spatial_unit, crop)
    left join (select crop, avg(yield_tons_ha) as m from tr group by all) b using (crop), (select avg(yield_tons_ha) as m from tr) c""",
    "targets", extra={"tr": "select * from targets where year < 1999 and spatial_unit <> 'NATION_1' and crop <> 'promo'"}))
def fallback(spark, d):
    t = I.targets(spark, d)
    train = t.filter("year < 1999 and spatial_unit <> 'NATION_1' and crop <> 'promo'")
    out = joins.fallback_means(t.filter("year >= 1999"), train, ["spatial_unit", "crop"])
    return rounded(out.select(*K.PANEL_KEY, "prediction", "fallback_level", "applicable"))


@query("c14_previous_period", "C14", sql(
    """select spatial_unit, season, crop, round(coalesce(p, g), 8) as prediction from (select * from targets where year = 2001)
    left join (select spatial_unit, arg_min(yield_tons_ha, crop || season) as p from targets where year = 1999 and spatial_unit < 'NATION_2' group by 1) using (spatial_unit),
    (select avg(yield_tons_ha) as g from targets where year = 1999 and spatial_unit < 'NATION_2')""", "targets"))
def previous_period(spark, d):
    t = I.targets(spark, d).withColumn("seq", F.concat("crop", "season"))
    out = joins.previous_period(t, t.filter("spatial_unit < 'NATION_2'"), "spatial_unit", 2001, 1999, "yield_tons_ha", "seq")
    return rounded(out.select("spatial_unit", "season", "crop", "prediction"))


@query("c19_file_families", "C19", sql(
    "select c_name as left_path, s_name as right_path, regexp_extract(c_name, '#(.*)$', 1) as suffix from customer join supplier on regexp_extract(c_name, '#(.*)$', 1) = regexp_extract(s_name, '#(.*)$', 1)"))
def file_families(spark, d):
    a = I.scan(spark, d, "customer").select(F.col("c_name").alias("path"))
    b = I.scan(spark, d, "supplier").select(F.col("s_name").alias("path"))
    return joins.match_file_families(a, b, "#(.*)$")


@query("c21_outside_reference", "C21 H8 C18", sql("select distinct c_nationkey as k from customer where c_nationkey not in (select s_nationkey from supplier where s_suppkey < 20)"))
def outside(spark, d):
    c = I.scan(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    s = I.scan(spark, d, "supplier").filter("s_suppkey < 20").select(F.col("s_nationkey").alias("k"))
    return joins.outside_reference(c, s, "k")


@query("c23_two_key_join", "C23", sql(
    """select district, year, round(total, 8) as total, round(rain, 8) as rain from (select district, year, sum(rainfall_mm) as total from monthly group by all)
    join (select district, cast(year(date) as integer) as year, sum(rain_mm) as rain from daily group by all) using (district, year)""", "monthly", "daily"))
def two_key(spark, d):
    m = I.monthly(spark, d).groupBy("district", "year").agg(F.sum("rainfall_mm").alias("total"))
    y = I.daily(spark, d).groupBy("district", F.year("date").alias("year")).agg(F.sum("rain_mm").alias("rain"))
    return rounded(joins.two_key_join(m, y))


@query("c22_aligned_days", "C22", sql("select district, count(*) as days, round(sum(tmin_c), 8) as s from daily where rain_mm is not null and tmin_c is not null group by 1", "daily"))
def aligned(spark, d):
    daily = I.daily(spark, d)
    both = joins.aligned_days(daily.select("district", "date", "rain_mm"), daily.select("district", "date", "tmin_c"), ["district", "date"], ["rain_mm", "tmin_c"])
    return rounded(both.groupBy("district").agg(F.count(F.lit(1)).alias("days"), F.sum("tmin_c").alias("s")))


HOUSE = """select l_orderkey as household_id, l_suppkey as district, cast(year(l_shipdate) as integer) as year, l_partkey % 3 as crop_code, l_extendedprice as production_kg, l_quantity / 10 as area_harvested_ha from lineitem"""


@query("d09_household_summary", "A8 B12 D9", sql(
    """select district, year, round(avg(y), 10) as mean_yield, count(distinct household_id) as households, round(sum(area_harvested_ha), 4) as total_area_ha, round(sum(production_kg), 2) as total_production_kg,
    round(sum(production_kg) / (sum(area_harvested_ha) * 1000), 12) as weighted_yield from (select *, production_kg / (area_harvested_ha * 1000) as y from h) where y > 10 and y < 19 and crop_code = 1 group by all""", extra={"h": HOUSE}))
def household(spark, d):
    li = I.scan(spark, d, "lineitem").filter("l_partkey % 3 = 1").select(
        F.col("l_orderkey").alias("household_id"), F.col("l_suppkey").alias("district"), F.year("l_shipdate").alias("year"),
        F.col("l_extendedprice").alias("production_kg"), (F.col("l_quantity") / 10).alias("area_harvested_ha"))
    out = agg.household_summary(li, ["district", "year"], 10.0, 19.0)
    return out.withColumns({"mean_yield": r("mean_yield", 10), "weighted_yield": r("weighted_yield", 12), "total_area_ha": r("total_area_ha", 4), "total_production_kg": r("total_production_kg", 2)})


@query("d22_panel_summary", "D22", sql(
    "select year, season, count(distinct spatial_unit) as units, count(*) as rows, count(distinct crop) as crops, round(avg(yield_tons_ha), 8) as mean_yield from targets group by all", "targets"))
def panel_summary(spark, d):
    return rounded(agg.panel_summary(I.targets(spark, d)))


@query("d23_national_reconstruction", "D23", sql(
    """select crop, area_sum, round(production_sum, 5) as production_sum, area_printed, round(production_printed, 5) as production_printed, abs(area_sum - area_printed) <= abs(area_printed) * 0.005 and abs(production_sum - production_printed) <= abs(production_printed) * 0.005 as reconstructed from
    (select crop, sum(area_harvested_ha) as area_sum, sum(production_mt) as production_sum from survey group by 1) left join
    (select lower(p_type) as crop, sum(l_quantity) as area_printed, sum(l_extendedprice) / 1000 as production_printed from lineitem join part on l_partkey = p_partkey group by 1) using (crop)""", "survey"))
def reconstruction(spark, d):
    li, part = I.scan(spark, d, "lineitem"), I.scan(spark, d, "part")
    pre = li.groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"), exact_sum("l_extendedprice").alias("p"))
    printed = pre.join(part, pre.l_partkey == part.p_partkey).groupBy(F.lower("p_type").alias("crop")).agg(
        F.sum("q").alias("area_printed"), (F.sum("p") / 1000).alias("production_printed"))
    return rounded(agg.national_reconstruction(I.survey(spark, d), printed), 5)


@query("d24_plausibility", "D24", sql("select crop, round(min(yield_tons_ha), 8) as minimum, round(max(yield_tons_ha), 8) as maximum, count(*) as rows from targets group by 1", "targets"))
def plausibility(spark, d):
    return rounded(agg.plausibility(I.targets(spark, d)))


@query("d25_missingness", "D25", sql(
    """select unnest(['rain_mm', 'tmax_c', 'tmin_c']) as "column", unnest([count(*) - count(rain_mm), count(*) - count(tmax_c), count(*) - count(tmin_c)]) as missing_count,
    round(unnest([1 - count(rain_mm) / count(*), 1 - count(tmax_c) / count(*), 1 - count(tmin_c) / count(*)]), 8) as missing_fraction from daily""", "daily"))
def missingness(spark, d):
    return rounded(agg.missingness(I.daily(spark, d), ["rain_mm", "tmax_c", "tmin_c"]))


@query("d26_feature_availability", "D26 J12", sql(
    """select unnest(['rain_total', 'temp_low', 'other', 'soil_x', 'soil_moisture']) as feature, unnest([round(count(rain_mm) / count(*), 4), round(count(tmin_c) / count(*), 4), 1.0, 0.0, 0.0]) as coverage,
    unnest(['usable', 'usable', 'usable', 'unavailable', 'planned']) as status, unnest(['CHIRPS (monthly)', 'NASA POWER (daily)', 'derived', 'SoilGrids', 'generated / not yet integrated']) as source from daily""", "daily"))
def availability(spark, d):
    t = I.daily(spark, d).select(F.col("rain_mm").alias("rain_total"), F.col("tmin_c").alias("temp_low"), F.col("tmax_c").alias("other"), F.lit(None).cast("double").alias("soil_x"))
    return agg.feature_availability(t, t.columns, ["soil_moisture", "other"])


@query("d28_describe_by_group", "D28", sql(
    """select l_returnflag, l_linestatus, count(l_quantity) as "count", round(avg(l_quantity), 8) as mean, round(stddev_samp(l_quantity), 8) as std, min(l_quantity) as min, max(l_quantity) as max, quantile_cont(l_quantity, 0.5) as median from lineitem group by all"""))
def describe(spark, d):
    return rounded(agg.describe_by_group(I.scan(spark, d, "lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"]))


@query("d30_correlations", "D30", sql(
    """select "left", "right", round(case "left" || "right" when 'x1x1' then a when 'x1x2' then b when 'x1x3' then c when 'x2x2' then d when 'x2x3' then e else f end, 8) as correlation from
    (select corr(x1, x1) a, corr(x1, x2) b, corr(x1, x3) c, corr(x2, x2) d, corr(x2, x3) e, corr(x3, x3) f from vectors), (values ('x1','x1'), ('x1','x2'), ('x1','x3'), ('x2','x2'), ('x2','x3'), ('x3','x3')) p("left", "right")""", "vectors"))
def correlations(spark, d):
    return rounded(agg.correlation_pairs(I.vectors(spark, d), ["x1", "x2", "x3"]))


@query("d31_group_benchmark", "D31", sql(
    """select crop, model, r2, rmse, units, round(mean_yield, 8) as mean_yield, round(std_yield, 8) as std_yield, round(min_yield, 8) as min_yield, round(max_yield, 8) as max_yield from (select crop, model, round(r2, 8) as r2, round(rmse, 8) as rmse from
      (select *, row_number() over (partition by crop order by r2 desc, rmse) as k from (select crop, model, 1 - sum((observed_yield - predicted_yield)^2) / (count(*) * var_pop(observed_yield)) as r2, sqrt(avg((observed_yield - predicted_yield)^2)) as rmse from predictions group by all)) where k = 1)
    join (select crop, count(distinct spatial_unit) as units, avg(yield_tons_ha) as mean_yield, stddev_samp(yield_tons_ha) as std_yield, min(yield_tons_ha) as min_yield, max(yield_tons_ha) as max_yield from targets group by 1) using (crop)""", "predictions"))
def group_benchmark(spark, d):
    from ..operators.metrics import error_metrics

    p = I.predictions(spark, d)
    res = error_metrics(p, ["crop", "model"])
    return rounded(agg.benchmark_rows(res, I.targets(spark, d), unit="spatial_unit"))


# --- selections, duplicates, set operations ------------------------------------------
@query("h03_pooled_panel", "H3", sql(
    "select 'promo' as crop, spatial_unit, year, season, round(yield_tons_ha, 8) as yield_tons_ha, area_planted_ha from targets where crop = 'promo' union all select 'small', spatial_unit, year, season, round(yield_tons_ha, 8), null from targets where crop = 'small'", "targets"))
def pooled(spark, d):
    t = I.targets(spark, d)
    keep = ["spatial_unit", "year", "season", "yield_tons_ha"]
    return rounded(sets.pooled({"promo": t.filter("crop = 'promo'").select(*keep, "area_planted_ha"), "small": t.filter("crop = 'small'").select(*keep)}))


@query("h04_distinct_map", "H4", sql("select distinct s_suppkey as district, s_nationkey as sub_region from lineitem join supplier on s_suppkey = l_suppkey"))
def distinct_map(spark, d):
    li, s = I.scan(spark, d, "lineitem").select("l_suppkey").distinct(), I.scan(spark, d, "supplier")
    m = li.join(s, li.l_suppkey == s.s_suppkey).select(F.col("s_suppkey").alias("district"), F.col("s_nationkey").alias("sub_region"))
    return sets.distinct_map(m, ["district", "sub_region"], "district")


@query("h05_one_per_environment", "H5 M22", sql(
    "select spatial_unit, year, season, crop, round(yield_tons_ha, 8) as yield_tons_ha from (select *, row_number() over (partition by spatial_unit, year, season order by crop) as k from targets) where k = 1", "targets"))
def one_per_environment(spark, d):
    from ..operators.diagnostics import environment_rows

    return rounded(environment_rows(I.targets(spark, d)).select(*K.PANEL_KEY, "yield_tons_ha"))


@query("h06_duplicate_keys", "H6", sql("select l_orderkey, l_linenumber, count(*) as row_count from lineitem group by 1, 2 having count(*) > 1"))
def duplicates(spark, d):
    return duplicate_keys(I.scan(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("h07_conflict_check", "H7", sql(
    """select crop, year, value_count, lowest, highest, round(mean_value, 8) as mean_value, first_sheet, last_sheet, round((highest - lowest) / greatest(abs(highest), 1e-9), 8) as relative_spread,
    case when value_count = 1 then 'single' when (highest - lowest) / greatest(abs(highest), 1e-9) <= 0.005 then 'averaged' else 'conflict' end as status from
    (select crop, year, count(distinct v) as value_count, min(v) as lowest, max(v) as highest, list_avg(list_distinct(list(v))) as mean_value, min(sheet) as first_sheet, max(sheet) as last_sheet from v group by all)""",
    extra={"v": "select p_type as crop, p_size as year, 100000 + floor(p_retailprice / 10) * case when p_size % 5 = 0 then 100 else 1 end as v, p_brand as sheet from part"}))
def conflict(spark, d):
    p = I.scan(spark, d, "part")
    v = 100000 + F.floor(F.col("p_retailprice") / 10) * F.when(F.col("p_size") % 5 == 0, 100).otherwise(1)
    rows = p.select(F.col("p_type").alias("crop"), F.col("p_size").alias("year"), v.cast("double").alias("v"), F.col("p_brand").alias("sheet"))
    return rounded(sets.distinct_values(rows, ["crop", "year"], "v"))


@query("g04_top_k", "G1 G4", sql(
    "select n_name, p_type, rank, total from (select n_name, p_type, total, cast(row_number() over (partition by n_name order by total desc, p_type) as integer) as rank from (select n_name, p_type, sum(l_quantity) as total from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by all)) where rank <= 3"))
def topk(spark, d):
    s = I.survey(spark, d).groupBy(F.col("sub_region").alias("n_name"), F.upper("crop").alias("p_type")).agg(F.sum("area_planted_ha").alias("total"))
    return ranks.top_k(s, 3, [F.desc("total"), F.asc("p_type")], ["n_name"]).select("n_name", "p_type", "rank", "total")


@query("g05_best_per_group", "G2 G5", sql(
    "select crop, model, round(rmse, 8) as rmse, round(mae, 8) as mae from (select *, row_number() over (partition by crop order by rmse, mae) as k from (select crop, model, sqrt(avg((observed_yield - predicted_yield)^2)) as rmse, avg(abs(observed_yield - predicted_yield)) as mae from predictions group by all)) where k = 1", "predictions"))
def best(spark, d):
    from ..operators.metrics import error_metrics

    res = error_metrics(I.predictions(spark, d), ["crop", "model"]).select("crop", "model", "rmse", "mae")
    return rounded(sets.best_per_group(res, ["crop"], [F.col("rmse"), F.col("mae")]))


@query("g06_primary_results", "G6", sql(
    """select model, crop, round(sqrt(avg((observed_yield - predicted_yield)^2)), 8) as rmse, round(avg(abs(observed_yield - predicted_yield)), 8) as mae, null::varchar as target_scale, true as registered_primary_metric, 'overall' as result_scope
    from predictions where crop <> 'promo' and model = 'ridge' group by all""", "predictions"))
def primary(spark, d):
    from ..operators.metrics import error_metrics

    res = error_metrics(I.predictions(spark, d), ["crop", "model"]).select("model", "crop", "rmse", "mae")
    flagged = res.withColumns({
        "target_scale": F.lit(None).cast("string"), "registered_primary_metric": F.col("model") == "ridge",
        "result_scope": F.when(F.col("crop") == "promo", "per_crop").otherwise("overall")})
    return rounded(sets.primary_results(flagged))


@query("g03_sort_by_magnitude", "G3", sql("select vec_id, x1 from vectors", "vectors"))
def magnitude(spark, d):
    return sets.sort_by_magnitude(I.vectors(spark, d).select("vec_id", "x1"), "x1")


@query("h08_key_difference", "H8", sql("select distinct l_partkey as k from lineitem where l_returnflag = 'R' except select distinct l_partkey from lineitem where l_returnflag = 'A' and l_quantity > 40"))
def key_difference(spark, d):
    li = I.scan(spark, d, "lineitem").withColumnRenamed("l_partkey", "k")
    return sets.key_difference(li.filter("l_returnflag = 'R'"), li.filter("l_returnflag = 'A' and l_quantity > 40"), ["k"])


@query("i02_variable_pivot", "I2 I4", sql(
    """select l_suppkey, round(avg(l_quantity) filter (l_linestatus = 'O'), 8) as "O", round(avg(l_quantity) filter (l_linestatus = 'F'), 8) as "F" from lineitem group by 1"""))
def variable_pivot(spark, d):
    return rounded(I.scan(spark, d, "lineitem").groupBy("l_suppkey").pivot("l_linestatus", ["O", "F"]).agg(F.avg("l_quantity")))


@query("i04_metric_pivot", "I4", sql(
    "select spatial_unit, max(round(yield_tons_ha, 8)) filter (season = 'first_season') as first_season, max(round(yield_tons_ha, 8)) filter (season = 'second_season') as second_season from targets group by 1", "targets"))
def metric_pivot(spark, d):
    return rounded(agg.season_pivot(I.targets(spark, d), ["spatial_unit"], "yield_tons_ha", ("first_season", "second_season"), "max", None))


# --- gates ------------------------------------------------------------------------------
def gate_panel(spark, d):
    t = I.targets(spark, d)
    return t.withColumns({
        "target_temporal_granularity": F.lit("seasonal"), "target_source_type": F.when(F.col("crop") == "promo", "model").otherwise("official_aggregate"),
        "target_geographic_level": F.lit("sub_region"), "predictor_geographic_level": F.when(F.col("year") == 2001, "district").otherwise("sub_region"),
        "is_proxy": F.lit(False), "is_synthetic": F.col("crop") == "small", "is_geographically_assigned": F.lit(False),
        "sparse": F.when(F.col("year") > 1999, F.col("area_planted_ha"))})


@query("q01_final_dataset_gate", "Q1", sql(
    """select cast(unnest([1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16,17,18]) as integer) as position, unnest(['panel key occurs more than once','rows below minimum','annual and seasonal targets in one panel','unknown target granularity','environments below minimum','spatial units below minimum','years below minimum','target missing or not a number','target infinite','target below zero','proxy targets present','synthetic targets present','targets carried down from a wider area','target source type outside the allowed set','target and predictor levels differ','predictors derived from the target','predictors absent from the panel','predictor coverage below minimum']) as "check",
    unnest([0, n, 1, 1, e, u, y, 0, 0, 0, 0, syn, 0, prm, lvl, 2, 1, cov]) as value, unnest([0.0, 100, 1, 1, 50, 5, 4, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0.8]) as threshold,
    unnest([true, n >= 100, true, true, e >= 50, u >= 5, y >= 4, true, true, true, true, syn = 0, true, prm = 0, lvl = 0, false, false, cov >= 0.8]) as passed
    from (select count(*)::double as n, count(distinct (spatial_unit, year, season))::double as e, count(distinct spatial_unit)::double as u, count(distinct year)::double as y,
      count(*) filter (crop = 'small')::double as syn, count(*) filter (crop = 'promo')::double as prm, count(*) filter (year = 2001)::double as lvl, round(count(*) filter (year > 1999) / count(*), 8) as cov from targets)""", "targets"))
def final_gate(spark, d):
    return rounded(quality.final_dataset_report(gate_panel(spark, d), ["area_planted_ha", "sparse", "production_mt", "nowhere"]))


@query("q11_acceptance", "Q11", sql(
    """select false as accepted, 'synthetic targets present' as reason, count(distinct (spatial_unit, year, season)) as environments, count(distinct spatial_unit) as units, count(distinct year) as years, count(*) as rows from targets""", "targets"))
def acceptance(spark, d):
    panel = gate_panel(spark, d)
    report = quality.final_dataset_report(panel, ["area_planted_ha"])
    return quality.acceptance(report, panel)


@query("q10_small_sample", "Q10", sql(
    "select count(p_size) as rows, count(distinct p_size) as distinct_targets, case when count(p_size) < 100 then 'only ' || count(p_size) || ' rows' else '' end as warning from part"))
def small_sample(spark, d):
    return quality.small_sample_banner(I.scan(spark, d, "part"), "p_size")


@query("q08_key_uniqueness", "Q8", sql("select sum(n)::bigint as rows, count(*) as keys, count(*) filter (n > 1) as duplicate_keys from (select l_orderkey, l_linenumber, count(*) as n from lineitem where l_quantity is not null group by 1, 2)"))
def key_uniqueness(spark, d):
    return quality.key_uniqueness(I.scan(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_quantity")


@query("q13_single_valued", "Q13", sql('select p_brand, count(distinct p_type) as "values", min(p_type) as lowest, max(p_type) as highest from part group by 1 having count(distinct p_type) > 1'))
def single_valued(spark, d):
    return quality.single_valued(I.scan(spark, d, "part"), "p_brand", "p_type")


@query("a13_table_fingerprint", "A13", None)
def fingerprint(spark, d):
    from ..sources.sinks import fingerprint as fp

    return fp(I.scan(spark, d, "lineitem"))


def fresh_folder(spark, name):
    """A new path in the shared folder."""
    import uuid

    from ..session import shared_folder

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("a11_split_table_round_trip", "A10 A11", sql("select target_temporal_granularity, count(*) as rows, sum(area_planted_ha) as area from (select case when season = 'first_season' then 'annual' else 'seasonal' end as target_temporal_granularity, area_planted_ha from targets) group by 1", "targets"))
def split_round_trip(spark, d):
    from ..sources.sinks import write_split

    path = fresh_folder(spark, "split")
    t = I.targets(spark, d).withColumn("target_temporal_granularity", F.when(F.col("season") == "first_season", "annual").otherwise("seasonal"))
    write_split(t, path)
    back = spark.read.parquet(path)
    return back.groupBy("target_temporal_granularity").agg(F.count(F.lit(1)).alias("rows"), F.sum("area_planted_ha").alias("area"))


@query("a12_bundle_round_trip", "A12 A13", sql("select count(*) as rows, sum(area_planted_ha) as area from targets", "targets"))
def bundle_round_trip(spark, d):
    from ..sources.sinks import fingerprint as fp
    from ..sources.sinks import write_bundle

    path = fresh_folder(spark, "run")
    t = I.targets(spark, d)
    write_bundle({"targets": t}, fp(t), path)
    total = spark.read.parquet(f"{path}/targets").agg(F.sum("area_planted_ha").alias("area"))
    return spark.read.json(f"{path}/manifest").select("rows").join(F.broadcast(total), F.lit(True), "inner")
