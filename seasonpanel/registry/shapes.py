"""Queries over payloads, spreadsheet cells, labels, soil, grids and polygons."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalars as S
from ..operators import agg, cells, quality, spatial
from ..session import cut_lineage, shared_folder
from ..sources import payloads, tables
from . import inputs as I
from .base import query
from .inputs import rounded, sql

# --- payloads -----------------------------------------------------------------------


@query("a02_soil_payload", "A2 J13", sql(
    """select cast(s_suppkey as varchar) as district, 'clay' as property, depth, case depth when '0-5cm' then s_acctbal else s_nationkey + 0.5 end as value, 10 as d_factor
    from supplier, (values ('0-5cm'), ('5-15cm')) t(depth) where depth = '0-5cm' or s_nationkey % 2 = 0"""))
def soil_payload(spark, d):
    """One text per supplier and depth in the landed shape, written to the shared folder and read again."""
    s = I.scan(spark, d, "supplier")
    second = F.when(F.col("s_nationkey") % 2 == 0, F.col("s_nationkey") + 0.5).cast("string")
    text = F.concat(
        F.lit('{"type": "Feature", "properties": {"layers": [{"name": "clay", "unit_measure": {"d_factor": 10}, "depths": [{"label": "0-5cm", "values": {"mean": '),
        F.col("s_acctbal").cast("string"), F.lit('}}, {"label": "5-15cm", "values": {"mean": '), F.coalesce(second, F.lit("null")), F.lit("}}]}]}}"))
    files = s.select(F.col("s_suppkey").cast("string").alias("district"), F.lit("clay").alias("property"),
                     F.explode(F.array(F.lit("0-5cm"), F.lit("5-15cm"))).alias("depth"), text.alias("value"))
    return payloads.soil_points(payloads.parsed(landed(files), payloads.SOIL_PAYLOAD, "properties.layers"))


def landed(files):
    """The payload table as a landing job leaves it."""
    path = f"{shared_folder(files.sparkSession)}/landed-{uuid.uuid4().hex}"
    files.write.json(path)
    return files.sparkSession.read.schema(files.schema).json(path)


@query("a03_daily_map_payload", "A3 J13", sql(
    """select district, date, nullif(k, -999.0) as tmax_c, case when lo_ok then nullif(lo, -999.0) end as tmin_c from (
      select cast(user_id as varchar) as district, ts::date as date, max(case when k = 7 then -999.0 else k end)::double as k, max(k) > 20 as lo_ok, min(case when k = 1 then -999.0 else k end)::double as lo
      from (select *, cast(json_extract(props, '$.k') as integer) as k from events) group by all)"""))
def daily_map_payload(spark, d):
    e = I.scan(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    day = e.groupBy(F.col("user_id").cast("string").alias("district"), F.to_date("ts").alias("date")).agg(
        F.max(F.when(F.col("k") == 7, -999.0).otherwise(F.col("k").cast("double"))).alias("hi"),
        (F.max("k") > 20).alias("ok"),
        F.min(F.when(F.col("k") == 1, -999.0).otherwise(F.col("k").cast("double"))).alias("lo"))
    # one payload per district and day, as a landed file would hold for its period
    key = F.date_format("date", "yyyyMMdd")
    body = F.create_map(F.lit("T2M_MAX"), F.create_map(key, F.col("hi")), F.lit("T2M_MIN"), F.when(F.col("ok"), F.create_map(key, F.col("lo"))))
    text = day.select("district", F.to_json(body).alias("text"))
    return payloads.daily_from_maps(text.withColumn("payload", F.from_json("text", payloads.DAILY_MAP_PAYLOAD)))


@query("a04_record_payload", "A4 J8", sql(
    """select district, date, rain_mm, cast(year(date) as integer) as year, cast(month(date) as integer) as month, cast(day(date) as integer) as day, cast(dayofyear(date) as integer) as doy from daily where rain_mm is not null""", "daily"))
def record_payload(spark, d):
    day = I.daily(spark, d).filter("rain_mm is not null")
    record = F.struct(F.date_format("date", "M/d/yyyy").alias("date"), F.date_format("date", "yyyy-MM-dd").alias("isodate"), F.col("rain_mm").cast("string").alias("raw_value"))
    files = day.groupBy("district").agg(F.to_json(F.collect_list(record)).alias("value"))
    return payloads.daily_from_records(payloads.parsed(landed(files), payloads.RECORD_PAYLOAD, ""))


@query("a05_feature_centroids", "A5", sql(
    """select 'N' || n_nationkey as name, (n_nationkey + 0.0 + n_nationkey + n_nationkey + 2 + n_nationkey + 2 + n_nationkey + 1) / 5 as lon, (0.0 + n_regionkey + 0 + n_regionkey + 3) / 5 as lat from nation"""))
def feature_centroids(spark, d):
    n = I.scan(spark, d, "nation")
    x, y = F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double")
    zero = F.lit(0.0)
    big = F.array(F.array(x, zero), F.array(x, y), F.array(x + 2, zero), F.array(x + 2, y), F.array(x + 1, zero + 3))
    small = F.array(F.array(zero, zero), F.array(zero, zero + 1), F.array(zero + 1, zero))
    # odd nations are one polygon with a hole, even ones two polygons
    odd = F.col("n_nationkey") % 2 == 1
    polygon, several = F.to_json(F.array(big, small)), F.to_json(F.array(F.array(small), F.array(big)))
    geometry = F.concat(F.lit('{"type": "'), F.when(odd, "Polygon").otherwise("MultiPolygon"), F.lit('", "coordinates": '), F.when(odd, polygon).otherwise(several), F.lit("}"))
    feature = F.concat(F.lit('{"type": "Feature", "properties": {"shapeName": "N'), F.col("n_nationkey").cast("string"), F.lit('"}, "geometry": '), geometry, F.lit("}"))
    files = n.groupBy("n_regionkey").agg(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.collect_list(feature), ", "), F.lit("]}")).alias("value")).select("value")
    return spatial.centroids(payloads.centroid_rings(payloads.boundary_features(payloads.parsed(landed(files), payloads.BOUNDARY_PAYLOAD, "features"))))


@query("a01_declared_scan", "A1", sql("select l_suppkey, count(*) as lines, sum(l_quantity) as quantity from lineitem group by 1"))
def declared_scan(spark, d):
    t = tables.read_table(spark, f"{d}/lineitem.parquet", ["l_suppkey", "l_quantity"])
    return t.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"))


@query("a14_reference_dimension", "A14 C9", sql("select n_nationkey as district, n_name as sub_region, n_regionkey * 1.0::double as lat, n_nationkey * 1.0::double as lon from nation"))
def reference_dimension(spark, d):
    from ..operators.joins import reference_dimension as build

    n = I.scan(spark, d, "nation")
    m = n.select(F.col("n_nationkey").alias("district"), F.col("n_name").alias("sub_region"))
    c = n.select(F.col("n_nationkey").alias("district"), F.col("n_regionkey").cast("double").alias("lat"), F.col("n_nationkey").cast("double").alias("lon"))
    return build(m, c)


# --- labels and numbers ----------------------------------------------------------------
@query("j01_district_names", "J1", sql(
    """select c_custkey, 'C' || substr(lower(c_name), 2, 7) || ' ' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || '''S ' || substr(c_name, 9) as name from customer"""))
def district_names(spark, d):
    raw = F.concat(F.lit(" "), F.upper(F.substring("c_name", 1, 8)), F.lit("_  "), "c_mktsegment", F.lit("'s__"), F.expr("substring(c_name, 9)"))
    return I.scan(spark, d, "customer").select("c_custkey", S.district_name(raw).alias("name"))


@query("j02_cell_text", "J2", sql(
    """select o_orderkey, coalesce(replace(lower(o_orderpriority), ' ', ' '), '') || case when o_orderpriority is null then '' else ' - x' end as t from orders"""))
def cell_text(spark, d):
    raw = F.concat(F.lit(" \t"), F.regexp_replace("o_orderpriority", " ", "  \n"), F.lit("  – X "))
    return I.scan(spark, d, "orders").select("o_orderkey", S.cell_text(raw).alias("t"))


@query("j03_year_and_number", "J3 J4", sql(
    """select p_partkey, case when p_partkey % 4 = 0 and y between 2000 and 2025 then y end as year_text, case when p_partkey % 4 = 1 and y between 2000 and 2025 then y end as year_float,
    case when p_partkey % 4 < 3 then p_retailprice end as number from (select *, cast(1990 + p_size as integer) as y from part)"""))
def year_and_number(spark, d):
    p = I.scan(spark, d, "part")
    y, m = 1990 + F.col("p_size"), F.col("p_partkey") % 4
    price = F.format_number("p_retailprice", 2)
    text = F.when(m == 0, F.concat(F.lit(" "), price, F.lit("a"))).when(m == 1, F.concat(price, F.lit(" "))).when(m == 2, F.concat(price, F.lit("**"))).otherwise("n/a")
    return p.select(
        "p_partkey",
        S.parse_year(F.when(m == 0, F.concat(y.cast("string"), F.lit(" "))).when(m == 1, F.lit("x"))).alias("year_text"),
        S.parse_year(F.when(m == 1, F.concat(y.cast("string"), F.lit(".0"))).when(m == 2, F.lit("20155"))).alias("year_float"),
        S.parse_number(text).alias("number"))


LABELS = """case p_type when 'PROMO' then 'maize' when 'SMALL' then 'sweet_potatoes' when 'LARGE' then 'banana' when 'MEDIUM' then null when 'ECONOMY' then 'beans' else null end"""


@query("j05_canonical_labels", "J5 J6", sql(
    f"""select canonical, is_group, region, count(*) as n from (select {LABELS} as canonical, p_type = 'MEDIUM' as is_group, case when p_size % 2 = 0 then 'South Buganda' end as region from part) group by all"""))
def canonical_labels(spark, d):
    t = F.col("p_type")
    raw = F.when(t == "PROMO", "Maize *").when(t == "SMALL", " S/Potatoes ").when(t == "LARGE", "Plantain Bananas(FOOD)").when(t == "MEDIUM", "Total  Cereals").when(t == "ECONOMY", "beans").otherwise("beansprouts and other greens")
    out = I.scan(spark, d, "part").select(S.canonical_label(raw).alias("m"), S.recode(F.when(F.col("p_size") % 2 == 0, "S. Buganda").otherwise("Elsewhere"), K.REGION_SYNONYMS).alias("region"))
    return out.groupBy("m.canonical", "m.is_group", "region").agg(F.count(F.lit(1)).alias("n"))


@query("j10_clip_and_recode", "J9 J10 J14", sql(
    """select s_suppkey, greatest(s_acctbal, 0) as clipped, round(s_acctbal - 273.15, 8) as celsius, round(cos(radians(s_nationkey)), 8) as weight from supplier"""))
def clip(spark, d):
    return rounded(I.scan(spark, d, "supplier").select("s_suppkey", S.clip_at_zero("s_acctbal").alias("clipped"), S.kelvin_to_celsius("s_acctbal").alias("celsius"), S.latitude_weight("s_nationkey").alias("weight")))


@query("j15_first_at_depth", "J15", sql(
    """select p_partkey, v, case when v is null then 'empty_values' else 'ok' end as status from (select p_partkey, case when p_size % 3 = 0 then p_size * 1.0 when p_size % 3 = 1 then p_retailprice when p_type = 'PROMO' then 7.0 end::double as v from part)"""))
def first_at_depth(spark, d):
    m = F.col("p_size") % 3
    depth = lambda label, mean, q50, median: F.struct(F.lit(label).alias("label"), mean.cast("double").alias("mean"), q50.cast("double").alias("q50"), median.cast("double").alias("median"))
    none = F.lit(None)
    depths = F.array(
        depth("30-60cm", F.when(F.col("p_type") == "PROMO", F.lit(7.0)), none, none),
        depth("0-30cm", F.when(m == 0, F.col("p_size")), F.when(m == 1, F.col("p_retailprice")), F.when(m < 2, F.lit(1.0))))
    v = S.first_at_depth(depths, "0-30cm")
    return I.scan(spark, d, "part").select("p_partkey", v.alias("v"), S.reading_status(v).alias("status"))


# --- spreadsheet cells -------------------------------------------------------------------
MATRIX = """select cast(year(o_orderdate) + 5 as integer) as year, substr(o_orderpriority, 1, 1) as p, o_orderstatus as sheet, round(sum(o_totalprice) / 1000, 2) as v from orders group by all"""
CROPS = {"1": "Maize", "2": "Finger millet", "3": "Sorghum", "4": "Total cereals", "5": "Rice (paddy)"}
NAMES = {"1": "maize", "2": "millet", "3": "sorghum", "5": "rice"}


def matrix(spark, d):
    o = I.scan(spark, d, "orders")
    return o.groupBy((F.year("o_orderdate") + 5).alias("year"), F.substring("o_orderpriority", 1, 1).alias("p"), F.col("o_orderstatus").alias("sheet")).agg(
        F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / 1000, 2).alias("v"))


def sheet_cells(spark, d):
    """Cells of one workbook: years across the header in sheets O and F, down a column in P."""
    m = matrix(spark, d)
    first = 2000
    y, c = F.col("year") - first, F.col("p").cast("int")
    label = S.recode("p", CROPS)
    cell = lambda row, col, value: F.struct(row.cast("int").alias("row"), col.cast("int").alias("col"), value.cast("string").alias("value"))
    text = F.format_number("v", 2)
    wide = F.array(cell(F.lit(0), F.lit(0), F.lit("Area by crop")), cell(F.lit(2), y + 2, F.col("year")), cell(c + 3, F.lit(1), label), cell(c + 3, y + 2, text))
    tall = F.array(cell(F.lit(0), F.lit(0), F.lit("Area by crop")), cell(F.lit(1), c, label), cell(y + 2, F.lit(0), F.col("year")), cell(y + 2, c, text))
    cells_df = m.select(F.lit("book").alias("workbook"), "sheet", F.explode(F.when(F.col("sheet") == "P", tall).otherwise(wide)).alias("c"))
    # the parser reads its cell table several times, so it is landed first
    return cut_lineage(cells_df.select("workbook", "sheet", "c.row", "c.col", "c.value").distinct())


CASE_NAMES = "case p " + " ".join(f"when '{k}' then '{v}'" for k, v in NAMES.items()) + " end"
CASE_RAW = "case p " + " ".join(f"when '{k}' then '{v.lower()}'" for k, v in CROPS.items()) + " end"
M = {"m": MATRIX.replace("round(sum(o_totalprice) / 1000, 2)", "round(cast(sum(cast(o_totalprice as decimal(18,2))) as double) / 1000, 2)")}


@query("i05_parse_sheets", "I5 I6", sql(
    f"select 'book' as workbook, sheet, {CASE_NAMES} as crop, year, v as value, {CASE_RAW} as raw_label from m where p <> '4'", extra=M))
def parse_sheets(spark, d):
    return cells.parse_sheets(sheet_cells(spark, d))


@query("q12_national_yield_panel", "Q12 H7", sql(
    f"""select crop, year, round(prod, 8) as production_mt, round(area, 8) as area_planted_ha, round(prod / area, 8) as yield_tons_ha_planted, true as is_proxy from
    (select {CASE_NAMES} as crop, year, v as prod from m where sheet = 'F') join (select {CASE_NAMES} as crop, year, v as area from m where sheet = 'O') using (crop, year) where crop is not null""", extra=M))
def national_panel(spark, d):
    parsed = cells.parse_sheets(sheet_cells(spark, d))
    area = parsed.filter("sheet = 'O'").withColumnRenamed("value", "area_planted_ha")
    production = parsed.filter("sheet = 'F'").withColumnRenamed("value", "production_mt")
    out = quality.national_yield_panel(area, production)
    return rounded(out.select("crop", "year", "production_mt", "area_planted_ha", "yield_tons_ha_planted", "is_proxy"))


@query("q05_anchor_validation", "Q5", sql(
    f"""select crop, year, expected, v as parsed, case when v is null then 'missing' when abs(v - expected) <= 0.005 * greatest(abs(expected), 1) then 'ok' else 'mismatch' end as status
    from (select {CASE_NAMES} as crop, year + case when p = '5' then 50 else 0 end as year, round(v * case when p = '2' then 1.1 else 1.001 end, 2) as expected from m where sheet = 'O' and p <> '4')
    left join (select {CASE_NAMES} as crop, year, v from m where sheet = 'O') using (crop, year)""", extra=M))
def anchors(spark, d):
    m = matrix(spark, d).filter("sheet = 'O' and p <> '4'").withColumn("crop", S.recode("p", NAMES))
    printed = m.select("crop", (F.col("year") + F.when(F.col("p") == "5", 50).otherwise(0)).alias("year"), F.round(F.col("v") * F.when(F.col("p") == "2", 1.1).otherwise(1.001), 2).alias("expected"))
    return quality.anchor_report(m.select("crop", "year", F.col("v").alias("value")), printed, "value")


@query("q06_detect_grain", "Q6", sql(
    """select 'book' || o_orderstatus as workbook, case o_orderstatus when 'P' then 'district' when 'F' then 'subregion' else 'national' end as grain from orders group by all"""))
def grain(spark, d):
    """Priorities and clerks stand for labels; three workbooks of different grain."""
    o = I.scan(spark, d, "orders")
    names = F.array(*[F.lit(n) for n in ("Acholi", "Ankole", "Lango", "Teso", " West  Nile", "Tooro")])
    s = F.col("o_orderstatus")
    text = F.when(s == "F", F.element_at(names, (F.pmod("o_orderkey", F.lit(6)) + 1).cast("int"))).when(s == "P", "District").otherwise("COUNTRYLAND")
    c = o.select(F.concat(F.lit("book"), s).alias("workbook"), F.lit("s1").alias("sheet"), F.col("o_orderkey").alias("row"), F.lit(0).alias("col"), text.alias("value"))
    return cells.detect_grain(c, "countryland").select("workbook", "grain")


@query("i07_block_unpivot", "I7", sql(
    """select 'w' as workbook, 's' as sheet, n_name as entity, season, case season when 'first' then n_nationkey * 1.5 else n_nationkey + 100.0 end as area, case when season = 'first' and n_regionkey > 1 then n_regionkey * 10.0 end as production
    from nation, (values ('first'), ('second')) t(season)"""))
def block_unpivot(spark, d):
    n = I.scan(spark, d, "nation")
    cell = lambda col, value: F.struct(F.lit(col).alias("col"), value.cast("string").alias("value"))
    k = F.col("n_nationkey")
    parts = F.array(cell(0, F.col("n_name")), cell(2, k * 1.5), cell(3, F.when(F.col("n_regionkey") > 1, F.col("n_regionkey") * 10.0).cast("string")), cell(5, k + 100.0), cell(6, F.lit("n/a")))
    c = n.select(F.lit("w").alias("workbook"), F.lit("s").alias("sheet"), (k + 5).alias("row"), F.explode(parts).alias("c")).select("workbook", "sheet", "row", "c.col", "c.value")
    extra = n.filter("n_nationkey = 0").select(F.lit("w").alias("workbook"), F.lit("s").alias("sheet"), F.lit(900).alias("row"), F.explode(F.array(cell(0, F.lit("Notes: x")), cell(2, F.lit(3)))).alias("c"))
    c = c.unionByName(extra.select("workbook", "sheet", "row", "c.col", "c.value"))
    spec = spark.createDataFrame([("first", 2, "area"), ("first", 3, "production"), ("second", 5, "area"), ("second", 6, "production")], "season string, col int, field string")
    return cells.unpivot_blocks(c, spec, ["area", "production"], (0, 1000))


@query("a07_header_members", "A7", sql("select 'w' as workbook, 's' as sheet, n_name as member, r_name as group_name from nation join region on r_regionkey = n_regionkey"))
def header_members(spark, d):
    n, r = I.scan(spark, d, "nation"), I.scan(spark, d, "region")
    head = r.select(F.lit(0).alias("row"), F.col("r_regionkey").alias("col"), F.concat(F.col("r_name"), F.lit(" ")).alias("value"))
    body = n.select((F.col("n_nationkey") + 1).alias("row"), F.col("n_regionkey").alias("col"), F.col("n_name").alias("value"))
    blank = n.select((F.col("n_nationkey") + 50).alias("row"), F.col("n_regionkey").alias("col"), F.lit("  ").alias("value"))
    return cells.header_members(head.unionByName(body).unionByName(blank).withColumns({"workbook": F.lit("w"), "sheet": F.lit("s")}))


# --- soil --------------------------------------------------------------------------------
def depth_points(spark, d):
    li, part = I.scan(spark, d, "lineitem"), I.scan(spark, d, "part")
    pre = li.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    depth = F.when(F.col("p_size") <= 15, "0-5cm").when(F.col("p_size") <= 30, "5-15cm").when(F.col("p_size") <= 40, "15-30cm").otherwise("30-60cm")
    prop = F.when(F.col("p_type").isin("PROMO", "SMALL"), "clay").when(F.col("p_type").isin("LARGE", "MEDIUM"), "sand").otherwise("silt")
    j = pre.join(part, pre.l_partkey == part.p_partkey).groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("district"), prop.alias("property"), depth.alias("depth"))
    return j.agg((F.sum("q") / F.sum("n")).alias("value")).withColumn("d_factor", F.lit(10))


DEPTHS = """select 'S' || l_suppkey as district, case when p_type in ('PROMO', 'SMALL') then 'clay' when p_type in ('LARGE', 'MEDIUM') then 'sand' else 'silt' end as property,
  case when p_size <= 15 then '0-5cm' when p_size <= 30 then '5-15cm' when p_size <= 40 then '15-30cm' else '30-60cm' end as depth, sum(l_quantity) / count(*) as value from lineitem join part on p_partkey = l_partkey group by all"""
SOIL = {"depths": DEPTHS, "soil": """select district, max(v) filter (property = 'clay') as clay, max(v) filter (property = 'sand') as sand, max(v) filter (property = 'silt') as silt from
  (select district, property, sum(value * w) / sum(w) / 10 as v from (select *, case depth when '0-5cm' then 5.0 when '5-15cm' then 10.0 when '15-30cm' then 15.0 end as w from depths) where w is not null group by all) group by 1"""}


def soil(spark, d):
    return agg.depth_weighted_soil(depth_points(spark, d), properties=["clay", "sand", "silt"])


@query("d19_depth_weighted_soil", "D19", sql("select district, round(clay, 8) as clay, round(sand, 8) as sand, round(silt, 8) as silt from soil", extra=SOIL))
def depth_weighted(spark, d):
    return rounded(soil(spark, d))


@query("d20_region_soil", "D20 D21 C6", sql(
    """select sub_region as spatial_unit, round(avg(clay), 8) as clay_pct, round(coalesce(stddev_samp(clay), 0), 8) as clay_pct_sd, round(avg(sand), 8) as sand_pct, round(coalesce(stddev_samp(sand), 0), 8) as sand_pct_sd, count(*) as soil_district_count,
    round(avg(s_acctbal), 8) as elevation_m, round(stddev_samp(s_acctbal), 8) as elevation_m_sd from soil join members using (district) join supplier on 'S' || s_suppkey = district group by 1""", "members", extra=SOIL))
def region_soil(spark, d):
    m = I.members(spark, d)
    elevation = I.scan(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("district"), F.col("s_acctbal").alias("elevation_m"))
    s = agg.region_soil(soil(spark, d), m, renames={"clay": "clay_pct", "sand": "sand_pct"})
    return rounded(s.join(agg.region_elevation(elevation, m), "spatial_unit"))


@query("q02_soil_gate", "Q2", sql(
    """select cast(unnest([1, 2, 3, 4]) as integer) as position, unnest(['coverage of clay', 'coverage of sand', 'coverage of silt', 'texture sum out of range']) as "check",
    round(unnest([avg((clay is not null)::int), avg((sand is not null)::int), avg((silt is not null)::int), count(*) filter (clay + sand + silt not between 7 and 8)]), 8) as value, unnest([0.8, 0.8, 0.8, 0.0]) as threshold,
    unnest([avg((clay is not null)::int) >= 0.8, avg((sand is not null)::int) >= 0.8, avg((silt is not null)::int) >= 0.8, count(*) filter (clay + sand + silt not between 7 and 8) = 0]) as passed from soil""", extra=SOIL))
def soil_gate(spark, d):
    return rounded(quality.soil_report(soil(spark, d), ["clay", "sand", "silt"], texture=("clay", "sand", "silt"), bounds=(7, 8)))


@query("q03_member_soil_gate", "Q3 Q4 C21", sql(
    """select cast(unnest([1, 2, 3, 4, 5, 6]) as integer) as position, unnest(['duplicate members', 'row count', 'members outside the map', 'missing or non-finite values', 'texture sum out of range', 'proxy rows']) as "check",
    unnest([0, n, out, 0, bad, 0])::double as value, unnest([0.0, 100, 0, 0, 0, 0]) as threshold, unnest([true, n = 100, out = 0, true, bad = 0, true]) as passed from
    (select count(*) as n, count(*) filter (sub_region is null) as out, count(*) filter (clay + sand + silt not between 7 and 8) as bad from soil left join (select * from members where sub_region <> 'NATION_2') using (district))""", "members", extra=SOIL))
def member_gate(spark, d):
    known = I.members(spark, d).filter("sub_region <> 'NATION_2'")
    return quality.member_soil_report(soil(spark, d), known, 100, ["clay", "sand", "silt"], bounds=(7, 8))


@query("q04_minimum_coverage", "Q4", sql("select round(least(count(rain_mm) / count(*), count(tmin_c) / count(*)), 8) as minimum_coverage from daily", "daily"))
def min_coverage(spark, d):
    return rounded(quality.minimum_coverage(I.daily(spark, d), ["rain_mm", "tmin_c"]))


# --- grids and polygons --------------------------------------------------------------------
def grid(spark, d):
    """Cells from orders: time = month, latitude from the customer, longitude from the key."""
    o = I.scan(spark, d, "orders")
    return o.groupBy(
        F.trunc("o_orderdate", "year").alias("time"), (F.pmod("o_custkey", F.lit(10)) * 0.5).alias("latitude"), (F.pmod("o_orderkey", F.lit(12)) * 0.5).alias("longitude")
    ).agg(F.max(F.when(F.pmod("o_orderkey", F.lit(5)) > 0, F.col("o_totalprice"))).alias("precip"))


GRID = {"grid": """select cast(date_trunc('year', o_orderdate) as date) as time, o_custkey % 10 * 0.5::double as latitude, o_orderkey % 12 * 0.5::double as longitude, max(case when o_orderkey % 5 > 0 then o_totalprice end) as precip from orders group by all"""}


@query("a06_grid_clip", "A6", sql("select * from grid where latitude between 1 and 3 and longitude between 0.5 and 4 and time between '1996-01-01' and '1998-12-31'", extra=GRID))
def grid_clip(spark, d):
    return spatial.clip_grid(grid(spark, d), (3.0, 1.0), (0.5, 4.0), ("1996-01-01", "1998-12-31"))


def points(spark, d):
    s = I.scan(spark, d, "supplier")
    return s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("district"), (F.pmod("s_suppkey", F.lit(40)) * 0.11).alias("lat"), (F.col("s_nationkey") * 0.31 - 1).alias("lon"))


POINTS = {**GRID, "points": "select 'S' || s_suppkey as district, s_suppkey % 40 * 0.11::double as lat, s_nationkey * 0.31::double - 1 as lon from supplier",
          "near": """select district, any_value(lat) as lat, any_value(lon) as lon, arg_min(la, (abs(la - lat), la)) as latitude from points, (select distinct latitude as la from grid) group by 1""",
          "cellof": """select district, any_value(n.lat) as lat, any_value(n.lon) as lon, any_value(n.latitude) as latitude, arg_min(lo, (abs(lo - n.lon), lo)) as longitude from near n, (select distinct longitude as lo from grid) group by 1"""}


@query("c15_nearest_cell_series", "C15", sql("select district, time, latitude, longitude, precip from cellof join grid using (latitude, longitude)", extra=POINTS))
def nearest(spark, d):
    return spatial.nearest_cell_series(points(spark, d), grid(spark, d), 0.5).select("district", "time", "latitude", "longitude", "precip")


@query("c16_nearest_valid_value", "C16", sql(
    """select p.district, p.lat, p.lon, arg_min(g.value, (not (g.latitude = p.latitude and g.longitude = p.longitude), (g.latitude - p.lat)^2 + (g.longitude - p.lon)^2, g.latitude, g.longitude)) as value
    from cellof p left join (select latitude, longitude, precip as value from grid where time = '1997-01-01' and precip is not null and (latitude + longitude) % 1.5 < 0.4) g on abs(g.latitude - p.latitude) <= 1 and abs(g.longitude - p.longitude) <= 1 group by all""", extra=POINTS))
def nearest_valid(spark, d):
    g = grid(spark, d).filter("time = '1997-01-01'")
    values = g.select("latitude", "longitude", F.when((F.col("latitude") + F.col("longitude")) % 1.5 < 0.4, F.col("precip")).alias("value"))
    axes = grid(spark, d).select("latitude", "longitude").distinct()
    full = axes.join(values, ["latitude", "longitude"], "left")
    return spatial.nearest_valid_value(points(spark, d), full, 0.5).select("district", "lat", "lon", "value")


def boundaries(spark, d):
    """A square and an L-shape per region key."""
    r = I.scan(spark, d, "region")
    k = F.col("r_regionkey").cast("double")
    p = lambda x, y: F.struct((k * 0.63 + x).alias("lon"), F.lit(float(y)).alias("lat"))
    square = F.array(p(-0.1, -0.1), p(1.7, -0.1), p(1.7, 2.3), p(-0.1, 2.3))
    ell = F.array(p(-0.1, -0.1), p(3.1, -0.1), p(3.1, 1.2), p(1.3, 1.2), p(1.3, 4.2), p(-0.1, 4.2))
    return r.select("r_name", F.explode(F.array(F.struct(F.lit("square").alias("s"), F.array(square).alias("rings")), F.struct(F.lit("ell").alias("s"), F.array(ell).alias("rings")))).alias("g")).select(
        F.concat_ws(" ", "r_name", "g.s").alias("spatial_unit"), "g.rings")


INSIDE = {**GRID, "inside": """select r_name || ' ' || s as spatial_unit, latitude, longitude from region, (values ('square'), ('ell')) t(s), (select distinct latitude, longitude from grid)
  where (s = 'square' and longitude - r_regionkey * 0.63 between -0.1 and 1.7 and latitude between -0.1 and 2.3)
     or (s = 'ell' and ((longitude - r_regionkey * 0.63 between -0.1 and 3.1 and latitude between -0.1 and 1.2) or (longitude - r_regionkey * 0.63 between -0.1 and 1.3 and latitude between -0.1 and 4.2)))"""}


@query("c17_point_in_polygon", "C17", sql("select * from inside", extra=INSIDE))
def point_in_polygon(spark, d):
    return spatial.cells_in_polygons(grid(spark, d), boundaries(spark, d))


@query("d03_polygon_daily_mean", "D3 J14", sql(
    "select spatial_unit, time as date, round(sum(coalesce(precip, 0) * cos(radians(latitude))) / sum(cos(radians(latitude))), 6) as precip from inside join grid using (latitude, longitude) group by all", extra=INSIDE))
def polygon_mean(spark, d):
    return rounded(spatial.polygon_daily_mean(grid(spark, d), boundaries(spark, d)), 6)


@query("d32_point_set_mean", "D32", sql(
    "select substr(district, 1, 2) as district, time, round(avg(precip), 6) as precip from cellof join grid using (latitude, longitude) group by 1, 2 having avg(precip) is not null", extra=POINTS))
def point_set(spark, d):
    p = points(spark, d).withColumn("name", F.substring("district", 1, 2))
    return rounded(spatial.point_set_mean(p, grid(spark, d), 0.5, name="name").withColumnRenamed("name", "district"), 6)


@query("c18_polygons_without_cells", "C18", sql("select 'far ' || r_name || ' ' || s as spatial_unit from region, (values ('square'), ('ell')) t(s)"))
def polygons_without_cells(spark, d):
    """Half of the polygons lie far outside the grid."""
    near = boundaries(spark, d)
    away = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.struct((p["lon"] + 1000).alias("lon"), p["lat"].alias("lat"))))
    every = near.unionByName(near.select(F.concat(F.lit("far "), F.col("spatial_unit")).alias("spatial_unit"), away.alias("rings")))
    return spatial.polygons_without_cells(every, spatial.cells_in_polygons(grid(spark, d), every))
