"""Domain tables derived from the test tables, each with its SQL twin.

``TABLES`` holds one CTE per table; ``sql(query, *names)`` prepends the ones a
query needs, dependencies first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.calendar import season_calendar

YEARS = list(range(1995, 2002))


def scan(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r(col, digits: int = 8):
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def rounded(df: DataFrame, digits: int = 8, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round every double column, so that both engines agree on the last digits."""
    names = [f.name for f in df.schema.fields if f.dataType.typeName() == "double" and f.name not in skip]
    return df.withColumns({c: F.round(c, digits) for c in names}) if names else df


def exact_sum(col):
    """Sum of two-decimal values without floating noise."""
    return F.sum(F.col(col).cast("decimal(18,2)")).cast("double")


# --- daily series: district = supplier, one row per district and ship date ----
def daily(spark: SparkSession, d: str) -> DataFrame:
    li = scan(spark, d, "lineitem")
    quantity = F.sum("l_quantity")
    return li.groupBy(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("district"), F.to_date("l_shipdate").alias("date")
    ).agg(
        F.when(F.max("l_tax") < 0.08, F.greatest(quantity - 25, F.lit(0.0))).alias("rain_mm"),
        (F.max("l_quantity") / 4 + 24).alias("tmax_c"),
        F.max(F.when(F.col("l_returnflag") != "N", F.col("l_linenumber") * 3.0)).alias("tmin_c"),
    )


def members(spark: SparkSession, d: str) -> DataFrame:
    s, n = scan(spark, d, "supplier"), scan(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("district"), F.col("n_name").alias("sub_region")
    )


def district_calendar(spark: SparkSession, d: str) -> DataFrame:
    return season_calendar(members(spark, d), YEARS, unit="district")


def region_calendar(spark: SparkSession, d: str) -> DataFrame:
    return season_calendar(members(spark, d), YEARS, unit="sub_region")


def monthly(spark: SparkSession, d: str) -> DataFrame:
    li = scan(spark, d, "lineitem")
    day = F.to_date("l_shipdate")
    return li.groupBy(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("district"), F.year(day).alias("year"), F.month(day).alias("month")
    ).agg(F.sum("l_quantity").alias("rainfall_mm"))


# --- survey targets ------------------------------------------------------------
def survey(spark: SparkSession, d: str) -> DataFrame:
    """Crop x region x year x half-year totals. Lines are summed per part, supplier
    and half-year before the dimensions join, so a hot part is no hot key."""
    li = scan(spark, d, "lineitem")
    day = F.to_date("l_shipdate")
    qty = F.col("l_quantity")
    pre = li.groupBy("l_partkey", "l_suppkey", F.year(day).alias("year"), (F.month(day) <= 6).alias("h1")).agg(
        F.sum(qty).alias("q"),
        F.sum(F.when(F.col("l_returnflag") != "R", qty).otherwise(0.0)).alias("qh"),
        exact_sum("l_extendedprice").alias("p"),
        F.sum(qty * qty).alias("q2"),
        F.count(F.lit(1)).alias("n"),
    )
    part, supplier, nation = scan(spark, d, "part"), scan(spark, d, "supplier"), scan(spark, d, "nation")
    j = (
        pre.join(part.select("p_partkey", "p_type"), pre.l_partkey == part.p_partkey)
        .join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    g = j.groupBy(F.lower("p_type").alias("crop"), F.col("n_name").alias("sub_region"), "year", "h1").agg(
        F.sum("q").alias("area_planted_ha"),
        F.sum("qh").alias("area_harvested_ha"),
        (F.sum(F.col("p").cast("decimal(24,2)")).cast("double") / 1000).alias("production_mt"),
        F.sum("q2").alias("q2"),
        F.sum("n").alias("n"),
    )
    var = (F.col("q2") - F.col("area_planted_ha") * F.col("area_planted_ha") / F.col("n")) / (F.col("n") - 1)
    cv = F.when(F.col("n") > 1, 100 * F.sqrt(F.greatest(var, F.lit(0.0))) / (F.col("area_planted_ha") / F.col("n")) / F.sqrt("n"))
    return g.select(
        "crop",
        "sub_region",
        "year",
        F.when(F.col("h1"), "first_season").otherwise("second_season").alias("season"),
        "area_planted_ha",
        "area_harvested_ha",
        "production_mt",
        F.round(cv, 4).alias("cv_production_pct"),
        F.round(F.when(F.col("n") > 2, cv * 1.5), 4).alias("cv_area_harvested_pct"),
        F.round(cv * 0.5, 4).alias("cv_area_planted_pct"),
    )


def targets(spark: SparkSession, d: str) -> DataFrame:
    """Valid survey rows with their yield, one per panel key."""
    s = survey(spark, d).filter("area_harvested_ha > 0")
    return s.select(
        F.col("sub_region").alias("spatial_unit"), "year", "season", "crop",
        (F.col("production_mt") / F.col("area_harvested_ha")).alias("yield_tons_ha"),
        "area_planted_ha", "area_harvested_ha", "production_mt", "cv_production_pct",
    )


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """A fixed prediction table over the targets: two models, five folds by region."""
    t = targets(spark, d)
    fold = F.pmod(F.regexp_extract("spatial_unit", r"(\d+)$", 1).cast("int"), F.lit(5)) + 1
    rows = t.withColumn("fold", fold).withColumn("model", F.explode(F.array(F.lit("ridge"), F.lit("ols"))))
    guess = F.when(F.col("model") == "ridge", 1.9 + F.col("area_planted_ha") / 4000).otherwise(2.2 - F.col("cv_production_pct") / 100)
    return rows.select(
        "spatial_unit", "year", "season", "crop", "fold", "model",
        F.lit("raw").alias("feature_space"), F.lit("raw").alias("target_scale"),
        F.col("yield_tons_ha").alias("observed_yield"),
        F.coalesce(guess, F.lit(2.0)).alias("predicted_yield"),
    )


# --- vectors and households ------------------------------------------------------
def vectors(spark: SparkSession, d: str, p: int = 4) -> DataFrame:
    e = scan(spark, d, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"x{i + 1}") for i in range(p)])


TABLES: dict[str, str] = {
    "daily": """
  select 'S' || cast(l_suppkey as varchar) as district, cast(l_shipdate as date) as date,
         case when max(l_tax) < 0.08 then greatest(sum(l_quantity) - 25, 0.0) end as rain_mm,
         max(l_quantity) / 4 + 24 as tmax_c,
         max(case when l_returnflag <> 'N' then l_linenumber * 3.0::double end) as tmin_c
  from lineitem group by 1, 2""",
    "members": """
  select 'S' || cast(s_suppkey as varchar) as district, n_name as sub_region
  from supplier join nation on s_nationkey = n_nationkey""",
    "season_spec": """
  select * from (values ('first_season', '03-01', '07-15'), ('second_season', '08-15', '12-15'), ('annual', '01-01', '12-31')) t(season, lo, hi)""",
    "years": "select unnest(range(1995, 2002)) as year",
    "district_calendar": """
  select district, cast(year as integer) as year, season, cast(year || '-' || lo as date) as start_date, cast(year || '-' || hi as date) as end_date
  from (select distinct district from members), years, season_spec""",
    "region_calendar": """
  select sub_region as spatial_unit, cast(year as integer) as year, season, cast(year || '-' || lo as date) as start_date, cast(year || '-' || hi as date) as end_date
  from (select distinct sub_region from members), years, season_spec""",
    "monthly": """
  select 'S' || cast(l_suppkey as varchar) as district, cast(year(l_shipdate) as integer) as year, cast(month(l_shipdate) as integer) as month,
         sum(l_quantity) as rainfall_mm
  from lineitem group by 1, 2, 3""",
    "survey_sums": """
  select lower(p_type) as crop, n_name as sub_region, cast(year(l_shipdate) as integer) as year, month(l_shipdate) <= 6 as h1,
         sum(l_quantity) as area_planted_ha, sum(case when l_returnflag <> 'R' then l_quantity else 0 end) as area_harvested_ha,
         cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / 1000 as production_mt,
         sum(l_quantity * l_quantity) as q2, count(*) as n
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
  group by 1, 2, 3, 4""",
    "survey_cv": """
  select *, case when n > 1 then 100 * sqrt(greatest((q2 - area_planted_ha * area_planted_ha / n) / (n - 1), 0)) / (area_planted_ha / n) / sqrt(n) end as cv
  from survey_sums""",
    "survey": """
  select crop, sub_region, year, case when h1 then 'first_season' else 'second_season' end as season,
         area_planted_ha, area_harvested_ha, production_mt, round(cv, 4) as cv_production_pct,
         round(case when n > 2 then cv * 1.5 end, 4) as cv_area_harvested_pct, round(cv * 0.5, 4) as cv_area_planted_pct
  from survey_cv""",
    "targets": """
  select sub_region as spatial_unit, year, season, crop, production_mt / area_harvested_ha as yield_tons_ha,
         area_planted_ha, area_harvested_ha, production_mt, cv_production_pct
  from survey where area_harvested_ha > 0""",
    "predictions": """
  select spatial_unit, year, season, crop, cast(regexp_extract(spatial_unit, '([0-9]+)$', 1) as integer) % 5 + 1 as fold, model,
         'raw' as feature_space, 'raw' as target_scale, yield_tons_ha as observed_yield,
         coalesce(case when model = 'ridge' then 1.9 + area_planted_ha / 4000 else 2.2 - cv_production_pct / 100 end, 2.0::double) as predicted_yield
  from targets, (values ('ridge'), ('ols')) m(model)""",
    "vectors": """
  select vec_id, label, cast(embedding[1] as double) as x1, cast(embedding[2] as double) as x2, cast(embedding[3] as double) as x3, cast(embedding[4] as double) as x4
  from embeddings""",
}


DEPENDS = {
    "district_calendar": ["members", "years", "season_spec"],
    "region_calendar": ["members", "years", "season_spec"],
    "survey_cv": ["survey_sums"],
    "survey": ["survey_cv"],
    "targets": ["survey"],
    "predictions": ["targets"],
}


def _needs(name: str) -> list[str]:
    """Tables a table reads, in order, dependencies first."""
    return [x for t in DEPENDS.get(name, []) for x in (*_needs(t), t)]


def sql(query: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Query text with the CTEs it names, plus local ones."""
    order: list[str] = []
    for n in names:
        for t in (*_needs(n), n):
            if t not in order:
                order.append(t)
    parts = [f"{t} as ({TABLES[t]})" for t in order] + [f"{k} as ({v})" for k, v in (extra or {}).items()]
    return f"with {', '.join(parts)}\n{query}" if parts else query
