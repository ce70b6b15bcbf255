"""Projections, filters and flags that turn raw survey rows into panel targets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..checks import assert_empty, require_columns, try_divide
from ..functions.scalars import quality_grade, recode, strip, to_number


def keep_columns(df: DataFrame, key: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Key plus the listed features that exist."""
    return df.select(*key, *[c for c in features if c in df.columns and c not in key])


def prefix_columns(df: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in keys else F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def drop_provenance(df: DataFrame, columns: Sequence[str] = tuple(K.PROVENANCE_COLUMNS)) -> DataFrame:
    return df.drop(*[c for c in columns if c in df.columns])


def select_survey_rows(df: DataFrame, crop: str | None = None, national: str | None = None) -> DataFrame:
    """Normalise the crop label; drop derived total rows and the national row."""
    out = df.withColumn("crop", F.lower(strip("crop")))
    if crop is not None:
        out = out.filter(F.col("crop") == crop.lower())
    out = out.filter(~F.col("season_group").startswith("total"))
    return out.filter(F.col("sub_region") != national) if national else out


def valid_targets(df: DataFrame) -> DataFrame:
    return df.filter(
        F.col("production_mt").isNotNull() & F.col("area_harvested_ha").isNotNull() & (F.col("area_harvested_ha") > 0)
    )


def keep_members(df: DataFrame, column: str, allowed: Sequence[str] | DataFrame) -> DataFrame:
    """Rows whose value is in a short list, or in the same-named column of a table."""
    if isinstance(allowed, DataFrame):
        return df.join(allowed.select(column).distinct(), column, "left_semi")
    return df.filter(F.col(column).isin(*allowed))


def year_window(df: DataFrame, first: int, last: int) -> DataFrame:
    return df.filter(F.col("year").between(first, last))


def recode_column(df: DataFrame, source: str, out: str, mapping: Mapping[str, object], strict: bool = True) -> DataFrame:
    """Recode through a constant map. ``strict`` raises and lists unmapped values."""
    coded = df.withColumn(out, recode(source, mapping))
    if strict:
        assert_empty(unmapped_values(df, source, mapping), f"unmapped values in {source}")
    return coded


def unmapped_values(df: DataFrame, source: str, mapping: Mapping[str, object]) -> DataFrame:
    return df.filter(recode(source, mapping).isNull()).select(source).distinct()


def yield_columns(df: DataFrame) -> DataFrame:
    """Yield over harvested and planted area and the harvested fraction."""
    ratio = lambda num, den: F.when(F.col(den) > 0, F.col(num) / F.col(den))
    return df.withColumns(
        {
            "yield_tons_ha": ratio("production_mt", "area_harvested_ha"),
            "yield_tons_ha_planted": ratio("production_mt", "area_planted_ha"),
            "harvested_fraction": ratio("area_harvested_ha", "area_planted_ha"),
        }
    )


def harvest_loss(harvested: str = "area_harvested_ha", planted: str = "area_planted_ha") -> Column:
    return F.lit(1.0) - try_divide(F.col(harvested), F.col(planted))


def target_provenance(df: DataFrame, year: int | Column, source: str, definition: str, level: str = "sub_region") -> DataFrame:
    """Constant columns that say where a target came from."""
    return df.withColumns(
        {
            "spatial_unit": F.col("sub_region"),
            "spatial_level": F.lit(level),
            "target_source": F.lit(source),
            "target_source_type": F.lit("official_aggregate"),
            "target_geographic_level": F.lit(level),
            "predictor_geographic_level": F.lit(level),
            "target_definition": F.lit(definition),
            "target_year": year if isinstance(year, Column) else F.lit(year),
            "target_season": F.col("season"),
            "is_proxy": F.lit(False),
            "is_synthetic": F.lit(False),
            "is_geographically_assigned": F.lit(False),
        }
    )


SURVEY_NUMBERS = [
    "area_planted_ha", "area_harvested_ha", "production_mt",
    "cv_area_planted_pct", "cv_area_harvested_pct", "cv_production_pct",
]
TARGET_COLUMNS = [
    *K.PANEL_KEY, "yield_tons_ha", "yield_tons_ha_planted", "harvested_fraction", *SURVEY_NUMBERS,
    "target_source", "target_source_type", "target_geographic_level", "predictor_geographic_level",
    "target_definition", "target_year", "target_season",
    "is_proxy", "is_synthetic", "is_geographically_assigned", "season_definition", "yield_consistency_ok",
]


def seasonal_targets(
    survey: DataFrame,
    year: int,
    source: str,
    crop: str | None = None,
    national: str | None = None,
    seasons: Mapping[str, str] = K.SEASON_NORMALISATION,
    strict: bool = True,
) -> DataFrame:
    """Season-block survey rows to targets; yield is recomputed from the totals."""
    require_columns(survey, ["crop", "sub_region", "season_group", *SURVEY_NUMBERS], "seasonal survey")
    rows = select_survey_rows(survey, crop, national)
    rows = valid_targets(rows.withColumns({c: to_number(c) for c in SURVEY_NUMBERS}))
    rows = recode_column(rows.withColumn("year", F.lit(year)), "season_group", "season", seasons, strict)
    rows = target_provenance(yield_columns(rows), year, source, "production_mt_divided_by_area_harvested_ha")
    rows = rows.withColumns(
        {"season_definition": F.lit("surveyed_seasonal_block"), "yield_consistency_ok": F.lit(True)}
    )
    return rows.select(*TARGET_COLUMNS)


def annual_targets(
    survey: DataFrame, year: int, source: str, national: str | None = None, crops: Sequence[str] | None = None
) -> DataFrame:
    """Annual survey rows to targets. The published yield is kept, never recomputed,
    and flagged as inconsistent with the totals beside it."""
    need = ["crop", "sub_region", "area_planted_ha", "area_harvested_ha", "production_mt", "cv_production_pct", "yield_over_harvested"]
    require_columns(survey, need, "annual survey")
    numbers = [c for c in [*SURVEY_NUMBERS, "yield_over_harvested"] if c in survey.columns]
    rows = survey.withColumns({c: to_number(c) for c in numbers})
    rows = rows.withColumns({c: F.lit(None).cast("double") for c in SURVEY_NUMBERS if c not in survey.columns})
    rows = rows.withColumn("crop", F.lower(strip("crop")))
    if national:
        rows = rows.filter(F.col("sub_region") != national)
    if crops is not None:
        rows = keep_members(rows, "crop", [c.lower() for c in crops])
    rows = valid_targets(rows).dropna(subset=["yield_over_harvested"])
    rows = yield_columns(rows.withColumns({"year": F.lit(year), "season": F.lit("annual")}))
    rows = rows.withColumn("yield_tons_ha", F.col("yield_over_harvested"))
    rows = target_provenance(rows, year, source, "published_official_subregion_yield_over_harvested")
    rows = rows.withColumns(
        {"season_definition": F.lit("published_annual_aggregate_total_and_s2_harvested_area"), "yield_consistency_ok": F.lit(False)}
    )
    return rows.select(*TARGET_COLUMNS)


def granularity(season: str | Column = "season") -> Column:
    col = F.col(season) if isinstance(season, str) else season
    return F.when(col == "annual", "annual").otherwise("seasonal")


def pin_order(df: DataFrame, data_version: str, processing_version: str, order: Sequence[str] = tuple(K.PANEL_COLUMNS)) -> DataFrame:
    """Granularity tag, version columns and the fixed column order, unknown columns
    last. Rows are sorted by the sink, not here."""
    out = df.withColumns(
        {
            "target_temporal_granularity": granularity(),
            "data_version": F.lit(data_version),
            "processing_version": F.lit(processing_version),
        }
    )
    return out.select(*[c for c in order if c in out.columns], *[c for c in out.columns if c not in order])


def conform(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Exactly the columns of ``schema`` (name to type) in order; absent ones NULL."""
    return df.select(
        *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in schema.items()]
    )


def override_with_source(original: str, override: str, source: str, default: str) -> dict[str, Column]:
    """Take the override where present and stamp each row with its origin."""
    return {
        f"original_{original}": F.col(original),
        original: F.coalesce(F.col(override), F.col(original)),
        f"{original}_source": F.when(F.col(override).isNotNull(), source).otherwise(default),
    }


def repair_numbers(df: DataFrame, raw: str, num: str, den: str, out: str = "yield_over_harvested", note: str = "recomputed from totals") -> DataFrame:
    """Text that should be a number but is not is recomputed as ``num / den`` and
    marked as imputed with grade C."""
    value = to_number(raw)
    junk = F.col(raw).isNotNull() & value.isNull()
    return df.withColumns(
        {
            out: F.when(junk, try_divide(F.col(num), F.col(den))).otherwise(value),
            "is_imputed": junk,
            "data_quality_score": F.when(junk, "C").otherwise("A"),
            "data_quality_note": F.when(junk, note).otherwise(""),
        }
    )


def reliability(df: DataFrame, cv: str = "cv_production_pct", threshold: float = 30.0, published: str = "yield_over_harvested") -> DataFrame:
    """Survey reliability columns and the published-yield consistency flag.

    A column of CVs that is entirely missing gives three NULL columns; that is
    decided by one aggregate, joined back as a single row.
    """
    any_cv = df.agg((F.count(F.col(cv)) > 0).alias("_any")) if cv in df.columns else None
    value = to_number(cv) if cv in df.columns else F.lit(None).cast("double")
    out = df.join(F.broadcast(any_cv), F.lit(True), "left") if any_cv is not None else df.withColumn("_any", F.lit(False))
    weight = F.when(value == 0, 10.0).otherwise(F.least(F.lit(100.0) / F.nullif(value, F.lit(0.0)), F.lit(10.0)))
    calc = try_divide(F.col("production_mt"), F.col("area_harvested_ha"))
    close = F.abs(calc - F.col(published)) <= 0.02 * F.abs(F.col(published))
    return out.withColumns(
        {
            "target_cv": value,
            "target_reliability_weight": F.when(value.isNotNull(), weight),
            "high_uncertainty_flag": F.when(F.col("_any"), F.when(value >= threshold, 1).otherwise(0)),
            "yield_consistency_ok": F.coalesce((calc == 0) | close, F.lit(False)),
        }
    ).drop("_any")


def certain_targets(df: DataFrame, cv: str = "cv_production_pct", maximum: float = 30.0) -> DataFrame:
    """Rows whose CV is known and at most ``maximum``."""
    return require_columns(df, [cv]).filter(F.col(cv) <= maximum)


def vegetation_qualifier(df: DataFrame, observed: str = "observation_date", harvest: str = "harvest_date") -> DataFrame:
    require_columns(df, [observed, harvest], "vegetation features")
    numeric = {c: to_number(c) for c in df.columns if c.lower().startswith(("ndvi", "evi"))}
    timing = F.when(F.to_date(observed) <= F.to_date(harvest), "pre_harvest").otherwise("retrospective")
    return df.withColumns({**numeric, "feature_timing": timing})


def add_provenance(
    df: DataFrame,
    sources: Mapping[str, str | None],
    yield_granularity: str | None = None,
    is_proxy: bool = False,
    is_imputed: bool = False,
    note: str = "",
    grade: str | None = None,
) -> DataFrame:
    """Existing per-row sources win, constants fill the rest; the grade follows the
    yield source unless overridden."""
    names = ["yield_source", "rainfall_source", "temperature_source", "soil_source", "soil_moisture_source"]
    constants = {n: sources.get(n) for n in names} | {"yield_granularity": yield_granularity}
    filled = {}
    for name, value in constants.items():
        literal = F.lit(value).cast("string")
        filled[name] = F.coalesce(F.col(name), literal) if name in df.columns else literal
    out = df.withColumns(filled)
    flags = {"is_proxy": is_proxy, "is_imputed": is_imputed}
    out = out.withColumns({n: F.lit(v) for n, v in flags.items() if n not in df.columns} or {"is_proxy": F.col("is_proxy")})
    score = F.lit(grade) if grade else quality_grade("yield_source")
    return out.withColumns({"data_quality_score": score, "data_quality_note": F.lit(note)})


def coverage_table(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Share of rows with a usable number, per column, from one pass."""
    cols = [c for c in df.columns if c not in exclude]
    one = df.agg(*[F.avg(F.expr(f"try_cast(`{c}` as double)").isNotNull().cast("double")).alias(c) for c in cols])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("non_null_fraction")) for c in cols])
    return one.select(F.explode(cells).alias("c")).select("c.*")


def covered_predictors(df: DataFrame, exclude: Sequence[str] = (), minimum: float = 0.6) -> tuple[DataFrame, list[str]]:
    """Columns whose coverage reaches ``minimum``. The driver sees one row per column."""
    table = coverage_table(df, exclude).filter(F.col("non_null_fraction") >= minimum)
    names = [r.feature for r in table.select("feature").collect()]
    if not names:
        raise ValueError("no numeric predictor reaches the coverage threshold")
    return table, [c for c in df.columns if c in names]


def complete_case_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Listed columns without a single missing value."""
    from .agg import missingness

    present = [c for c in columns if c in df.columns]
    return missingness(df, present).filter("missing_count = 0").select("column")


def complete_rows(df: DataFrame, subset: Sequence[str] | None = None, how: str = "any") -> tuple[DataFrame, DataFrame]:
    """Complete rows, and a one-row table of kept and dropped counts."""
    cols = list(subset or df.columns)
    missing = [F.col(c).isNull() for c in cols]
    bad = missing[0]
    for m in missing[1:]:
        bad = (bad | m) if how == "any" else (bad & m)
    counts = df.agg(F.count_if(~bad).alias("kept"), F.count_if(bad).alias("dropped"))
    return df.filter(~bad), counts


def target_gaps(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Differences between every two target columns of a row."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return df.withColumns({f"{a}_minus_{b}": F.col(a) - F.col(b) for a, b in pairs})


def fill_from_lookup(df: DataFrame, lookup: DataFrame, key: str, columns: Sequence[str], status: str = "lookup_status") -> DataFrame:
    """Fill missing attributes from a lookup keyed by name; rows still without any
    attribute are marked."""
    side = lookup.select(key, *[F.col(c).alias(f"_l_{c}") for c in columns])
    out = df.join(side, key, "left").withColumns({c: F.coalesce(F.col(c), F.col(f"_l_{c}")) for c in columns})
    label = F.when(F.coalesce(*[F.col(c) for c in columns]).isNull(), "empty_values").otherwise("ok")
    return out.withColumn(status, label).drop(*[f"_l_{c}" for c in columns])


def log_target(column: str = "yield_tons_ha", out: str = "log_target") -> dict[str, Column]:
    return {out: F.log1p(F.col(column))}
