"""Spreadsheet cells to long rows.

The input is one row per cell: (workbook, sheet, row, col, value STRING), rows
and columns counted from 0. Layouts are found with grouped aggregates and the
headers meet the body through equi-joins on (sheet, col) and (sheet, row).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import settled
from ..checks import assert_empty
from ..functions.scalars import canonical_label, cell_text, parse_number, parse_year, recode

SHEET = ["workbook", "sheet"]
HEADER_ROWS = 30
MIN_HEADER_CELLS = 3
YEAR_SEARCH_ROWS = 39


def wide_headers(cells: DataFrame) -> DataFrame:
    """Per sheet: the first of the leading rows with three year cells, and the
    label column left of the first year."""
    years = cells.filter(F.col("row") < HEADER_ROWS).withColumn("year", parse_year("value")).filter("year is not null")
    rows = years.groupBy(*SHEET, "row").agg(F.count(F.lit(1)).alias("n"), F.min("col").alias("first_col"))
    best = rows.filter(F.col("n") >= MIN_HEADER_CELLS).groupBy(*SHEET).agg(F.min(F.struct("row", "first_col")).alias("h"))
    return best.select(
        *SHEET, F.col("h.row").alias("header_row"), F.greatest(F.col("h.first_col") - 1, F.lit(0)).alias("label_col")
    )


def unpivot_years(cells: DataFrame, aliases: Mapping[str, str] = K.CROP_ALIASES, groups: Sequence[str] = tuple(K.GROUP_LABELS)) -> DataFrame:
    """Sheets with years across the header: (workbook, sheet, crop, year, value, raw_label)."""
    headers = wide_headers(cells)
    placed = cells.join(headers, SHEET, "inner")
    year_cols = (
        placed.filter(F.col("row") == F.col("header_row"))
        .select(*SHEET, "col", parse_year("value").alias("year"))
        .filter("year is not null")
    )
    body = placed.filter(F.col("row") > F.col("header_row"))
    texts = body.filter((F.col("col") == F.col("label_col")) | (F.col("col") == 0)).groupBy(*SHEET, "row").agg(
        F.max(F.when(F.col("col") == F.col("label_col"), F.col("value"))).alias("near"),
        F.max(F.when(F.col("col") == 0, F.col("value"))).alias("far"),
    )
    texts = texts.withColumns({"m1": canonical_label("near", aliases, groups), "m2": canonical_label("far", aliases, groups)})
    use_near = F.col("m1.canonical").isNotNull() | F.col("m1.is_group")
    labels = texts.select(
        *SHEET,
        "row",
        F.when(use_near, F.col("m1.canonical")).otherwise(F.col("m2.canonical")).alias("crop"),
        cell_text(F.when(use_near, F.col("near")).otherwise(F.col("far"))).alias("raw_label"),
    ).filter("crop is not null")
    numbers = body.select(*SHEET, "row", "col", parse_number("value").alias("value")).filter("value is not null")
    return (
        numbers.join(year_cols, [*SHEET, "col"], "inner")
        .join(labels, [*SHEET, "row"], "inner")
        .select(*SHEET, "crop", "year", "value", "raw_label")
    )


def unpivot_labels(cells: DataFrame, aliases: Mapping[str, str] = K.CROP_ALIASES, groups: Sequence[str] = tuple(K.GROUP_LABELS)) -> DataFrame:
    """Transposed sheets: years down a column, labels across a header row."""
    # header candidates, year columns and chosen headers are a few rows per sheet
    heads = settled(
        cells.filter(F.col("row") < HEADER_ROWS)
        .withColumn("crop", canonical_label("value", aliases, groups)["canonical"])
        .filter("crop is not null")
        .select(*SHEET, F.col("row").alias("header_row"), "col", "crop", cell_text("value").alias("raw_label"))
    )
    rows = heads.groupBy(*SHEET, "header_row").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_HEADER_CELLS)
    years = cells.withColumn("year", parse_year("value")).filter("year is not null").select(*SHEET, "row", "col", "year")
    ahead = rows.drop("n").join(years, SHEET, "inner").filter(F.col("row") > F.col("header_row"))
    year_col = (
        ahead.filter(F.col("row") <= F.col("header_row") + YEAR_SEARCH_ROWS)
        .groupBy(*SHEET, "header_row")
        .agg(F.min(F.struct("row", "col"))["col"].alias("year_col"))
    )
    year_rows = ahead.join(year_col, [*SHEET, "header_row"], "inner").filter(F.col("col") == F.col("year_col"))
    numbers = cells.select(*SHEET, "row", "col", parse_number("value").alias("value")).filter("value is not null")
    records = (
        year_rows.select(*SHEET, "header_row", "row", "year")
        .join(heads, [*SHEET, "header_row"], "inner")
        .join(numbers, [*SHEET, "row", "col"], "inner")
    )
    first = records.groupBy(*SHEET).agg(F.min("header_row").alias("header_row"))
    return records.join(first, [*SHEET, "header_row"], "left_semi").select(*SHEET, "crop", "year", "value", "raw_label")


def parse_sheets(cells: DataFrame, strict: bool = True, **vocabulary) -> DataFrame:
    """Wide layout first; sheets it does not fit are read as transposed. A
    workbook without any table raises."""
    wide = unpivot_years(cells, **vocabulary)
    done = settled(wide.select(*SHEET).distinct())
    rest = cells.join(done, SHEET, "left_anti")
    out = wide.unionByName(unpivot_labels(rest, **vocabulary))
    if strict:
        books = cells.select("workbook").distinct()
        assert_empty(books.join(out.select("workbook").distinct(), "workbook", "left_anti"), "no crop/year table in")
    return out


def unpivot_blocks(
    cells: DataFrame, spec: DataFrame, fields: Sequence[str], rows: tuple[int, int], entity_col: int = 0
) -> DataFrame:
    """Blocks described by a spec (season, col, field): one row per entity and season
    with named measures. Rows without any number, blank and ``notes`` entities go."""
    body = cells.filter(F.col("row").between(*rows))
    name = F.trim("value")
    entities = body.filter((F.col("col") == entity_col) & (name != "") & ~F.lower(name).startswith("notes")).select(
        *SHEET, "row", name.alias("entity")
    )
    values = body.join(spec, "col", "inner").select(*SHEET, "row", "season", "field", parse_number("value").alias("v"))
    wide = values.groupBy(*SHEET, "row", "season").pivot("field", list(fields)).agg(F.max("v"))
    kept = wide.filter(F.coalesce(*[F.col(f) for f in fields]).isNotNull())
    return kept.join(entities, [*SHEET, "row"], "inner").select(*SHEET, "entity", "season", *fields)


def header_members(cells: DataFrame, header_row: int = 0) -> DataFrame:
    """Wide sheet of groups: the header names the group, the cells below its members."""
    text = F.trim("value")
    filled = cells.filter(text != "")
    heads = filled.filter(F.col("row") == header_row).select(*SHEET, "col", text.alias("group_name"))
    body = filled.filter(F.col("row") > header_row).select(*SHEET, "col", text.alias("member"))
    return body.join(heads, [*SHEET, "col"], "inner").select(*SHEET, "member", "group_name")


def detect_grain(
    cells: DataFrame,
    country: str,
    subregions: Sequence[str] = tuple(K.SUBREGION_NAMES),
    regions: Sequence[str] = tuple(K.REGION_NAMES),
    hints: Mapping[str, str] = K.HEADER_HINTS,
) -> DataFrame:
    """Geographic grain of each workbook from its text cells."""
    text = cell_text("value")
    national = [country, "national", f"all {country}"]
    words = cells.withColumns({"t": text, "numeric": parse_number("value").isNotNull()}).filter("t <> '' and not numeric")
    words = words.withColumn("hint", recode("t", hints))
    facts = words.groupBy("workbook").agg(
        F.count(F.lit(1)).alias("text_cells"),
        F.min_by("hint", F.when(F.col("hint").isNotNull(), F.struct("sheet", "row", "col"))).alias("header_hint"),
        F.countDistinct(F.when(F.col("t").isin(*subregions), F.col("t"))).alias("subregion_names"),
        F.countDistinct(F.when(F.col("t").isin(*regions) & ~F.col("t").isin(*subregions), F.col("t"))).alias("region_names"),
        F.count_if(F.col("t").isin(*national)).alias("national_cells"),
    )
    no_places = (F.col("subregion_names") == 0) & (F.col("region_names") == 0)
    hint = F.coalesce("header_hint", F.lit(""))
    grain = (
        F.when(hint.isin("subregion", "zardi") | (F.col("subregion_names") >= 5), "subregion")
        .when(hint == "district", "district")
        .when((hint == "region") | (F.col("region_names") >= 3), "region")
        .when(no_places & (F.col("text_cells") > 0), "national")
        .otherwise("unknown")
    )
    return facts.withColumn("grain", grain)
