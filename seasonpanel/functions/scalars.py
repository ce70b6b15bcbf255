"""Column functions: text, number, date and label helpers. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: Column | str) -> Column:
    """Trim every kind of white space, no-break spaces included."""
    return F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", "")


def title_case(col: Column | str) -> Column:
    """Upper-case each letter that follows a non-letter, lower-case the rest."""
    pieces = F.split(F.lower(_c(col)), r"(?<=[^\p{L}])")
    capitalise = lambda p: F.concat(F.upper(p.substr(F.lit(1), F.lit(1))), p.substr(F.lit(2), F.length(p)))
    return F.array_join(F.transform(pieces, capitalise), "")


def district_name(col: Column | str) -> Column:
    text = F.regexp_replace(F.regexp_replace(strip(col), "_", " "), r"(?U)\s+", " ")
    return title_case(text)


def cell_text(col: Column | str) -> Column:
    """Normal form of a spreadsheet cell for vocabulary matching."""
    text = F.lower(strip(F.coalesce(_c(col), F.lit(""))))
    return F.regexp_replace(F.regexp_replace(text, "[–—]", "-"), r"(?U)\s+", " ")


def parse_year(col: Column | str, year_range: tuple[int, int] = K.YEAR_RANGE) -> Column:
    text = strip(col)
    year = F.regexp_extract(text, r"^((?:19|20)\d{2})(?:\.0+)?$", 1).try_cast("int")
    return F.when(year.between(*year_range), year)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parse_number(col: Column | str, na_markers: Sequence[str] = K.NUMBER_NA_MARKERS) -> Column:
    """Number in a cell: no thousands commas, footnote letters or NA markers."""

    def number(text: Column) -> Column:
        stripped = F.regexp_replace(text, r"[a-zA-Z*]+$", "").try_cast("double")
        finite = let(stripped, lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x))
        return F.when(~F.lower(text).isin(*na_markers), finite)

    return let(F.regexp_replace(strip(col), "[,\u00a0]", ""), number)


def to_number(col: Column | str) -> Column:
    """Numeric coercion: invalid text becomes NULL."""
    return _c(col).try_cast("double")


def recode(col: Column | str, mapping: Mapping[str, object]) -> Column:
    """Value of a small constant map, NULL where unmapped."""
    flat = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.create_map(*flat)[_c(col)]


def canonical_label(
    col: Column | str,
    aliases: Mapping[str, str] = K.CROP_ALIASES,
    group_labels: Sequence[str] = K.GROUP_LABELS,
    slack: int = 12,
) -> Column:
    """struct(canonical, is_group): group rows are flagged; then exact alias, alias
    without the bracketed part, and prefix match in dictionary order."""
    groups = list(group_labels)

    def match(text: Column, bare: Column) -> Column:
        is_group = text.isin(*groups) | bare.isin(*groups)
        prefix = F.coalesce(
            *[F.when(text.startswith(a) & (F.length(text) <= len(a) + slack), F.lit(c)) for a, c in aliases.items()]
        )
        canonical = F.coalesce(recode(text, aliases), recode(bare, aliases), prefix)
        return F.struct(
            F.when(~is_group & (text != ""), canonical).alias("canonical"), (is_group & (text != "")).alias("is_group")
        )

    without_brackets = lambda text: strip(F.regexp_replace(text, r"\s*\(.*?\)\s*", " "))
    return let(cell_text(col), lambda text: let(without_brackets(text), lambda bare: match(text, bare)))


def month_group(month: Column | str, groups: Mapping[str, Sequence[int]] = K.MONTH_GROUPS) -> Column:
    out = None
    for name, months in groups.items():
        cond = _c(month).isin(*months)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def kelvin_to_celsius(col: Column | str) -> Column:
    return _c(col) - F.lit(K.KELVIN_ZERO)


def days_in_month(date: Column | str) -> Column:
    return F.dayofmonth(F.last_day(_c(date)))


def degree_days(mean_c: Column | str, base: float = K.GDD_BASE_C) -> Column:
    """max(mean - base, 0), NULL for a missing mean."""
    return F.when(_c(mean_c).isNotNull(), F.greatest(_c(mean_c) - base, F.lit(0.0)))


def clip_at_zero(col: Column | str) -> Column:
    return F.when(_c(col).isNotNull(), F.greatest(_c(col), F.lit(0.0)))


def source_of_column(name: Column | str, prefixes: Mapping[str, str] = K.SOURCE_PREFIXES) -> Column:
    out = None
    for prefix, source in prefixes.items():
        cond = _c(name).startswith(prefix)
        out = F.when(cond, source) if out is None else out.when(cond, source)
    return out.otherwise("derived")


def latitude_weight(lat: Column | str) -> Column:
    return F.cos(F.radians(_c(lat)))


def quality_grade(source: Column | str, grades: Mapping[str, str] = K.SOURCE_GRADES) -> Column:
    return F.coalesce(recode(source, grades), F.lit("F"))


def quality_band(cv_area: Column | str, cv_production: Column | str) -> Column:
    """Band of the larger of two CVs; a missing one is ignored."""
    worst = F.greatest(_c(cv_area), _c(cv_production))
    return (
        F.when(worst.isNull(), F.lit(None).cast("string"))
        .when(worst <= 15, "higher_precision")
        .when(worst <= 30, "moderate_precision")
        .when(worst <= 50, "low_precision")
        .otherwise("very_low_precision")
    )


def first_at_depth(depths: Column, label: str) -> Column:
    """First non-null reading: at the wanted depth in the order mean, Q0.5,
    median; else the first non-null reading of any depth."""
    reading = lambda d: F.coalesce(d["mean"], d["q50"], d["median"])
    first = lambda arr: F.try_element_at(F.filter(F.transform(arr, reading), lambda v: v.isNotNull()), F.lit(1))
    return F.coalesce(first(F.filter(depths, lambda d: d["label"] == label)), first(depths))


def reading_status(*readings: Column) -> Column:
    """A record whose readings are all missing is 'empty_values', whether or not
    the payload had properties; otherwise 'ok'."""
    return F.when(F.coalesce(*readings).isNull(), "empty_values").otherwise("ok")


def back_transform_log(col: Column | str) -> Column:
    return F.expm1(_c(col))
