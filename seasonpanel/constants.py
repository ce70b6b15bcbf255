"""Fixed values. They must be the same everywhere for results to agree; every
operator takes them as a parameter default."""

from __future__ import annotations

PANEL_KEY = ["spatial_unit", "year", "season", "crop"]
ENVIRONMENT_KEY = ["spatial_unit", "year", "season"]

# --- fixed values: rainfall and temperature thresholds -----------------------
WET_DAY_MM = 1.0
RAINY_DAY_MM = 10.0
HEAVY_RAIN_MM = 20.0
ONSET_TOTAL_MM = 20.0
ONSET_DAYS = 3
ONSET_FOLLOWUP_DAYS = 15
DRY_SPELL_DAYS = 7
ROLLING_DAYS = 5
FIRST_WINDOW_DOY = (60, 182)
SECOND_WINDOW_DOY = (213, 334)
FIRST_MONTHS = [3, 4, 5, 6]
SECOND_MONTHS = [8, 9, 10, 11]
GDD_BASE_C = 10.0
HEAT_C = 32.0
EXTREME_HEAT_C = 35.0
COLD_C = 10.0
OLDER_HEAT_C = 30.0
WARM_NIGHT_C = 20.0
HEATWAVE_DAYS = 3
KELVIN_ZERO = 273.15
MISSING_READING = -999.0

# --- fixed values: month groups (December belongs to its own calendar year) --
MONTH_GROUPS = {"MAM": [3, 4, 5], "SON": [9, 10, 11], "DJF": [12, 1, 2], "JJA": [6, 7, 8]}
RAINY_MONTH_MM = 50.0
BASELINE_YEARS = (1981, 2010)

# --- fixed values: season calendar (month-day start, month-day end) ----------
SEASON_SPEC = {
    "first_season": ("03-01", "07-15"),
    "second_season": ("08-15", "12-15"),
    "annual": None,
}
SEASON_NORMALISATION = {
    "first_season_2020": "first_season",
    "second_season_2020": "second_season",
}

# --- fixed values: soil ------------------------------------------------------
SOIL_PROPERTIES = ["clay", "sand", "silt", "soc", "bdod", "cec", "phh2o"]
SOIL_RENAMES = {
    "clay": "clay_pct",
    "sand": "sand_pct",
    "silt": "silt_pct",
    "soc": "soil_organic_carbon",
    "bdod": "bulk_density",
    "cec": "cation_exchange_capacity",
    "phh2o": "soil_ph",
}
DEPTH_WEIGHTS = {"0-5cm": 5.0, "5-15cm": 10.0, "15-30cm": 15.0}

# --- fixed values: source grades ---------------------------------------------
SOURCE_GRADES = {
    "AAS2020_subregion": "A",
    "AAS2018_subregion": "A",
    "AAS2020_zardi": "B",
    "AAS2018_zardi": "B",
    "CHIRPS_v2.0_monthly": "A",
    "CHIRPS_v2.0_daily_climateserv": "A",
    "UBOS_station": "D",
    "NASA_POWER_daily": "A",
    "ERA5_Land": "A",
    "CHIRTS_ERA5": "A",
    "C3S_AgERA5": "A",
    "SoilGrids_v2.0": "A",
    "WoSIS": "A",
    "C3S_SOILMOISTURE": "A",
    "synthetic_generator": "E",
    "missing": "F",
}
PROVENANCE_COLUMNS = [
    "yield_source",
    "rainfall_source",
    "temperature_source",
    "soil_source",
    "soil_moisture_source",
    "yield_granularity",
    "is_proxy",
    "is_imputed",
    "data_quality_score",
    "data_quality_note",
]

# --- fixed values: label vocabulary ------------------------------------------
CROP_ALIASES = {
    "maize": "maize",
    "millet": "millet",
    "finger millet": "millet",
    "sorghum": "sorghum",
    "rice": "rice",
    "cassava": "cassava",
    "s/potatoes": "sweet_potatoes",
    "sweet potatoes": "sweet_potatoes",
    "sweet potato": "sweet_potatoes",
    "irish": "irish_potatoes",
    "irish potatoes": "irish_potatoes",
    "irish potato": "irish_potatoes",
    "beans": "beans",
    "gnuts": "groundnuts",
    "g.nuts": "groundnuts",
    "groundnuts": "groundnuts",
    "ground nuts": "groundnuts",
    "soya beans": "soya_beans",
    "soyabeans": "soya_beans",
    "soya": "soya_beans",
    "plantain bananas (all types)": "banana",
    "plantain bananas(all types)": "banana",
    "plantain bananas": "banana",
    "banana food": "banana",
    "matooke": "banana",
    "simsim": "simsim",
    "sesame": "simsim",
    "cow peas": "cowpeas",
    "cowpeas": "cowpeas",
    "field peas": "field_peas",
    "pigeon peas": "pigeon_peas",
}
GROUP_LABELS = [
    "cereals", "cereals total", "total cereals",
    "roots and tubers", "roots & tubers", "root crops",
    "pulses", "legumes",
    "oil crops", "oilcrops",
    "plantains", "bananas",
    "total", "grand total", "all crops", "others",
]
SUBREGION_NAMES = [
    "acholi", "ankole", "bugisu", "bukedi", "bunyoro", "busoga",
    "elgon", "karamoja", "kigezi", "lango", "rwenzori", "teso", "tooro",
    "toro", "west nile", "westnile",
    "south buganda", "southern buganda", "s.buganda", "s buganda",
    "north buganda", "northern buganda", "n.buganda", "n buganda",
]
REGION_NAMES = ["central", "eastern", "northern", "western"]
HEADER_HINTS = {
    "subregion": "subregion",
    "sub-region": "subregion",
    "sub region": "subregion",
    "region": "region",
    "district": "district",
    "zardi": "zardi",
}
YEAR_RANGE = (2000, 2025)
NUMBER_NA_MARKERS = ["", "-", "--", "..", "na", "n/a", "nan"]
REGION_SYNONYMS = {"S. Buganda": "South Buganda", "N. Buganda": "North Buganda"}

# --- fixed values: printed totals used as anchors ----------------------------
PRODUCTION_ANCHORS = [
    ("millet", 2018, 141982.0),
    ("sorghum", 2018, 268493.0),
    ("beans", 2018, 727652.0),
    ("groundnuts", 2018, 253279.0),
    ("soya_beans", 2018, 107624.0),
    ("maize", 2015, 2812919.0),
    ("sorghum", 2015, 410720.0),
    ("rice", 2015, 238193.0),
    ("millet", 2015, 236484.0),
]
AREA_ANCHORS = [
    ("maize", 2018, 2480097.0),
    ("millet", 2018, 282607.0),
    ("sorghum", 2018, 491911.0),
    ("rice", 2018, 199538.0),
    ("cassava", 2018, 1705942.0),
    ("beans", 2018, 1205509.0),
    ("groundnuts", 2018, 515041.0),
    ("soya_beans", 2018, 189710.0),
]
ANCHOR_TOLERANCE = 0.005

# --- fixed values: predictor catalog and columns that leak the target --------
CLIMATE_FEATURES = [
    "rain_total_mm",
    "rainy_days_1mm",
    "heavy_rain_days_20mm",
    "maximum_5day_rainfall_mm",
    "longest_dry_spell_days",
    "wet_day_rainfall_cv",
    "temperature_mean_c",
    "temperature_maximum_c",
    "growing_degree_days",
    "heat_days_32c",
]
SOIL_FEATURES = [
    "soil_ph",
    "soil_organic_carbon",
    "clay_pct",
    "sand_pct",
    "silt_pct",
    "bulk_density",
    "cation_exchange_capacity",
]
STATIC_FEATURES = [*SOIL_FEATURES, "elevation_m", *[f"{c}_sd" for c in SOIL_FEATURES], "elevation_m_sd"]
CATEGORICAL_FEATURES = ["season", "crop"]
ALLOWED_SOURCE_TYPES = ["official_aggregate", "observed_survey"]
TARGET_DERIVED_COLUMNS = [
    "yield_tons_ha",
    "yield_tons_ha_planted",
    "production_mt",
    "area_harvested_ha",
    "area_planted_ha",
    "total_production_kg",
    "total_area_ha",
]
SOURCE_PREFIXES = {
    "rain_": "CHIRPS (monthly)",
    "daily_": "CHIRPS (daily)",
    "temp_": "NASA POWER (daily)",
    "soil_": "SoilGrids",
    "cv_": "UBOS AAS survey",
}

# --- fixed values: column order of the finished panel ------------------------
PANEL_COLUMNS = [
    *PANEL_KEY,
    "target_temporal_granularity",
    "yield_tons_ha", "yield_tons_ha_planted", "harvested_fraction",
    "area_planted_ha", "area_harvested_ha", "production_mt",
    "cv_area_planted_pct", "cv_area_harvested_pct", "cv_production_pct",
    "rain_total_mm", "rain_mean_daily_mm", "rainy_days_1mm", "rainy_days_10mm",
    "heavy_rain_days_20mm", "maximum_1day_rainfall_mm", "maximum_5day_rainfall_mm",
    "longest_dry_spell_days", "wet_day_rainfall_cv",
    "rainfall_onset_date", "rainfall_cessation_date",
    "onset_day_of_year", "cessation_day_of_year", "season_length_days",
    "temperature_mean_c", "temperature_maximum_c", "temperature_minimum_c",
    "temperature_range_c", "growing_degree_days",
    "heat_days_32c", "extreme_heat_days_35c", "cold_days_10c",
    "target_source", "target_source_type", "target_geographic_level",
    "predictor_geographic_level", "target_definition", "target_year", "target_season",
    "is_proxy", "is_synthetic", "is_geographically_assigned",
    "season_definition", "yield_consistency_ok",
    "rainfall_source", "temperature_source", "soil_source", "soil_source_version",
    "soil_depth_cm", "soil_quality_flag", "soil_district_count",
    *[name for base in SOIL_FEATURES for name in (base, f"{base}_sd")],
    "elevation_m", "elevation_m_sd", "elevation_source",
    "data_version", "processing_version",
]
