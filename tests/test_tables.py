"""Cleaning, joins, sets, cells, polygons, gates, sources and sinks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from seasonpanel import constants as K
from seasonpanel.checks import assert_unique_key, nan_to_null, require_columns
from seasonpanel.functions import scalars as S
from seasonpanel.operators import agg, cells, clean, joins, quality, ranks, sets, spatial
from seasonpanel.sources import payloads, sinks, tables


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_polygon_mean_of_four_cells(spark):
    rows = [(dt.date(2020, 1, t + 1), float(la), float(lo), float(4 * t + 2 * la + lo)) for t in (0, 1) for la in (0, 1) for lo in (0, 1)]
    grid = spark.createDataFrame(rows, "time date, latitude double, longitude double, precip double")
    ring = [(-1.0, -1.0), (2.0, -1.0), (2.0, 2.0), (-1.0, 2.0)]
    shapes = spark.createDataFrame([("u", [ring])], "spatial_unit string, rings array<array<struct<lon: double, lat: double>>>")
    got = [r["precip"] for r in spatial.polygon_daily_mean(grid, shapes).orderBy("date").collect()]
    assert got == pytest.approx([1.5, 5.5], abs=1e-3)
    far = spark.createDataFrame([("v", [[(50.0, 50.0), (51.0, 50.0), (51.0, 51.0)]])], shapes.schema)
    with pytest.raises(ValueError, match="polygons without"):
        spatial.polygon_daily_mean(grid, far, strict=True)


def test_hole_is_honoured_unless_outer_ring_only(spark):
    grid = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0)], "latitude double, longitude double")
    outer = [(-0.5, -0.5), (4.5, -0.5), (4.5, 4.5), (-0.5, 4.5)]
    hole = [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)]
    shapes = spark.createDataFrame([("u", [outer, hole])], "spatial_unit string, rings array<array<struct<lon: double, lat: double>>>")
    assert spatial.cells_in_polygons(grid, shapes).count() == 1
    assert spatial.cells_in_polygons(grid, shapes, outer_ring_only=True).count() == 2


def test_complete_columns_and_uncertainty_filter(spark):
    df = spark.createDataFrame([(1.0, 1.0, 10.0), (2.0, None, 40.0)], "x double, z double, cv_production_pct double")
    assert [r["column"] for r in clean.complete_case_columns(df, ["x", "z"]).collect()] == ["x"]
    assert clean.certain_targets(df).count() == 1
    with pytest.raises(ValueError):
        clean.certain_targets(df.drop("cv_production_pct"))


def test_vegetation_timing(spark):
    df = spark.createDataFrame([("2020-05-01", "2020-07-01", "0.5"), ("2020-08-01", "2020-07-01", "x")], "observation_date string, harvest_date string, ndvi_mean string")
    assert values(clean.vegetation_qualifier(df), "feature_timing", "ndvi_mean")[0] == ("pre_harvest", 0.5)


def test_previous_wave_is_the_latest_earlier_one(spark):
    schema = "spatial_unit string, crop string, season string, year int, yield_tons_ha double"
    train = spark.createDataFrame([("a", "m", "s", 2018, 1.0), ("a", "m", "s", 2020, 2.0), ("a", "m", "s", 2022, 9.0)], schema)
    test = spark.createDataFrame([("a", "m", "s", 2021, None), ("b", "m", "s", 2021, None)], schema)
    got = {r["spatial_unit"]: r["previous_value"] for r in joins.latest_before(test, train, ["spatial_unit", "crop", "season"]).collect()}
    assert got == {"a": 2.0, "b": None}


def test_join_promises_are_checked(spark):
    dim = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(ValueError, match="duplicate keys"):
        joins.validated_join(dim, dim.withColumnRenamed("v", "w"), ["k"])
    with pytest.raises(ValueError, match="missing columns"):
        require_columns(dim, ["k", "z"])


def test_conflicting_duplicates_raise_and_close_ones_average(spark):
    schema = "crop string, year int, v double, sheet string"
    close = spark.createDataFrame([("m", 2016, 1000.0, "a"), ("m", 2016, 1001.0, "b"), ("m", 2016, 1001.0, "c")], schema)
    assert sets.resolve_duplicates(close, ["crop", "year"], "v").first()["v"] == 1000.5
    far = spark.createDataFrame([("maize", 2016, 3_000_000.0, "a"), ("maize", 2016, 9_999_999.0, "b")], schema)
    with pytest.raises(ValueError, match="conflicting values"):
        sets.resolve_duplicates(far, ["crop", "year"], "v")


def test_one_row_per_environment_and_primary_result(spark):
    df = spark.createDataFrame([("a", 2020, "f", "x"), ("a", 2020, "f", "b"), ("b", 2020, "f", "x")], "spatial_unit string, year int, season string, crop string")
    assert values(sets.one_per_key(df, K.ENVIRONMENT_KEY), "spatial_unit", "crop") == [("a", "b"), ("b", "x")]
    res = spark.createDataFrame(
        [("ridge", True, "overall", "raw", 1.0, 1.0), ("ols", True, "per_crop", "raw", 0.1, 0.1), ("rf", False, "overall", "crop_centered", 0.2, 0.2)],
        "model string, registered_primary_metric boolean, result_scope string, target_scale string, rmse double, mae double")
    assert [r["model"] for r in sets.primary_results(res).collect()] == ["ridge"]


def test_labels_numbers_years_and_names(spark):
    df = spark.createDataFrame([("Maize *",), ("Total cereals",), ("Plantain Bananas (All types)",), ("S/Potatoes",), ("beansprouts and many greens",), (None,)], "t string")
    got = [(r["c"]["canonical"], r["c"]["is_group"]) for r in df.select(S.canonical_label("t").alias("c")).collect()]
    assert got == [("maize", False), (None, True), ("banana", False), ("sweet_potatoes", False), (None, False), (None, False)]
    nums = spark.createDataFrame([("1,234",), ("632a",), ("--",), ("N/A",), ("x1",), (" 7 ",), ("5**",)], "t string")
    assert [r[0] for r in nums.select(S.parse_number("t")).collect()] == [1234.0, 632.0, None, None, None, 7.0, 5.0]
    years = spark.createDataFrame([("2015",), ("2015.0",), ("1999",), ("2026",), ("20155",), ("y2015",)], "t string")
    assert [r[0] for r in years.select(S.parse_year("t")).collect()] == [2015, 2015, None, None, None, None]
    names = spark.createDataFrame([(" fort_PORTAL  city ",), ("o'neil-x",)], "t string")
    assert [r[0] for r in names.select(S.district_name("t")).collect()] == ["Fort Portal City", "O'Neil-X"]


def book(spark, sheets: dict[str, list[list]], name="w"):
    rows = [(name, s, i, j, str(v)) for s, grid in sheets.items() for i, row in enumerate(grid) for j, v in enumerate(row) if v is not None]
    return spark.createDataFrame(rows, "workbook string, sheet string, row int, col int, value string")


def test_wide_sheet_drops_totals_and_reads_off_by_one_labels(spark):
    grid = [["Area"], ["Crop", None, 2016, 2017, 2018], ["Maize", None, "1,000", 2000, "2480097"], ["Total cereals", None, 1, 2, 3], [None, "Beans", 5, "-", "7a"]]
    got = values(cells.parse_sheets(book(spark, {"s": grid})), "crop", "year", "value")
    assert got == [("beans", 2016, 5.0), ("beans", 2018, 7.0), ("maize", 2016, 1000.0), ("maize", 2017, 2000.0), ("maize", 2018, 2480097.0)]


def test_transposed_sheet_and_junk(spark):
    grid = [["Year", "Maize", "Beans", "Millet"], [2015, 1, 2, 3], [2016, 4, 5, 6], [2017, 7, 8, 9]]
    assert cells.parse_sheets(book(spark, {"s": grid})).count() == 9
    with pytest.raises(ValueError, match="no crop/year table"):
        cells.parse_sheets(book(spark, {"s": [["junk", "row"]]}))


def test_national_panel_and_anchors(spark):
    area = spark.createDataFrame([("maize", 2018, 2480097.0, "a")], "crop string, year int, area_planted_ha double, sheet string")
    production = spark.createDataFrame([("maize", 2018, 3442430.0, "a"), ("maize", 2018, 3442430.0, "b")], "crop string, year int, production_mt double, sheet string")
    row = quality.national_yield_panel(area, production).first()
    assert row["yield_tons_ha_planted"] == pytest.approx(3442430 / 2480097)
    printed = spark.createDataFrame(K.AREA_ANCHORS, "crop string, year int, expected double")
    report = quality.anchor_report(area, printed, "area_planted_ha")
    summary = quality.anchor_summary(report).first()
    assert (summary["ok"], summary["missing"], summary["mismatch"]) == (1, 7, 0)


def test_grain(spark):
    sub = book(spark, {"s": [["Sub-region", "Maize"], ["Acholi", 1], ["Teso", 2]]}, "sub")
    nat = book(spark, {"s": [["Crop", "2018"], ["Maize", 1]]}, "nat")
    reg = book(spark, {"s": [["x"], ["Central"], ["Eastern"], ["Northern"]]}, "reg")
    got = dict(values(cells.detect_grain(sub.unionByName(nat).unionByName(reg), "x-land"), "workbook", "grain"))
    assert got == {"sub": "subregion", "nat": "national", "reg": "region"}


def test_final_gate_names_every_flaw(spark):
    df = spark.range(120).select(
        F.concat(F.lit("u"), (F.col("id") % 10).cast("string")).alias("spatial_unit"), (2015 + F.col("id") % 6).cast("int").alias("year"),
        F.when(F.col("id") % 2 == 0, "first").otherwise("annual").alias("season"), F.col("id").cast("string").alias("crop"), F.lit(1.0).alias("yield_tons_ha"),
        F.when(F.col("id") % 2 == 0, "seasonal").otherwise("annual").alias("target_temporal_granularity"), F.lit("official_aggregate").alias("target_source_type"),
        F.lit("sub_region").alias("target_geographic_level"), F.lit("sub_region").alias("predictor_geographic_level"),
        (F.col("id") == 3).alias("is_proxy"), F.lit(False).alias("is_synthetic"), (F.col("id") == 4).alias("is_geographically_assigned"))
    with pytest.raises(ValueError) as e:
        quality.validate_final_dataset(df, ["production_mt", "nowhere"])
    for text in ("annual and seasonal", "derived from the target", "absent from the panel", "proxy targets", "carried down"):
        assert text in str(e.value)


def test_order_statistics_with_a_hot_value(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    data = {"a": [5.0] * 400 + rng.normal(size=801).tolist(), "b": [1.0, 2.0], "c": [7.0], None: rng.exponential(size=50).tolist()}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r["g"]: r for r in ranks.group_quantiles(df, "v", {"q1": 0.25, "m": 0.5, "hi": 0.975}, ["g"]).collect()}
    for g, vs in data.items():
        assert [got[g]["q1"], got[g]["m"], got[g]["hi"]] == pytest.approx(np.quantile(vs, [0.25, 0.5, 0.975]).tolist())
    whole = ranks.group_quantiles(df, "v", {"m": 0.5}).first()["m"]
    assert whole == pytest.approx(np.median([v for vs in data.values() for v in vs]))


def test_hash_rank_is_a_permutation_per_group(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") < 4000, "hot").otherwise("cold"))
    out = ranks.hash_rank(df, ["id"], ["g"], 1, "k", total="n").cache()
    for g, n in (("hot", 4000), ("cold", 1000)):
        part = out.filter(F.col("g") == g)
        assert sorted(r["k"] for r in part.collect()) == list(range(1, n + 1))
        assert part.first()["n"] == n
    again = ranks.hash_rank(df.repartition(7), ["id"], ["g"], 1, "k")
    assert out.join(again, ["id", "g", "k"]).count() == 5000


def test_top_k_with_one_hot_group(spark):
    df = spark.range(3000).select(F.lit("g").alias("g"), F.col("id").alias("v"))
    assert [r["v"] for r in ranks.top_k(df, 3, [F.desc("v")], ["g"]).orderBy("rank").collect()] == [2999, 2998, 2997]


def test_one_member_region_has_zero_spread(spark):
    soil = spark.createDataFrame([("d1", 1.0), ("d2", 2.0), ("d3", 4.0)], "district string, clay double")
    m = spark.createDataFrame([("d1", "r"), ("d2", "s"), ("d3", "s")], "district string, sub_region string")
    got = values(agg.region_soil(soil, m, renames={"clay": "clay_pct"}), "spatial_unit", "clay_pct", "clay_pct_sd", "soil_district_count")
    assert got[0] == ("r", 1.0, 0.0, 1) and got[1][2] == pytest.approx(2 ** 0.5)
    assert agg.region_elevation(None, m).count() == 0


def test_total_combine_null_rules(spark):
    schema = "district string, year int, season string, season_total_mm double, longest_dry_spell_days int, season_onset_day int, season_cessation_day int, season_length_days int, rain_days_1mm long, mean_wet_day_rainfall double"
    df = spark.createDataFrame([("a", 1, "first", 10.0, 5, None, 100, None, 2, 5.0), ("a", 1, "second", 20.0, 9, 230, 300, 71, 6, 9.0), ("b", 1, "first", 1.0, 3, 70, 90, 21, 1, 1.0)], schema)
    got = {r["district"]: r for r in agg.first_and_second_total(df).collect()}
    assert got["a"]["season_onset_day"] is None and got["a"]["season_cessation_day"] == 300
    assert got["a"]["mean_wet_day_rainfall"] == pytest.approx(8.0)
    assert (got["b"]["season_total_mm"], got["b"]["longest_dry_spell_days"], got["b"]["season_onset_day"]) == (1.0, 3, 70)


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1.0), ("b", dt.date(2021, 1, 1), float("nan"))], "district string, date date, rain_mm double")
    sinks.write_table(df, str(tmp_path / "csv"), fmt="csv")
    back = tables.read_csv(spark, str(tmp_path / "csv"), tables.DAILY_RAIN, ["district", "rain_mm"])
    assert back.filter("rain_mm is null").count() == 1 and nan_to_null(df).filter("rain_mm is null").count() == 1
    with pytest.raises(ValueError, match="missing columns"):
        tables.read_csv(spark, str(tmp_path / "csv"), tables.DAILY_RAIN, ["nope"])
    tagged = df.withColumn("target_temporal_granularity", F.when(F.col("district") == "a", "annual").otherwise("seasonal"))
    sinks.write_split(tagged, str(tmp_path / "split"))
    assert spark.read.parquet(str(tmp_path / "split")).count() == 2
    assert spark.read.parquet(str(tmp_path / "split/target_temporal_granularity=annual")).count() == 1
    manifest = sinks.fingerprint(df)
    sinks.write_bundle({"t": df}, manifest, str(tmp_path / "run"))
    with pytest.raises(ValueError, match="exists"):
        sinks.write_bundle({"other": df}, manifest, str(tmp_path / "run"))
    assert not (tmp_path / "run" / "other").exists()
    spark.range(2_000).selectExpr("id", "id % 7 as k").repartition(5).transform(lambda t: sinks.write_table(t, str(tmp_path / "sorted"), order_by=[F.desc("k"), "id"]) or t)
    parts = [spark.read.parquet(str(f)).collect() for f in sorted((tmp_path / "sorted").glob("part-*.parquet"))]
    assert [(r["k"], r["id"]) for part in parts for r in part] == sorted(((i % 7, i) for i in range(2_000)), key=lambda t: (-t[0], t[1]))
    assert sinks.fingerprint(df.orderBy(F.desc("district"))).first() == manifest.first()
    assert_unique_key(df, ["district"])
    tables.assert_single_valued(tables.with_source_file(df.limit(1)), "district")


def test_landed_payload_files(spark, tmp_path):
    folder = tmp_path / "soil"
    folder.mkdir()
    layer = '{"type": "Feature", "geometry": {"type": "Point", "coordinates": [33.7, 2.6]}, "properties": {"layers": [{"name": "clay", "unit_measure": {"d_factor": 10, "mapped_units": "g/kg"}, "depths": [{"range": {"top_depth": 0}, "label": "%s", "values": {"mean": %s}}]}]}, "query_time_s": 0.2}'
    (folder / "Abim__clay__0-5cm.json").write_text(layer % ("0-5cm", 250))
    (folder / "Abim__clay__5-15cm.json").write_text(layer % ("5-15cm", 310))
    read = lambda: payloads.soil_points(payloads.read_payloads(spark, str(folder), payloads.SOIL_PAYLOAD, "properties.layers"))
    assert values(read(), "depth", "value") == [("0-5cm", 250.0), ("5-15cm", 310.0)]
    assert agg.depth_weighted_soil(read(), properties=["clay"]).first()["clay"] == pytest.approx((250 * 5 + 310 * 10) / 15 / 10)
    (folder / "Abim__clay__15-30cm.json").write_text('{"layers": []}')
    with pytest.raises(Exception, match="payload without properties.layers"):
        read().collect()


def test_landed_records_and_boundaries(spark):
    record = '[{"date": "1/5/2001", "epochTime": "978652800", "isodate": "2001-01-05", "raw_value": "4.25", "value": {"avg": 4.25}}, {"isodate": "2001-12-31T00:00:00", "raw_value": 0}]'
    files = spark.createDataFrame([("Abim", record)], "district string, value string")
    rows = payloads.daily_from_records(payloads.parsed(files, payloads.RECORD_PAYLOAD, ""))
    assert [(str(r["date"]), r["rain_mm"], r["doy"]) for r in rows.orderBy("date").collect()] == [("2001-01-05", 4.25, 5), ("2001-12-31", 0.0, 365)]
    old = spark.createDataFrame([("Abim", '[{"date": "1/5/2001", "value": 4.25}]')], "district string, value string")
    with pytest.raises(Exception, match="record without isodate"):
        payloads.daily_from_records(payloads.parsed(old, payloads.RECORD_PAYLOAD, "")).collect()
    square, hole, far = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [1, 2]], [[10, 0], [12, 0], [12, 2], [11, 3], [10, 2], [10, 0]]
    feature = lambda name, kind, c: '{"properties": {"shapeName": "%s"}, "geometry": {"type": "%s", "coordinates": %s}}' % (name, kind, c)
    text = '{"type": "FeatureCollection", "features": [%s, %s]}' % (feature("one", "Polygon", [square, hole]), feature("two", "MultiPolygon", [[square, hole], [far]]))
    parts = payloads.boundary_features(payloads.parsed(spark.createDataFrame([(text,)], "value string"), payloads.BOUNDARY_PAYLOAD, "features"))
    got = {r["name"]: r["parts"] for r in parts.collect()}
    assert [len(p) for p in got["one"]] == [2] and [[len(r) for r in p] for p in got["two"]] == [[5, 3], [6]]
    middle = {r["name"]: (r["lon"], r["lat"]) for r in spatial.centroids(payloads.centroid_rings(parts)).collect()}
    assert middle["one"] == pytest.approx((8 / 5, 8 / 5)) and middle["two"] == pytest.approx((65 / 6, 7 / 6))
    line = spark.createDataFrame([('{"features": [%s]}' % feature("x", "LineString", square),)], "value string")
    with pytest.raises(Exception, match="no polygon"):
        payloads.boundary_features(payloads.parsed(line, payloads.BOUNDARY_PAYLOAD, "features")).collect()


def test_reliability_of_a_missing_cv_column(spark):
    df = spark.createDataFrame([(10.0, 5.0, 2.0, None), (10.0, 5.0, 1.0, None)], "production_mt double, area_harvested_ha double, yield_over_harvested double, cv_production_pct double")
    got = values(clean.reliability(df), "high_uncertainty_flag", "yield_consistency_ok")
    assert [g[0] for g in got] == [None, None] and sorted(g[1] for g in got) == [False, True]
