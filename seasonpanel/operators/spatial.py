"""Grid cells, nearest cells and polygons.

Grids are long tables (time, latitude, longitude, value). Geometry work runs on
distinct cell centres only; values follow by an equi-join on the centre.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checks import assert_empty
from ..functions.scalars import latitude_weight


def clip_grid(cells: DataFrame, lat: tuple[float, float], lon: tuple[float, float], time: tuple[str, str]) -> DataFrame:
    """Cells inside a box and a time range; all three reach the Parquet scan."""
    return cells.filter(
        F.col("latitude").between(min(lat), max(lat))
        & F.col("longitude").between(min(lon), max(lon))
        & F.col("time").between(F.lit(time[0]).cast("date"), F.lit(time[1]).cast("date"))
    )


def nearest_axis_value(points: DataFrame, cells: DataFrame, axis: str, coordinate: str, step: float, key: str = "district") -> DataFrame:
    """Nearest grid coordinate per point on one axis, the smaller on ties.

    Axis values and points meet on a shared band of width ``step``: a point looks
    in its own band and the two beside it; a point outside the grid looks from the
    nearest edge. ``step`` is at least the spacing of the grid lines, so the nearest
    line is always among those.
    """
    band = lambda c: F.floor(c / step).cast("long")
    lines = cells.select(F.col(axis).alias("_axis")).distinct()
    edge = lines.agg(F.min("_axis").alias("_min"), F.max("_axis").alias("_max"))
    values = lines.withColumn("_band", band(F.col("_axis")))
    # the edges are one row
    asked = points.select(key, F.col(coordinate).alias("_at")).join(F.broadcast(edge), F.lit(True), "inner")
    within = F.greatest(F.least(F.col("_at"), F.col("_max")), F.col("_min"))
    asked = asked.withColumn("_band", F.explode(F.array(*[band(within) + d for d in (-1, 0, 1)])))
    near = asked.join(values, "_band", "inner")
    return near.groupBy(key).agg(F.min_by("_axis", F.struct(F.abs(F.col("_axis") - F.col("_at")), F.col("_axis"))).alias(axis))


def nearest_cells(points: DataFrame, cells: DataFrame, step: float, key: str = "district") -> DataFrame:
    """Latitude and longitude of the nearest cell, each axis on its own."""
    lat = nearest_axis_value(points, cells, "latitude", "lat", step, key)
    lon = nearest_axis_value(points, cells, "longitude", "lon", step, key)
    return lat.join(lon, key, "inner")


def nearest_cell_series(points: DataFrame, cells: DataFrame, step: float, key: str = "district") -> DataFrame:
    """Every time step of the nearest cell of each point."""
    return nearest_cells(points, cells, step, key).join(cells, ["latitude", "longitude"], "inner")


def nearest_valid_value(points: DataFrame, cells: DataFrame, step: float, radius: int = 2, key: str = "district", value: str = "value") -> DataFrame:
    """Nearest cell if it has a value, else the closest one with a value within
    ``radius`` cells each way, else NULL. Cells lie on a regular grid of ``step``."""
    index = lambda c: F.round(c / step).cast("long")
    near = nearest_cells(points, cells, step, key).join(points, key, "inner")
    offsets = F.sequence(F.lit(-radius), F.lit(radius))
    asked = (
        near.withColumn("_di", F.explode(offsets))
        .withColumn("_dj", F.explode(offsets))
        .withColumns({"_i": index(F.col("latitude")) + F.col("_di"), "_j": index(F.col("longitude")) + F.col("_dj")})
        .drop("latitude", "longitude")
    )
    grid = cells.filter(F.col(value).isNotNull()).select(
        index(F.col("latitude")).alias("_i"), index(F.col("longitude")).alias("_j"), "latitude", "longitude", F.col(value).alias("_v")
    )
    d2 = F.pow(F.col("latitude") - F.col("lat"), 2) + F.pow(F.col("longitude") - F.col("lon"), 2)
    is_nearest = (F.col("_di") == 0) & (F.col("_dj") == 0)
    found = asked.join(grid, ["_i", "_j"], "inner").groupBy(key).agg(
        F.min_by("_v", F.struct((~is_nearest).alias("a"), d2.alias("b"), F.col("_di"), F.col("_dj"))).alias(value)
    )
    return points.join(found, key, "left")


def ring_edges(ring: Column) -> Column:
    """Consecutive vertex pairs of a ring, closing edge included."""
    n = F.size(ring)
    return F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.struct(
            F.element_at(ring, i).alias("a"), F.element_at(ring, F.when(i == 1, n).otherwise(i - 1)).alias("b")
        ),
    )


def crosses(edge: Column, lon: Column, lat: Column) -> Column:
    """Does the ray to the right of the point cross this edge?"""
    x1, y1, x2, y2 = edge["a"]["lon"], edge["a"]["lat"], edge["b"]["lon"], edge["b"]["lat"]
    dy = F.when(y2 - y1 == 0, F.lit(1e-12)).otherwise(y2 - y1)
    return ((y1 > lat) != (y2 > lat)) & (lon < (x2 - x1) * (lat - y1) / dy + x1)


def inside_rings(rings: Column, lon: Column, lat: Column) -> Column:
    """Even-odd rule over all rings, so holes and parts are honoured."""
    edges = F.flatten(F.transform(rings, ring_edges))
    return F.size(F.filter(edges, lambda e: crosses(e, lon, lat))) % 2 == 1


def cells_in_polygons(
    cells: DataFrame, boundaries: DataFrame, tile: float = 1.0, outer_ring_only: bool = False, unit: str = "spatial_unit"
) -> DataFrame:
    """Cell centres inside each polygon: (unit, latitude, longitude).

    Each polygon lists the tiles of its bounding box, cells know theirs; only
    pairs that share a tile are tested. ``outer_ring_only`` looks at the first
    ring alone, as older results do.
    """
    shapes = boundaries.withColumn("rings", F.slice("rings", 1, 1)) if outer_ring_only else boundaries
    points = F.flatten(F.col("rings"))
    box = shapes.withColumns(
        {
            "_lon0": F.array_min(F.transform(points, lambda p: p["lon"])),
            "_lon1": F.array_max(F.transform(points, lambda p: p["lon"])),
            "_lat0": F.array_min(F.transform(points, lambda p: p["lat"])),
            "_lat1": F.array_max(F.transform(points, lambda p: p["lat"])),
        }
    )
    tiles = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / tile), F.floor(F.col(hi) / tile)))
    tiled = box.withColumn("_tx", tiles("_lon0", "_lon1")).withColumn("_ty", tiles("_lat0", "_lat1"))
    centres = cells.select("latitude", "longitude").distinct().withColumns(
        {"_tx": F.floor(F.col("longitude") / tile), "_ty": F.floor(F.col("latitude") / tile)}
    )
    pairs = centres.join(tiled, ["_tx", "_ty"], "inner").filter(
        F.col("longitude").between(F.col("_lon0"), F.col("_lon1")) & F.col("latitude").between(F.col("_lat0"), F.col("_lat1"))
    )
    return pairs.filter(inside_rings(F.col("rings"), F.col("longitude"), F.col("latitude"))).select(unit, "latitude", "longitude")


def polygons_without_cells(boundaries: DataFrame, membership: DataFrame, unit: str = "spatial_unit") -> DataFrame:
    return boundaries.select(unit).join(membership.select(unit).distinct(), unit, "left_anti")


def polygon_daily_mean(
    cells: DataFrame, boundaries: DataFrame, value: str = "precip", null_policy: str = "zero", unit: str = "spatial_unit",
    tile: float = 1.0, strict: bool = False,
) -> DataFrame:
    """Cosine-weighted mean of a polygon's cells per date. A missing cell counts as
    0 and keeps its weight (``zero``) or is left out (``renormalise``)."""
    members = cells_in_polygons(cells, boundaries, tile, unit=unit)
    if strict:
        assert_empty(polygons_without_cells(boundaries, members, unit), "polygons without grid cells")
    rows = cells.join(members, ["latitude", "longitude"], "inner").withColumn("_w", latitude_weight("latitude"))
    weight = F.col("_w") if null_policy == "zero" else F.when(F.col(value).isNotNull(), F.col("_w"))
    total = F.sum(F.coalesce(F.col(value), F.lit(0.0)) * F.col("_w"))
    return rows.groupBy(unit, F.col("time").alias("date")).agg((total / F.sum(weight)).alias(value))


def point_set_mean(
    points: DataFrame, cells: DataFrame, step: float, key: str = "district", value: str = "precip", name: str | None = None
) -> DataFrame:
    """Mean reading per point name and image date, missing readings dropped. ``key`` tells the
    points apart; points that share ``name`` (by default the key) are one set."""
    series = nearest_cell_series(points, cells, step, key)
    if name is not None and name != key:
        series = series.join(points.select(key, name), key)
    return series.groupBy(name or key, "time").agg(F.avg(value).alias(value)).dropna(subset=[value])


def centroids(features: DataFrame, name: str = "name") -> DataFrame:
    """Plain mean of the vertices of the ring with most points, per feature name.

    ``rings`` holds one outer ring per part. A ring is a single geometry, so the
    mean is taken inside the row.
    """
    sized = F.transform("rings", lambda r, i: F.struct((-F.size(r)).alias("n"), i.alias("i"), r.alias("r")))
    longest = F.element_at(F.array_sort(sized), 1)["r"]
    rows = features.withColumn("_ring", longest)
    mean = lambda field: F.aggregate("_ring", F.lit(0.0), lambda acc, p: acc + p[field]) / F.size("_ring")
    return rows.select(name, mean("lat").alias("lat"), mean("lon").alias("lon"))


