"""Spherical geometry, boxes, rings, tiles and grid arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clamp, col, dbl, round_half_up, square

# Earth radii in metres.
EARTH_RADIUS_M = 6371008.8  # mean radius, used for distances and links
DRAWING_RADIUS_M = 6378137.0  # equatorial radius, used for rings and circles
KM_PER_DEGREE = 111.0  # box around a point
M_PER_DEGREE = 111320.0  # compute window


def haversine_m(lat1, lng1, lat2, lng2, radius_m: float = EARTH_RADIUS_M) -> Column:
    """Great-circle distance in metres; NULL when a coordinate is missing."""
    lat1, lng1, lat2, lng2 = (col(v) for v in (lat1, lng1, lat2, lng2))
    h = square(F.sin(F.radians(lat2 - lat1) / 2)) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * square(F.sin(F.radians(lng2 - lng1) / 2))
    # least() skips NULLs, so missing input is kept out before it.
    known = lat1.isNotNull() & lng1.isNotNull() & lat2.isNotNull() & lng2.isNotNull()
    return F.when(known, F.lit(2 * radius_m) * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


# ---- boxes -----------------------------------------------------------------


def bbox(west, south, east, north) -> Column:
    return F.struct(
        dbl(west).alias("west"),
        dbl(south).alias("south"),
        dbl(east).alias("east"),
        dbl(north).alias("north"),
    )


def in_bbox(box: Column, lng, lat) -> Column:
    lng, lat = col(lng), col(lat)
    return (
        (lat >= box["south"])
        & (lat <= box["north"])
        & (lng >= box["west"])
        & (lng <= box["east"])
    )


def bbox_contains(outer: Column, inner: Column) -> Column:
    """True when ``outer`` fully holds ``inner``; edges count as inside."""
    return (
        (outer["west"] <= inner["west"])
        & (outer["east"] >= inner["east"])
        & (outer["south"] <= inner["south"])
        & (outer["north"] >= inner["north"])
    )


def bbox_area(box: Column) -> Column:
    """Square degrees, never negative."""
    return F.greatest(F.lit(0.0), box["east"] - box["west"]) * F.greatest(
        F.lit(0.0), box["north"] - box["south"]
    )


def pad_bbox(box: Column, frac) -> Column:
    dx = (box["east"] - box["west"]) * col(frac)
    dy = (box["north"] - box["south"]) * col(frac)
    return bbox(box["west"] - dx, box["south"] - dy, box["east"] + dx, box["north"] + dy)


def bbox_diagonal_m(box: Column) -> Column:
    return haversine_m(box["south"], box["west"], box["north"], box["east"])


def bbox_around(lng, lat, radius_km) -> Column:
    lng, lat, radius_km = col(lng), col(lat), col(radius_km)
    dy = radius_km / KM_PER_DEGREE
    dx = radius_km / (F.lit(KM_PER_DEGREE) * F.cos(F.radians(lat)))
    return bbox(lng - dx, lat - dy, lng + dx, lat + dy)


def bbox_of(lng="lng", lat="lat") -> Column:
    """Aggregate expression: the box of a group of points."""
    return bbox(F.min(col(lng)), F.min(col(lat)), F.max(col(lng)), F.max(col(lat)))


# ---- rings and areas of interest ---------------------------------------------


def _edges(ring: Column, make) -> Column:
    """Apply ``make(vertex, next_vertex)`` along the closed ring."""
    rotated = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, rotated, make)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def ring_crossings(ring, lat) -> Column:
    """Where the edges of a ring that span a latitude cross it (half-open in latitude)."""
    ring, lat = col(ring), col(lat)

    def crossing(a, b):
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        rise = F.nullif(b["lat"] - a["lat"], F.lit(0.0))
        return F.when(spans, a["lng"] + (b["lng"] - a["lng"]) * (lat - a["lat"]) / rise)

    return F.filter(_edges(ring, crossing), lambda at: at.isNotNull())


def edge_spans(ring, low, high) -> Column:
    """Where the edges of a ring lie between two latitudes: STRUCT<west,east> of each that does."""
    ring, low, high = col(ring), col(low), col(high)

    def part(a, b):
        meets = (F.greatest(a["lat"], b["lat"]) >= low) & (F.least(a["lat"], b["lat"]) <= high)
        rise = F.nullif(b["lat"] - a["lat"], F.lit(0.0))

        def lng_at(lat, end):
            place = F.greatest(F.lit(0.0), F.least((lat - a["lat"]) / rise, F.lit(1.0)))
            return F.when(rise.isNull(), end["lng"]).otherwise(a["lng"] + (b["lng"] - a["lng"]) * place)

        p, q = lng_at(low, a), lng_at(high, b)
        return F.when(meets, F.struct(F.least(p, q).alias("west"), F.greatest(p, q).alias("east")))

    return F.filter(_edges(ring, part), lambda s: s.isNotNull())


def _odd_crossings(crossings, lng) -> Column:
    """Odd number of crossings met by a ray going east."""
    lng = col(lng)
    return F.size(F.filter(col(crossings), lambda at: lng < at)) % 2 == 1


def point_in_ring(ring, lng, lat) -> Column:
    """Odd number of edges crossed by a ray going east (half-open in latitude)."""
    return _odd_crossings(ring_crossings(ring, lat), lng)


def in_aoi(aoi, lng, lat, crossings=None) -> Column:
    """A missing area holds everything; a radius area is a disc; else a ring test.

    Points of one latitude may share the ring's crossings of it (``ring_crossings``).
    """
    aoi = col(aoi)
    return (
        F.when(aoi.isNull(), F.lit(True))
        .when(
            aoi["type"] == "radius",
            haversine_m(aoi["center_lat"], aoi["center_lng"], lat, lng) <= aoi["radius_m"],
        )
        .otherwise(point_in_ring(aoi["ring"], lng, lat) if crossings is None else _odd_crossings(crossings, lng))
    )


def aoi_bbox(aoi: Column) -> Column:
    """Smallest box of an area; discs use the drawn circle's extent."""
    ring = F.when(
        aoi["type"] == "radius",
        circle_ring(aoi["center_lng"], aoi["center_lat"], aoi["radius_m"]),
    ).otherwise(aoi["ring"])
    lngs = F.transform(ring, lambda p: p["lng"])
    lats = F.transform(ring, lambda p: p["lat"])
    return bbox(F.array_min(lngs), F.array_min(lats), F.array_max(lngs), F.array_max(lats))


def destination(lng, lat, bearing_deg, distance_m) -> Column:
    """Point reached from a start along a bearing, as STRUCT<lng,lat>."""
    phi, lam = F.radians(col(lat)), F.radians(col(lng))
    br, delta = F.radians(col(bearing_deg)), col(distance_m) / F.lit(DRAWING_RADIUS_M)
    phi2 = F.asin(F.sin(phi) * F.cos(delta) + F.cos(phi) * F.sin(delta) * F.cos(br))
    lam2 = lam + F.atan2(
        F.sin(br) * F.sin(delta) * F.cos(phi), F.cos(delta) - F.sin(phi) * F.sin(phi2)
    )
    return F.struct(F.degrees(lam2).alias("lng"), F.degrees(phi2).alias("lat"))


def circle_ring(lng, lat, radius_m, steps: int = 72) -> Column:
    lng, lat, radius_m = col(lng), col(lat), col(radius_m)
    return F.transform(
        F.sequence(F.lit(0), F.lit(steps)),
        lambda i: destination(lng, lat, i * F.lit(360.0) / F.lit(float(steps)), radius_m),
    )


def ring_area_m2(ring) -> Column:
    def strip(a, b):
        return F.radians(b["lng"] - a["lng"]) * (
            F.lit(2.0) + F.sin(F.radians(a["lat"])) + F.sin(F.radians(b["lat"]))
        )

    ring = col(ring)
    area = F.abs(_total(_edges(ring, strip))) * F.lit(DRAWING_RADIUS_M**2 / 2)
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(area)


def ring_perimeter_m(ring) -> Column:
    def length(a, b):
        return haversine_m(a["lat"], a["lng"], b["lat"], b["lng"], DRAWING_RADIUS_M)

    return _total(_edges(col(ring), length))


# ---- map tiles ----------------------------------------------------------------


def tile_xy(lng, lat, z) -> Column:
    """Web Mercator tile coordinates (fractional) as STRUCT<x,y>."""
    n = F.pow(F.lit(2.0), dbl(z))
    phi = F.radians(col(lat))
    x = (col(lng) + 180) / 360 * n
    y = (1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * n
    return F.struct(x.alias("x"), y.alias("y"))


def pick_zoom(box: Column) -> Column:
    """Zoom at which the box is about two tiles wide, within 7..12."""
    width = F.greatest(F.abs(box["east"] - box["west"]), F.lit(1e-4))
    return clamp(round_half_up(F.log2(F.lit(720.0) / width)), F.lit(7.0), F.lit(12.0)).cast("int")


def _tiles_needed(box: Column, z: int) -> Column:
    a = tile_xy(box["west"], box["north"], F.lit(z))
    b = tile_xy(box["east"], box["south"], F.lit(z))
    return (F.floor(b["x"]) - F.floor(a["x"]) + 1) * (F.floor(b["y"]) - F.floor(a["y"]) + 1)


def pick_profile_zoom(box: Column, max_tiles: int = 16) -> Column:
    """Finest zoom of 10..6 whose tile box fits the budget; none fits gives 5."""
    fits = [F.when(_tiles_needed(box, z) <= max_tiles, F.lit(z)) for z in range(10, 5, -1)]
    return F.coalesce(*fits, F.lit(5))


def hilbert_tile_id(z, x, y, max_zoom: int = 26) -> Column:
    """Hilbert-curve position of a tile, after all tiles of the coarser zooms."""
    z, x, y = col(z).cast("int"), col(x).cast("bigint"), col(y).cast("bigint")
    one = F.lit(1).cast("bigint")
    size = F.call_function("shiftleft", one, z)
    offset = F.floor((size * size - 1) / 3).cast("bigint")
    start = F.struct(x.alias("x"), y.alias("y"), F.lit(0).cast("bigint").alias("d"))

    def step(acc, level):
        side = F.call_function("shiftleft", one, (z - level).cast("int"))
        rx = F.when(acc["x"].bitwiseAND(side) > 0, 1).otherwise(0)
        ry = F.when(acc["y"].bitwiseAND(side) > 0, 1).otherwise(0)
        quadrant = F.when(rx == 1, F.lit(3) - ry).otherwise(ry)
        low_x, low_y = acc["x"].bitwiseAND(side - 1), acc["y"].bitwiseAND(side - 1)
        flip = (ry == 0) & (rx == 1)
        nx = F.when(flip, side - 1 - low_y).when(ry == 0, low_y).otherwise(low_x)
        ny = F.when(flip, side - 1 - low_x).when(ry == 0, low_x).otherwise(low_y)
        return F.struct(
            nx.alias("x"), ny.alias("y"), (acc["d"] + quadrant * side * side).alias("d")
        )

    levels = F.when(z > 0, F.sequence(F.lit(1), z)).otherwise(F.array().cast("array<int>"))
    walked = F.aggregate(levels, start, step)
    return F.when(z <= max_zoom, offset + walked["d"])


# ---- raster windows -------------------------------------------------------------


def pick_level(levels: Column, box: Column, data_box: Column, max_dim: int = 512) -> Column:
    """Index of the coarsest overview still at least ``max_dim`` pixels over the box.

    ``levels`` is an array of STRUCT<width,height>, finest first.
    """
    fx = clamp(
        (box["east"] - box["west"])
        / F.greatest(data_box["east"] - data_box["west"], F.lit(1e-12)), F.lit(0.0), F.lit(1.0))
    fy = clamp(
        (box["north"] - box["south"])
        / F.greatest(data_box["north"] - data_box["south"], F.lit(1e-12)), F.lit(0.0), F.lit(1.0))
    good = F.filter(
        F.sequence(F.lit(0), F.size(levels) - 1),
        lambda i: F.greatest(
            F.element_at(levels, i + 1)["width"] * fx, F.element_at(levels, i + 1)["height"] * fy
        ) >= F.lit(max_dim),
    )
    return F.coalesce(F.array_max(good), F.lit(0))


def pixel_window(box: Column, data_box: Column, width, height) -> Column:
    """Pixels covering the box, clamped to the image, at least one each way."""
    width, height = col(width), col(height)
    sx = width / (data_box["east"] - data_box["west"])
    sy = height / (data_box["north"] - data_box["south"])

    def lo(v, n):
        return F.greatest(F.lit(0), F.least(n - 1, F.floor(v)))

    def hi(v, first, n):
        return F.greatest(first + 1, F.least(n, F.ceil(v)))

    x0 = lo((box["west"] - data_box["west"]) * sx, width)
    y0 = lo((data_box["north"] - box["north"]) * sy, height)
    return F.struct(
        x0.cast("bigint").alias("x0"),
        y0.cast("bigint").alias("y0"),
        hi((box["east"] - data_box["west"]) * sx, x0, width).cast("bigint").alias("x1"),
        hi((data_box["north"] - box["south"]) * sy, y0, height).cast("bigint").alias("y1"),
    )


def raster_georef(box: Column, cols, rows) -> Column:
    """Six world-file numbers: pixel size, two rotations, and the first pixel centre."""
    px = (box["east"] - box["west"]) / col(cols)
    py = (box["north"] - box["south"]) / col(rows)
    return F.struct(
        px.alias("x_size"),
        F.lit(0.0).alias("rot_y"),
        F.lit(0.0).alias("rot_x"),
        (-py).alias("y_size"),
        (box["west"] + px / 2).alias("x_first"),
        (box["north"] - py / 2).alias("y_first"),
    )


# ---- grids ------------------------------------------------------------------------


def grid_dims(box: Column, max_dim: int = 220, min_dim: int = 8) -> Column:
    """Columns and rows: the longer side (in ground length) gets ``max_dim``."""
    mid = (box["south"] + box["north"]) / 2
    w = F.abs(box["east"] - box["west"]) * F.cos(F.radians(mid))
    h = F.abs(box["north"] - box["south"])

    def short(a, b):
        return F.greatest(F.lit(float(min_dim)), round_half_up(F.lit(float(max_dim)) * a / b))

    full = F.lit(float(max_dim))
    return F.struct(
        F.when(w >= h, full).otherwise(short(w, h)).cast("int").alias("cols"),
        F.when(w >= h, short(h, w)).otherwise(full).cast("int").alias("rows"),
    )


def coverage_window(box: Column, center_lng, center_lat, range_m) -> Column:
    """Compute window: the free-space range, at most three half boxes, never
    smaller than the box itself."""
    center_lng, center_lat, range_m = col(center_lng), col(center_lat), col(range_m)
    half_y = F.greatest((box["north"] - box["south"]) / 2, F.lit(0.05))
    half_x = F.greatest((box["east"] - box["west"]) / 2, F.lit(0.05))
    dy = F.least(range_m / M_PER_DEGREE, half_y * 3)
    dx = F.least(range_m / (F.lit(M_PER_DEGREE) * F.cos(F.radians(center_lat))), half_x * 3)
    return bbox(
        F.least(center_lng - dx, box["west"]),
        F.least(center_lat - dy, box["south"]),
        F.greatest(center_lng + dx, box["east"]),
        F.greatest(center_lat + dy, box["north"]),
    )
