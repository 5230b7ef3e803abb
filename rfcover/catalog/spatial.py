"""Spatial column functions and grid generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import frame
from ..functions import coords as X
from ..functions import geo as G
from ..functions import link as L
from ..operators import grids
from .registry import R, big, hav, query, r


def areas(spark, d):
    return grids.areas_from_tables(frame(spark, d, "fx_areas"), frame(spark, d, "fx_area_vertices"))


def site_boxes(spark, d):
    """One box per site, its half sizes from the area table."""
    a = frame(spark, d, "fx_areas")
    h = F.col("half")
    return a.select(
        F.col("aoi_id").alias("box_id"), "center_lat", "center_lng", "half", "radius_m",
        G.bbox(F.col("center_lng") - h, F.col("center_lat") - h, F.col("center_lng") + h, F.col("center_lat") + h).alias("box"),
    )


BOXES_SQL = """
boxes AS (SELECT aoi_id AS box_id, center_lat, center_lng, half, radius_m,
  center_lng - half AS west, center_lat - half AS south,
  center_lng + half AS east, center_lat + half AS north FROM {fx_areas})"""

# Edges of every ring, closed.
EDGES_SQL = """
edges AS (SELECT v.aoi_id, v.i, v.lng AS x1, v.lat AS y1, w.lng AS x2, w.lat AS y2
  FROM {fx_area_vertices} v JOIN {fx_area_vertices} w ON w.aoi_id = v.aoi_id AND w.i = (v.i + 1) % 5)"""

INSIDE_SQL = f"""
{EDGES_SQL.strip()},
ring_hits AS (
  SELECT p.point_id, e.aoi_id, count(*) AS hits
  FROM {{fx_points}} p JOIN edges e ON (e.y1 > p.lat) <> (e.y2 > p.lat)
   AND p.lng < e.x1 + (e.x2 - e.x1) * (p.lat - e.y1) / (e.y2 - e.y1)
  GROUP BY p.point_id, e.aoi_id),
inside AS (
  SELECT point_id, aoi_id FROM ring_hits WHERE hits % 2 = 1
  UNION ALL
  SELECT p.point_id, a.aoi_id FROM {{fx_points}} p JOIN {{fx_areas}} a ON a.type = 'radius'
   AND {hav('a.center_lat', 'a.center_lng', 'p.lat', 'p.lng')} <= a.radius_m)"""


@query("haversine_m", f"""
SELECT meas_id, {R(hav('lat', 'lon', '52.3676e0', '4.9041e0'), 3)} AS dist_m FROM {{fx_measurements}}""")
def haversine(spark, d):
    m = frame(spark, d, "fx_measurements")
    return m.select("meas_id", r(G.haversine_m("lat", "lon", 52.3676, 4.9041), 3, "dist_m"))


@query("in_aoi", f"WITH {INSIDE_SQL} SELECT point_id, aoi_id FROM inside")
def in_aoi(spark, d):
    return grids.points_in_areas(frame(spark, d, "fx_points"), areas(spark, d)).select(
        "point_id", "aoi_id"
    )


@query("point_in_ring", f"""
WITH {INSIDE_SQL}
SELECT aoi_id, count(*) AS points FROM inside
WHERE aoi_id IN (SELECT aoi_id FROM {{fx_areas}} WHERE type = 'polygon') GROUP BY aoi_id""")
def point_in_ring(spark, d):
    rings = areas(spark, d).where(F.col("aoi.type") == "polygon")
    return grids.points_in_areas(frame(spark, d, "fx_points"), rings, count_by="aoi_id")


@query("bbox_functions", f"""
WITH {BOXES_SQL}
SELECT b.box_id, {R('west - (east - west) * 0.1e0', 6)} AS pad_west, {R('north + (north - south) * 0.1e0', 6)} AS pad_north,
  {R(hav('south', 'west', 'north', 'east'), 3)} AS diagonal_m,
  {R('center_lng - radius_m / 1000 / (111 * cos(radians(center_lat)))', 6)} AS around_west,
  {R('center_lat + radius_m / 1000 / 111', 6)} AS around_north,
  CAST(52e0 BETWEEN south AND north AND 5e0 BETWEEN west AND east AS BIGINT) AS holds_point,
  CAST(west <= center_lng - radius_m / 1000 / (111 * cos(radians(center_lat))) AND east >= center_lng + radius_m / 1000 / (111 * cos(radians(center_lat)))
   AND south <= center_lat - radius_m / 1000 / 111 AND north >= center_lat + radius_m / 1000 / 111 AS BIGINT) AS holds_circle
FROM boxes b""")
def bbox_functions(spark, d):
    b = site_boxes(spark, d)
    pad = G.pad_bbox(F.col("box"), 0.1)
    around = G.bbox_around("center_lng", "center_lat", F.col("radius_m") / 1000)
    return b.select(
        "box_id", r(pad["west"], 6, "pad_west"), r(pad["north"], 6, "pad_north"),
        r(G.bbox_diagonal_m(F.col("box")), 3, "diagonal_m"),
        r(around["west"], 6, "around_west"), r(around["north"], 6, "around_north"),
        big(G.in_bbox(F.col("box"), F.lit(5.0), F.lit(52.0)), "holds_point"),
        big(G.bbox_contains(F.col("box"), around), "holds_circle"),
    )


@query("bbox_of", """
SELECT route_id, min(lng) AS west, min(lat) AS south, max(lng) AS east, max(lat) AS north
FROM {fx_routes} GROUP BY route_id""")
def bbox_of(spark, d):
    df = frame(spark, d, "fx_routes").groupBy("route_id").agg(G.bbox_of().alias("b"))
    return df.select("route_id", "b.*")


@query("circle_ring", f"""
WITH c AS (SELECT aoi_id, i, radians(center_lat) AS phi, radians(center_lng) AS lam,
   radians(i * 5e0) AS br, radius_m / 6378137e0 AS dl
  FROM {{fx_areas}} CROSS JOIN range(73) t(i)),
q AS (SELECT *, asin(sin(phi) * cos(dl) + cos(phi) * sin(dl) * cos(br)) AS phi2 FROM c)
SELECT aoi_id, CAST(i AS BIGINT) AS i, {R('degrees(phi2)', 7)} AS lat,
  {R('degrees(lam + atan2(sin(br) * sin(dl) * cos(phi), cos(dl) - sin(phi) * sin(phi2)))', 7)} AS lng
FROM q""")
def circle_ring(spark, d):
    ring = G.circle_ring("center_lng", "center_lat", "radius_m")
    df = frame(spark, d, "fx_areas").select("aoi_id", F.posexplode(ring).alias("i", "p"))
    return df.select("aoi_id", big("i"), r("p.lat", 7, "lat"), r("p.lng", 7, "lng"))


@query("ring_area_m2", f"""
WITH {EDGES_SQL}
SELECT aoi_id, {R("abs(sum(radians(x2 - x1) * (2 + sin(radians(y1)) + sin(radians(y2))))) * 6378137e0 * 6378137e0 / 2", 0)} AS area_m2,
 {R('sum(' + hav('y1', 'x1', 'y2', 'x2', '6378137e0') + ')', 2)} AS perimeter_m
FROM edges GROUP BY aoi_id""")
def ring_area(spark, d):
    a = areas(spark, d).where(F.col("aoi.type") == "polygon")
    return a.select(
        "aoi_id", r(G.ring_area_m2("aoi.ring"), 0, "area_m2"),
        r(G.ring_perimeter_m("aoi.ring"), 2, "perimeter_m"),
    )


_E2 = "0.0066943799901413165e0"
_EP2 = "0.006739496742276434e0"
_A = "6378137e0"


def utm_sql(lat: str, lng: str) -> str:
    """CTE body: zone, easting, northing of a table ``src`` with id, lat, lng."""
    return f"""
u1 AS (SELECT *, floor(({lng} + 180) / 6) + 1 AS zone, radians({lat}) AS phi FROM src),
u2 AS (SELECT *, {_A} / sqrt(1 - {_E2} * power(sin(phi), 2)) AS n, power(tan(phi), 2) AS t,
  {_EP2} * power(cos(phi), 2) AS c, cos(phi) * radians({lng} - (zone * 6 - 183)) AS aa,
  {_A} * ((1 - {_E2} / 4 - 3 * power({_E2}, 2) / 64 - 5 * power({_E2}, 3) / 256) * phi
   - (3 * {_E2} / 8 + 3 * power({_E2}, 2) / 32 + 45 * power({_E2}, 3) / 1024) * sin(2 * phi)
   + (15 * power({_E2}, 2) / 256 + 45 * power({_E2}, 3) / 1024) * sin(4 * phi)
   - 35 * power({_E2}, 3) / 3072 * sin(6 * phi)) AS m FROM u1),
utm AS (SELECT *, 0.9996e0 * n * (aa + (1 - t + c) * power(aa, 3) / 6
   + (5 - 18 * t + t * t + 72 * c - 58 * {_EP2}) * power(aa, 5) / 120) + 500000 AS easting,
  0.9996e0 * (m + n * tan(phi) * (aa * aa / 2 + (5 - t + 9 * c + 4 * c * c) * power(aa, 4) / 24
   + (61 - 58 * t + t * t + 600 * c - 330 * {_EP2}) * power(aa, 6) / 720)) + CASE WHEN {lat} < 0 THEN 1e7 ELSE 0 END AS northing FROM u2)"""


@query("to_utm", f"""
WITH src AS (SELECT meas_id, CASE WHEN meas_id % 2 = 0 THEN -lat ELSE lat END AS la, lon * 20 - 60 AS lo FROM {{fx_measurements}}),
{utm_sql('la', 'lo')}
SELECT meas_id, CAST(zone AS BIGINT) AS zone, substr('CDEFGHJKLMNPQRSTUVWXX', CAST(floor((la + 80) / 8) AS INT) + 1, 1) AS band,
 CASE WHEN la < 0 THEN 'S' ELSE 'N' END AS hemisphere, {R('easting', 3)} AS easting, {R('northing', 3)} AS northing FROM utm""")
def to_utm(spark, d):
    m = frame(spark, d, "fx_measurements")
    la = F.when(F.col("meas_id") % 2 == 0, -F.col("lat")).otherwise(F.col("lat"))
    m = m.select("meas_id", X.to_utm(la, F.col("lon") * 20 - 60).alias("u"))
    return m.select(
        "meas_id", big("u.zone", "zone"), "u.band", "u.hemisphere",
        r("u.easting", 3, "easting"), r("u.northing", 3, "northing"),
    )


# CTE bodies: latitude and longitude of a table ``p`` with zone, e, nn, north.
UTM_INVERSE_SQL = f"""q AS (SELECT *, (e - 500000) AS x, CASE WHEN north THEN nn ELSE nn - 1e7 END AS y,
  (1 - sqrt(1 - {_E2})) / (1 + sqrt(1 - {_E2})) AS e1 FROM p),
s AS (SELECT *, y / 0.9996e0 / ({_A} * (1 - {_E2} / 4 - 3 * power({_E2}, 2) / 64 - 5 * power({_E2}, 3) / 256)) AS mu FROM q),
f AS (SELECT *, mu + (3 * e1 / 2 - 27 * power(e1, 3) / 32) * sin(2 * mu) + (21 * e1 * e1 / 16 - 55 * power(e1, 4) / 32) * sin(4 * mu)
  + 151 * power(e1, 3) / 96 * sin(6 * mu) + 1097 * power(e1, 4) / 512 * sin(8 * mu) AS p1 FROM s),
g AS (SELECT *, {_EP2} * power(cos(p1), 2) AS c, power(tan(p1), 2) AS t, {_A} / sqrt(1 - {_E2} * power(sin(p1), 2)) AS n,
  {_A} * (1 - {_E2}) / power(1 - {_E2} * power(sin(p1), 2), 1.5) AS rr FROM f),
h AS (SELECT *, x / (n * 0.9996e0) AS dd FROM g),
latlng AS (SELECT *, degrees(p1 - n * tan(p1) / rr * (dd * dd / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * {_EP2}) * power(dd, 4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * {_EP2} - 3 * c * c) * power(dd, 6) / 720)) AS lat,
 zone * 6 - 183 + degrees((dd - (1 + 2 * t + c) * power(dd, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * {_EP2} + 24 * t * t) * power(dd, 5) / 120) / cos(p1)) AS lng FROM h)"""


@query("from_utm", f"""
WITH p AS (SELECT meas_id, 31 + meas_id % 3 AS zone, 300000e0 + meas_id * 37 % 400000 AS e, 5000000e0 + meas_id * 101 % 900000 AS nn,
  meas_id % 2 = 0 AS north FROM {{fx_measurements}}),
{UTM_INVERSE_SQL}
SELECT meas_id, {R('lat', 7)} AS lat, {R('lng', 7)} AS lng FROM latlng""")
def from_utm(spark, d):
    k = F.col("meas_id")
    p = X.from_utm(31 + k % 3, F.lit(300000.0) + k * 37 % 400000, F.lit(5000000.0) + k * 101 % 900000, k % 2 == 0)
    df = frame(spark, d, "fx_measurements").select("meas_id", p.alias("p"))
    return df.select("meas_id", r("p.lat", 7, "lat"), r("p.lng", 7, "lng"))


def _dms(v: str, pos: str, neg: str) -> str:
    """Whole seconds carried into minutes and degrees."""
    a = f"abs({v})"
    dd, mm = f"floor({a})", f"floor(({a} - floor({a})) * 60)"
    total = f"CAST({dd} * 3600 + {mm} * 60 + floor(({a} - {dd} - {mm} / 60) * 3600 + 0.5e0) AS BIGINT)"
    return (
        f"printf('%d°%02d''%02d\"', {total} // 3600, ({total} // 60) % 60, {total} % 60)"
        f" || CASE WHEN {v} >= 0 THEN '{pos}' ELSE '{neg}' END"
    )


@query("format_coordinate", f"""
WITH src AS (SELECT meas_id, lat * CASE WHEN meas_id % 2 = 0 THEN -1 ELSE 1 END AS la, lon * CASE WHEN meas_id % 3 = 0 THEN -1 ELSE 1 END AS lo FROM {{fx_measurements}}),
{utm_sql('la', 'lo')}
SELECT meas_id, printf('%.5f', abs(la)) || '°' || CASE WHEN la >= 0 THEN 'N' ELSE 'S' END || ' ' || printf('%.5f', abs(lo)) || '°' || CASE WHEN lo >= 0 THEN 'E' ELSE 'W' END AS decimal_text,
 {_dms('la', 'N', 'S')} || ' ' || {_dms('lo', 'E', 'W')} AS dms_text,
 CAST(zone AS BIGINT) || substr('CDEFGHJKLMNPQRSTUVWXX', CAST(floor((la + 80) / 8) AS INT) + 1, 1) || ' ' || CAST(floor(easting + 0.5e0) AS BIGINT) || ' ' || CAST(floor(northing + 0.5e0) AS BIGINT) AS utm_text
FROM utm""")
def format_coordinate(spark, d):
    m = frame(spark, d, "fx_measurements").select(
        "meas_id",
        (F.col("lat") * F.when(F.col("meas_id") % 2 == 0, -1).otherwise(1)).alias("la"),
        (F.col("lon") * F.when(F.col("meas_id") % 3 == 0, -1).otherwise(1)).alias("lo"),
    )
    return m.select(
        "meas_id",
        X.format_coordinate("la", "lo", "latlng").alias("decimal_text"),
        X.format_coordinate("la", "lo", "dms").alias("dms_text"),
        X.format_coordinate("la", "lo", "utm").alias("utm_text"),
    )


@query("format_mgrs")
def format_mgrs(spark, d):
    """Grid references, read back: the distance to the start is under a metre."""
    m = frame(spark, d, "fx_measurements").select("meas_id", "lat", "lon")
    m = m.withColumn("mgrs", X.format_coordinate("lat", "lon", "mgrs"))
    m = m.withColumn("p", X.parse_mgrs("mgrs"))
    return m.select("meas_id", "mgrs", r(G.haversine_m("lat", "lon", "p.lat", "p.lng"), 2, "error_m"))


def _ty(lat: str, z: str) -> str:
    return f"((1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * power(2e0, {z}))"


def _tx(lng: str, z: str) -> str:
    return f"((({lng}) + 180) / 360 * power(2e0, {z}))"


@query("tile_xy", f"""
SELECT meas_id, CAST(5 + meas_id % 10 AS BIGINT) AS z, {R(_tx('lon', '(5 + meas_id % 10)'), 5)} AS x, {R(_ty('lat', '(5 + meas_id % 10)'), 5)} AS y
FROM {{fx_measurements}}""")
def tile_xy(spark, d):
    z = 5 + F.col("meas_id") % 10
    df = frame(spark, d, "fx_measurements").select("meas_id", big(z, "z"), G.tile_xy("lon", "lat", z).alias("t"))
    return df.select("meas_id", "z", r("t.x", 5, "x"), r("t.y", 5, "y"))


@query("tile_cover", f"""
WITH {BOXES_SQL},
lv AS (SELECT box_id, z, CAST(floor({_tx('west', 'z')}) AS BIGINT) AS x0, CAST(floor({_tx('east', 'z')}) AS BIGINT) AS x1,
  CAST(floor({_ty('north', 'z')}) AS BIGINT) AS y0, CAST(floor({_ty('south', 'z')}) AS BIGINT) AS y1
  FROM boxes CROSS JOIN (VALUES (8), (10), (11), (12), (13)) AS k(z)),
ok AS (SELECT *, sum((x1 - x0 + 1) * (y1 - y0 + 1)) OVER (PARTITION BY box_id ORDER BY z) AS total FROM lv)
SELECT box_id, CAST(z AS BIGINT) AS z, x, y FROM ok, unnest(range(x0, x1 + 1)) AS a(x), unnest(range(y0, y1 + 1)) AS b(y) WHERE total <= 600""")
def tile_cover(spark, d):
    out = grids.tile_cover(site_boxes(spark, d), [12, 8, 10, 13, 11], 600)
    return out.select("box_id", big("z"), "x", "y")


@query("hilbert_tile_id")
def hilbert_tile_id(spark, d):
    t = grids.tile_cover(site_boxes(spark, d), [8, 10, 12], None)
    return t.select("box_id", big("z"), "x", "y", G.hilbert_tile_id("z", "x", "y").alias("tile_id"))


_NEED = " ".join(
    f"WHEN (floor({_tx('east', str(z))}) - floor({_tx('west', str(z))}) + 1) * (floor({_ty('south', str(z))}) - floor({_ty('north', str(z))}) + 1) <= 16 THEN {z}"
    for z in (10, 9, 8, 7, 6)
)


@query("pick_zoom", f"""
WITH {BOXES_SQL}
SELECT box_id, CAST(least(12, greatest(7, floor(log2(720 / greatest(abs(east - west), 1e-4)) + 0.5e0))) AS BIGINT) AS zoom,
 CAST(CASE {_NEED} ELSE 5 END AS BIGINT) AS profile_zoom
FROM boxes""")
def pick_zoom(spark, d):
    b = F.col("box")
    return site_boxes(spark, d).select(
        "box_id", big(G.pick_zoom(b), "zoom"), big(G.pick_profile_zoom(b), "profile_zoom")
    )


@query("pixel_window", f"""
WITH {BOXES_SQL},
w AS (SELECT box_id, least(1e0, (east - west) / 4e0) AS fx, least(1e0, (north - south) / 2.8e0) AS fy, west, east, south, north FROM boxes),
k AS (SELECT *, CASE WHEN greatest(500 * fx, 350 * fy) >= 512 THEN 3 WHEN greatest(1000 * fx, 700 * fy) >= 512 THEN 2 WHEN greatest(2000 * fx, 1400 * fy) >= 512 THEN 1 ELSE 0 END AS level FROM w),
s AS (SELECT *, 4000 / power(2, level) AS w_px, 2800 / power(2, level) AS h_px FROM k),
o AS (SELECT *, greatest(0, least(w_px - 1, floor((west - 3.25e0) * (w_px / (7.25e0 - 3.25e0))))) AS x0, greatest(0, least(h_px - 1, floor((53.55e0 - north) * (h_px / (53.55e0 - 50.75e0))))) AS y0 FROM s)
SELECT box_id, CAST(level AS BIGINT) AS level, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0,
 CAST(greatest(x0 + 1, least(w_px, ceil((east - 3.25e0) * (w_px / (7.25e0 - 3.25e0))))) AS BIGINT) AS x1,
 CAST(greatest(y0 + 1, least(h_px, ceil((53.55e0 - south) * (h_px / (53.55e0 - 50.75e0))))) AS BIGINT) AS y1 FROM o""")
def pixel_window(spark, d):
    data = F.struct(F.lit(3.25).alias("west"), F.lit(50.75).alias("south"), F.lit(7.25).alias("east"), F.lit(53.55).alias("north"))
    levels = F.array(*[F.struct(F.lit(4000 >> k).alias("width"), F.lit(2800 >> k).alias("height")) for k in range(4)])
    b = site_boxes(spark, d).withColumn("level", G.pick_level(levels, F.col("box"), data, 512))
    lv = F.element_at(levels, F.col("level") + 1)
    b = b.select("box_id", big("level"), G.pixel_window(F.col("box"), data, lv["width"], lv["height"]).alias("w"))
    return b.select("box_id", "level", "w.x0", "w.y0", "w.x1", "w.y1")


GRID_DIMS_SQL = """
dims AS (SELECT *, abs(east - west) * cos(radians((north + south) / 2)) AS w, abs(north - south) AS h FROM boxes)"""


def dims_sql(n: int, low: int) -> str:
    return (
        f"CASE WHEN w >= h THEN {n} ELSE greatest({low}, floor({n}e0 * w / h + 0.5e0)) END AS cols, "
        f"CASE WHEN w >= h THEN greatest({low}, floor({n}e0 * h / w + 0.5e0)) ELSE {n} END AS rows"
    )


@query("grid_dims", f"""
WITH {BOXES_SQL}, wide AS (SELECT box_id, west, south, east + (box_id % 4) * half AS east, north, FROM boxes),
{GRID_DIMS_SQL.replace('FROM boxes', 'FROM wide')}, n AS (SELECT box_id, {dims_sql(220, 8)} FROM dims)
SELECT box_id, CAST(cols AS BIGINT) AS cols, CAST(rows AS BIGINT) AS rows FROM n""")
def grid_dims(spark, d):
    b = F.col("box")
    wide = G.bbox(b["west"], b["south"], b["east"] + F.col("box_id") % 4 * F.col("half"), b["north"])
    df = site_boxes(spark, d).select("box_id", G.grid_dims(wide).alias("n"))
    return df.select("box_id", big("n.cols", "cols"), big("n.rows", "rows"))


@query("grid_cells", f"""
WITH {BOXES_SQL}, {GRID_DIMS_SQL}, n AS (SELECT *, {dims_sql(220, 8)} FROM dims)
SELECT box_id, r AS row, c AS col, {R('north - (r + 0.5e0) / rows * (north - south)', 7)} AS lat, {R('west + (c + 0.5e0) / cols * (east - west)', 7)} AS lng
FROM n, unnest(range(0, CAST(rows AS BIGINT))) AS a(r), unnest(range(0, CAST(cols AS BIGINT))) AS b(c)""")
def grid_cells(spark, d):
    b = site_boxes(spark, d).withColumn("n", G.grid_dims(F.col("box"), 220, 8))
    b = b.withColumn("cols", F.col("n.cols")).withColumn("rows", F.col("n.rows"))
    return grids.grid_cells(b).select("box_id", big("row"), big("col"), r("lat", 7), r("lng", 7))


DEMAND_GRID_SQL = f"""
{BOXES_SQL.strip()}, {GRID_DIMS_SQL.strip()}, n AS (SELECT *, {dims_sql(28, 4)} FROM dims),
gridded AS (SELECT box_id AS aoi_id, north - (r + 0.5e0) / rows * (north - south) AS lat, west + (c + 0.5e0) / cols * (east - west) AS lng
 FROM n, unnest(range(0, CAST(rows AS BIGINT))) AS a(r), unnest(range(0, CAST(cols AS BIGINT))) AS b(c)),
{EDGES_SQL.strip()},
hits AS (SELECT g.aoi_id, g.lat, g.lng, count(*) AS n FROM gridded g JOIN edges e ON e.aoi_id = g.aoi_id AND (e.y1 > g.lat) <> (e.y2 > g.lat)
  AND g.lng < e.x1 + (e.x2 - e.x1) * (g.lat - e.y1) / (e.y2 - e.y1) GROUP BY ALL),
demand AS (SELECT aoi_id, lat, lng FROM hits WHERE n % 2 = 1 UNION ALL
 SELECT g.aoi_id, g.lat, g.lng FROM gridded g JOIN {{fx_areas}} a ON a.aoi_id = g.aoi_id AND a.type = 'radius'
  AND {hav('a.center_lat', 'a.center_lng', 'g.lat', 'g.lng')} <= a.radius_m)"""


@query("demand_grid", f"WITH {DEMAND_GRID_SQL} SELECT aoi_id, {R('lat', 6)} AS lat, {R('lng', 6)} AS lng FROM demand")
def demand_grid(spark, d):
    b = site_boxes(spark, d).select(F.col("box_id").alias("aoi_id"), "box")
    a = areas(spark, d).join(b, "aoi_id")
    return grids.demand_grid(a, box="box").select("aoi_id", r("lat", 6), r("lng", 6))


ROUTE_SQL = f"""
seg AS (SELECT *, lag(lat) OVER w AS lat0, lag(lng) OVER w AS lng0 FROM {{fx_routes}} WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
lens AS (SELECT *, coalesce({hav('lat0', 'lng0', 'lat', 'lng')}, 0e0) AS len FROM seg),
cum AS (SELECT *, sum(len) OVER (PARTITION BY route_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS e FROM lens),
inner_s AS (SELECT route_id, k * 250e0 AS pos, lat0 + (lat - lat0) * (k * 250e0 - (e - len)) / len AS lat, lng0 + (lng - lng0) * (k * 250e0 - (e - len)) / len AS lng
 FROM cum, unnest(range(CAST(floor((e - len) / 250) AS BIGINT) + 1, CAST(ceil(e / 250) AS BIGINT))) AS t(k) WHERE len > 0),
smp AS (SELECT route_id, 0e0 AS pos, lat, lng FROM {{fx_routes}} WHERE seq = 1 UNION ALL SELECT * FROM inner_s),
fin AS (SELECT route_id, arg_max(lat, seq) AS lat, arg_max(lng, seq) AS lng, max(seq) AS n FROM {{fx_routes}} GROUP BY route_id),
tl AS (SELECT route_id, max(pos) AS pos, arg_max(lat, pos) AS lat, arg_max(lng, pos) AS lng FROM smp GROUP BY route_id),
route_samples AS (SELECT route_id, lat, lng FROM smp UNION ALL
 SELECT f.route_id, f.lat, f.lng FROM fin f JOIN tl t USING (route_id) WHERE f.n > 1 AND {hav('t.lat', 't.lng', 'f.lat', 'f.lng')} > 62.5)"""


@query("resample_route", f"WITH {ROUTE_SQL} SELECT route_id, {R('lat', 6)} AS lat, {R('lng', 6)} AS lng FROM route_samples")
def resample_route(spark, d):
    return grids.resample_route(frame(spark, d, "fx_routes")).select("route_id", r("lat", 6), r("lng", 6))


@query("coverage_window", f"""
WITH {BOXES_SQL},
w AS (SELECT *, power(10e0, (20 + 120 - 20 * log10(3500e6) - 20 * log10(4 * pi() / 299792458e0)) / 20) / (1 + box_id % 5) AS rng FROM boxes),
q AS (SELECT *, least(rng / 111320, 3 * greatest((north - south) / 2, 0.05e0)) AS dy, least(rng / (111320 * cos(radians(center_lat))), 3 * greatest((east - west) / 2, 0.05e0)) AS dx FROM w)
SELECT box_id, {R('least(center_lng - dx, west)', 6)} AS west, {R('least(center_lat - dy, south)', 6)} AS south,
 {R('greatest(center_lng + dx, east)', 6)} AS east, {R('greatest(center_lat + dy, north)', 6)} AS north FROM q""")
def coverage_window(spark, d):
    rng = L.max_range_m(20.0, 3500.0) / (1 + F.col("box_id") % 5)
    df = site_boxes(spark, d).select("box_id", G.coverage_window(F.col("box"), "center_lng", "center_lat", rng).alias("w"))
    return df.select("box_id", *[r(f"w.{k}", 6, k) for k in ("west", "south", "east", "north")])


@query("raster_georef", f"""
WITH {BOXES_SQL}
SELECT box_id, {R('(east - west) / 220', 8)} AS x_size, {R('-(north - south) / 160', 8)} AS y_size,
 {R('west + (east - west) / 440', 8)} AS x_first, {R('north - (north - south) / 320', 8)} AS y_first FROM boxes""")
def raster_georef(spark, d):
    df = site_boxes(spark, d).select("box_id", G.raster_georef(F.col("box"), F.lit(220), F.lit(160)).alias("g"))
    return df.select("box_id", *[r(f"g.{k}", 8, k) for k in ("x_size", "y_size", "x_first", "y_first")])
