"""Raster sampling, profiles, diffraction, path analysis, envelopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import GRID_COLS, GRID_ROWS, GRID_SOUTH, GRID_STEP, GRID_WEST, frame
from ..functions import geo as G
from ..operators import coverage as C
from ..operators import grids
from ..operators import path as P
from ..operators import raster as RA
from .coverage import LINKS_SQL, _points, _sites
from .registry import PRESET, R, big, fspl, grid_elev, hav, knife, query, r
from .spatial import BOXES_SQL, GRID_DIMS_SQL, dims_sql, site_boxes

_PLACE = dict(
    west=GRID_WEST, origin_lat=GRID_SOUTH, step_x=GRID_STEP, step_y=GRID_STEP, cols=GRID_COLS, rows=GRID_ROWS
)


def elevation(spark, d) -> RA.Raster:
    return RA.Raster.from_pixels(frame(spark, d, "fx_elevation"), "elev_m", **_PLACE)


def land_cover(spark, d) -> RA.Raster:
    return RA.Raster.from_pixels(frame(spark, d, "fx_landcover"), "class", **_PLACE)


def pairs(spark, d):
    """Each demand point with the site of its number: the links of the path tools."""
    sql_sites = frame(spark, d, "fx_sites").select("site_id", F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"))
    n = frame(spark, d, "supplier").count()
    p = frame(spark, d, "fx_points").select(
        F.col("point_id").alias("pair_id"), F.col("lat").alias("b_lat"), F.col("lng").alias("b_lng"),
        (F.col("point_id") % n).alias("site_id"),
    )
    return p.join(sql_sites, "site_id")


PAIRS_SQL = f"""
pairs AS (SELECT p.point_id AS pair_id, s.site_id, s.lat AS a_lat, s.lng AS a_lng, p.lat AS b_lat, p.lng AS b_lng,
   {hav('s.lat', 's.lng', 'p.lat', 'p.lng')} AS dist
  FROM {{fx_points}} p JOIN {{fx_sites}} s ON s.site_id = p.point_id % (SELECT count(*) FROM {{supplier}}))"""


def profile_sql(steps: int) -> str:
    """CTE body: samples of each pair with heights, both ends included."""
    return f"""
{PAIRS_SQL.strip()},
smp AS (SELECT *, i / {steps - 1}e0 AS f, dist * i / {steps - 1}e0 AS d1, a_lat + (b_lat - a_lat) * (i / {steps - 1}e0) AS p_lat,
  a_lng + (b_lng - a_lng) * (i / {steps - 1}e0) AS p_lng FROM pairs CROSS JOIN range({steps}) t(i)),
prof AS (SELECT *, {grid_elev('p_lng', 'p_lat')} AS elev FROM smp),
full_prof AS (SELECT *, first_value(elev) OVER w AS a_g, last_value(elev) OVER w AS b_g FROM prof
  WINDOW w AS (PARTITION BY pair_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query("sample_bilinear_grid", f"""
WITH keep AS (SELECT x, y, CASE WHEN elev_m = 60 OR (x % 11 = 0 AND y % 3 = 0) THEN NULL ELSE elev_m END AS v FROM {{fx_elevation}}),
p AS (SELECT meas_id, lat, lon, (lon - 3.25e0) / 0.01e0 - 0.5e0 AS fx, (lat - 50.75e0) / 0.01e0 - 0.5e0 AS fy FROM {{fx_measurements}}),
q AS (SELECT *, CAST(greatest(0, least(399, floor(fx))) AS INT) AS x0, CAST(greatest(0, least(279, floor(fy))) AS INT) AS y0 FROM p),
s AS (SELECT *, greatest(0e0, least(1e0, fx - x0)) AS dx, greatest(0e0, least(1e0, fy - y0)) AS dy FROM q),
t AS (SELECT s.*, a.v AS va, b.v AS vb, c.v AS vc, e.v AS vd FROM s
  LEFT JOIN keep a ON a.x = x0 AND a.y = y0 LEFT JOIN keep b ON b.x = least(399, x0 + 1) AND b.y = y0
  LEFT JOIN keep c ON c.x = x0 AND c.y = least(279, y0 + 1) LEFT JOIN keep e ON e.x = least(399, x0 + 1) AND e.y = least(279, y0 + 1)),
m AS (SELECT *, (coalesce(va, 0) + coalesce(vb, 0) + coalesce(vc, 0) + coalesce(vd, 0)) /
   nullif(CAST(va IS NOT NULL AS INT) + CAST(vb IS NOT NULL AS INT) + CAST(vc IS NOT NULL AS INT) + CAST(vd IS NOT NULL AS INT), 0) AS mean FROM t)
SELECT meas_id, {R('coalesce(coalesce(va, mean) * (1 - dx) * (1 - dy) + coalesce(vb, mean) * dx * (1 - dy) + coalesce(vc, mean) * (1 - dx) * dy + coalesce(vd, mean) * dx * dy, 0)')} AS elev_m
FROM m""")
def sample_bilinear_grid(spark, d):
    px = frame(spark, d, "fx_elevation").where(~((F.col("x") % 11 == 0) & (F.col("y") % 3 == 0)))
    raster = RA.Raster.from_pixels(px, "elev_m", nodata=60.0, **_PLACE)
    m = frame(spark, d, "fx_measurements").select("meas_id", "lat", "lon")
    return raster.sample(m, "elev_m", lng="lon").select("meas_id", r("elev_m"))


@query("sample_nearest", """
WITH p AS (SELECT meas_id, CAST(greatest(0, least(399, floor((lon - 3.25e0) / 0.01e0 - 0.5e0 + 0.5e0))) AS INT) AS x,
  CAST(greatest(0, least(279, floor((lat - 50.75e0) / 0.01e0 - 0.5e0 + 0.5e0))) AS INT) AS y FROM {fx_measurements})
SELECT meas_id, CAST(l.class AS BIGINT) AS class FROM p JOIN {fx_landcover} l USING (x, y)""")
def sample_nearest(spark, d):
    m = frame(spark, d, "fx_measurements").select("meas_id", "lat", "lon")
    out = land_cover(spark, d).sample(m, "class", lng="lon", method="nearest")
    return out.select("meas_id", big("class"))


def _tile_pixels(spark, d):
    """The terrain as map-tile pixels of zoom 4 (256 per tile), every fifth missing."""
    px = spark.range(300 * 300).select(
        (F.col("id") % 300 + 2030).alias("px"), (F.col("id") / 300).cast("bigint").alias("py0"))
    return px.select(F.lit(4).alias("z"), "px", (F.col("py0") + 1200).alias("py"),
                     ((F.col("px") * 7 + F.col("py0") * 3) % 500).cast("double").alias("value")
                     ).where((F.col("px") + F.col("py")) % 5 != 0)


@query("sample_bilinear_tiles", f"""
WITH px AS (SELECT i % 300 + 2030 AS px, i // 300 + 1200 AS py, CAST(((i % 300 + 2030) * 7 + (i // 300) * 3) % 500 AS DOUBLE) AS v FROM range(90000) t(i)),
pk AS (SELECT * FROM px WHERE (px + py) % 5 <> 0),
box AS (SELECT min(px) AS a, max(px) AS b, min(py) AS c, max(py) AS e FROM pk),
p AS (SELECT meas_id, (lon + 180) / 360 * 16 * 256 AS fx, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16 * 256 AS fy FROM {{fx_measurements}}),
c AS (SELECT meas_id, CAST(floor(fx) AS BIGINT) + i AS x, CAST(floor(fy) AS BIGINT) + j AS y,
   (CASE WHEN i = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) * (CASE WHEN j = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) AS w
  FROM p CROSS JOIN (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) AS k(i, j))
SELECT meas_id, {R('sum(w * coalesce(v, 0))')} AS elev_m
FROM c CROSS JOIN box LEFT JOIN pk ON pk.px = least(greatest(x, a), b) AND pk.py = least(greatest(y, box.c), e) GROUP BY meas_id""")
def sample_bilinear_tiles(spark, d):
    m = frame(spark, d, "fx_measurements").select("meas_id", "lat", F.col("lon").alias("lng"))
    return RA.sample_tiles(m, _tile_pixels(spark, d), 4).select("meas_id", r("elev_m"))


@query("decode_elevation", f"""
SELECT event_id, {R('(128 * 256e0) + (event_id % 256) + (user_id % 256) / 256e0 - 32768')} AS elev_m FROM {{events}}""")
def decode_elevation(spark, d):
    e = frame(spark, d, "events")
    px = e.select("event_id", F.lit(128).alias("r"), (F.col("event_id") % 256).alias("g"), (F.col("user_id") % 256).alias("b"))
    return px.select("event_id", r(RA.decode_elevation(), 4, "elev_m"))


_PALETTE_SQL = ", ".join(
    f"({i}, {cls}, {c[0]}, {c[1]}, {c[2]})" for i, (cls, c, _, _) in enumerate(RA.LAND_COVER)
)


@query("classify_land_cover", f"""
WITH px AS (SELECT event_id, event_id * 37 % 256 AS r, user_id * 91 % 256 AS g, event_id * 53 % 256 AS b, CASE WHEN event_id % 10 = 0 THEN 0 ELSE 255 END AS a FROM {{events}}),
s AS (SELECT event_id, a, cls, (r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb) AS dd, ord FROM px CROSS JOIN (VALUES {_PALETTE_SQL}) AS k(ord, cls, pr, pg, pb)),
w AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dd, ord) AS rn FROM s)
SELECT event_id, CAST(CASE WHEN a = 0 THEN 0 ELSE cls END AS BIGINT) AS class FROM w WHERE rn = 1""")
def classify_land_cover(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    px = frame(spark, d, "events").select(
        "event_id", (e * 37 % 256).alias("r"), (u * 91 % 256).alias("g"), (e * 53 % 256).alias("b"),
        F.when(e % 10 == 0, 0).otherwise(255).alias("a"),
    )
    return px.select("event_id", big(RA.classify_land_cover(), "class"))


@query("sample_elevation", f"""
WITH p AS (SELECT meas_id, lat + CASE WHEN meas_id % 6 = 0 THEN 9 ELSE 0 END AS lat, lon FROM {{fx_measurements}})
SELECT meas_id, {R('CASE WHEN lon < 5.25e0 AND lat < 53.55e0 THEN 7e0 ELSE ' + grid_elev('lon', 'lat') + ' END')} AS elev_m FROM p""")
def sample_elevation(spark, d):
    """A coarse local grid over the west first, then the terrain grid, then 0."""
    local = frame(spark, d, "fx_elevation").select("x", "y", F.lit(7.0).alias("v")).where("x < 200")
    first = RA.Raster.from_pixels(local, "v", **{**_PLACE, "cols": 200})
    m = frame(spark, d, "fx_measurements").select(
        "meas_id", (F.col("lat") + F.when(F.col("meas_id") % 6 == 0, 9.0).otherwise(0.0)).alias("lat"),
        F.col("lon").alias("lng"),
    )
    m = m.withColumn("lng", F.when(F.col("lng") == 5.25, 5.2500001).otherwise(F.col("lng")))
    return RA.sample_elevation(m, [first, elevation(spark, d)]).select("meas_id", r("elev_m"))


_CLUTTER_SQL = " ".join(f"WHEN {c} THEN {h}e0" for c, _, _, h in RA.LAND_COVER)
_CLUTTER_DB_SQL = " ".join(f"WHEN {c} THEN {db}e0" for c, _, db, _ in RA.LAND_COVER)
_NEAR_XY = (
    "CAST(greatest(0, least(399, floor((lng - 3.25e0) / 0.01e0 - 0.5e0 + 0.5e0))) AS INT) AS x, "
    "CAST(greatest(0, least(279, floor((lat - 50.75e0) / 0.01e0 - 0.5e0 + 0.5e0))) AS INT) AS y"
)


@query("sample_clutter", f"""
WITH p AS (SELECT point_id, {_NEAR_XY} FROM {{fx_points}}),
v AS (SELECT point_id, CASE WHEN x < 150 THEN x % 9 - 2e0 END AS h, class FROM p JOIN {{fx_landcover}} USING (x, y))
SELECT point_id, coalesce(greatest(h, 0e0), CASE WHEN h IS NULL THEN CASE class {_CLUTTER_SQL} ELSE 0e0 END END) AS clutter_m,
 {R(f'CASE WHEN h IS NULL THEN CASE class {_CLUTTER_DB_SQL} ELSE 0e0 END WHEN h > 0 THEN least(14e0, 4.3e0 * ln(1 + h)) ELSE 0e0 END')} AS clutter_db
FROM v""".replace("coalesce(greatest(h, 0e0), CASE WHEN h IS NULL", "coalesce(CASE WHEN h IS NOT NULL THEN greatest(h, 0e0) END, CASE WHEN h IS NULL"))
def sample_clutter(spark, d):
    canopy = frame(spark, d, "fx_elevation").where("x < 150").select("x", "y", (F.col("x") % 9 - 2).alias("h"))
    heights = RA.Raster.from_pixels(canopy, "h", **_PLACE)
    out = RA.sample_clutter(frame(spark, d, "fx_points"), heights, land_cover(spark, d))
    return out.select("point_id", "clutter_m", r("clutter_db"))


# ---- links over terrain ------------------------------------------------------------

TERRAIN_LINKS_SQL = f"""
{LINKS_SQL.strip()},
reach AS (SELECT l.cell_id, l.site_id, l.dist, l.dbm, p.lat, p.lng, s.lat AS s_lat, s.lng AS s_lng, s.tx_height_m,
  CAST(greatest(8, least(40, floor(dist / 2000 + 0.5e0))) AS BIGINT) AS n
  FROM leveled l JOIN {{fx_points}} p ON p.point_id = l.cell_id JOIN {{fx_sites}} s ON s.site_id = l.site_id WHERE l.dbm >= -120),
ends AS (SELECT *, {grid_elev('s_lng', 's_lat')} + tx_height_m AS tx, {grid_elev('lng', 'lat')} + 1.5e0 AS rx FROM reach),
smp AS (SELECT *, i / (n * 1e0) AS f, dist * i / n AS d1, s_lat + (lat - s_lat) * (i / (n * 1e0)) AS p_lat, s_lng + (lng - s_lng) * (i / (n * 1e0)) AS p_lng
  FROM ends, unnest(range(1, n)) AS t(i) WHERE dist > 50),
hts AS (SELECT *, {grid_elev('p_lng', 'p_lat')} + d1 * (dist - d1) / (2 * 6371008.8e0 * 4 / 3) - (tx + (rx - tx) * f) AS clr FROM smp),
vs AS (SELECT cell_id, site_id, max(clr * sqrt(2 * dist / (299792458e0 / 3500e6 * d1 * (dist - d1)))) AS v FROM hts GROUP BY ALL),
tlinks AS (SELECT e.cell_id, e.site_id, e.dist, coalesce({knife('v')}, 0e0) AS diff, e.dbm - coalesce({knife('v')}, 0e0) AS dbm
  FROM ends e LEFT JOIN vs USING (cell_id, site_id))"""


@query("diffraction_db", f"""
WITH {TERRAIN_LINKS_SQL}
SELECT cell_id, site_id, {R('diff')} AS diffraction_db, {R('dbm')} AS dbm FROM tlinks""")
def diffraction_db(spark, d):
    links = C.score_links(
        _points(spark, d).select("cell_id", "lat", "lng"),
        _sites(spark, d).select("site_id", "lat", "lng", "tx_height_m"), PRESET, elevation=elevation(spark, d),
    )
    return links.select("cell_id", "site_id", r("diffraction_db"), r("dbm"))


@query("coverage_terrain", f"""
WITH {TERRAIN_LINKS_SQL},
cl AS (SELECT t.cell_id, t.site_id, t.dbm - CASE l.class {_CLUTTER_DB_SQL} ELSE 0e0 END AS dbm FROM tlinks t
 JOIN (SELECT point_id, {_NEAR_XY} FROM {{fx_points}}) q ON q.point_id = t.cell_id JOIN {{fx_landcover}} l USING (x, y)),
rk AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY dbm DESC, site_id) AS rn FROM cl WHERE dbm >= -120)
SELECT p.point_id AS cell_id, max(CASE WHEN rn = 1 THEN site_id END) AS best_site, {R('max(CASE WHEN rn = 1 THEN dbm END)')} AS best_dbm,
 {R('max(CASE WHEN rn = 1 THEN dbm END) - max(CASE WHEN rn = 2 THEN dbm END)')} AS margin_db
FROM {{fx_points}} p LEFT JOIN rk ON rk.cell_id = p.point_id GROUP BY p.point_id""")
def coverage_terrain(spark, d):
    """Best server with terrain diffraction and land-cover loss at the receiver."""
    cells = RA.sample_clutter(_points(spark, d), None, land_cover(spark, d))
    grid = C.coverage_grid(
        cells.select("cell_id", "lat", "lng", "clutter_db"),
        _sites(spark, d).select("site_id", "lat", "lng", "tx_height_m"), PRESET,
        elevation=elevation(spark, d), clutter_db="clutter_db",
    )
    return grid.select("cell_id", "best_site", r("best_dbm"), r("margin_db"))


@query("link_profiles", f"""
WITH {PAIRS_SQL},
n AS (SELECT *, CAST(greatest(10, least(60, floor(dist / 1000 + 0.5e0))) AS BIGINT) AS n FROM pairs),
s AS (SELECT *, a_lat + (b_lat - a_lat) * (i / (n * 1e0)) AS p_lat, a_lng + (b_lng - a_lng) * (i / (n * 1e0)) AS p_lng FROM n, unnest(range(0, n + 1)) AS t(i))
SELECT pair_id, i, {R('dist * i / n', 3)} AS d1, {R(grid_elev('p_lng', 'p_lat'))} AS terrain_m FROM s""")
def link_profiles(spark, d):
    p = pairs(spark, d).withColumn("distance_m", G.haversine_m("a_lat", "a_lng", "b_lat", "b_lng"))
    p = P.link_profiles(p, kind="p1812", start=("a_lat", "a_lng"), end=("b_lat", "b_lng"))
    p = elevation(spark, d).sample(p, "terrain_m", lng="p_lng", lat="p_lat")
    return p.select("pair_id", big("i"), r("d1", 3), r("terrain_m"))


@query("path_profiles", f"""
WITH {profile_sql(100)}
SELECT pair_id, i, {R('d1', 3)} AS d1, {R('elev')} AS elev_m FROM prof""")
def path_profiles(spark, d):
    p = P.path_profiles(pairs(spark, d), elevation(spark, d))
    return p.select("pair_id", big("i"), r("d1", 3), r("elev_m"))


def _fres(d1: str, mhz: str) -> str:
    return f"sqrt(greatest(0e0, 299792458e0 / ({mhz} * 1e6) * {d1} * (dist - {d1}) / dist))"


@query("fresnel_clearance", f"""
WITH {profile_sql(100)},
c AS (SELECT pair_id, i, a_g + 10 + (b_g + 1.5e0 - a_g - 10) * d1 / dist - 0.6e0 * {_fres('d1', '450e0')} - elev AS gap FROM full_prof WHERE dist > 0)
SELECT pair_id, {R('min(gap)')} AS min_clearance_m, CAST(min(gap) < 0 AS BIGINT) AS obstructed FROM c GROUP BY pair_id""")
def fresnel_clearance(spark, d):
    p = P.path_profiles(pairs(spark, d), elevation(spark, d)).where("distance_m > 0")
    out = P.fresnel_clearance(p, 450.0, 10.0, 1.5)
    return out.select("pair_id", r("min_clearance_m"), big("obstructed"))


@query("link_budget", f"""
WITH {profile_sql(100)},
v AS (SELECT pair_id, max(dist) AS dist, max(CASE WHEN d1 > 0 AND dist - d1 > 0 THEN (elev - (a_g + 10 + (b_g + 1.5e0 - a_g - 10) * f)) * sqrt(2 * dist / (299792458e0 / 450e6 * d1 * (dist - d1))) END) AS v
 FROM full_prof GROUP BY pair_id)
SELECT pair_id, {R(fspl('dist', '450e0'))} AS fspl_db, {R(knife('v'))} AS diffraction_db, {R('39e0 - ' + fspl('dist', '450e0') + ' - ' + knife('v'))} AS rx_dbm,
 {R('39e0 - ' + fspl('dist', '450e0') + ' - ' + knife('v') + ' + 116')} AS margin_db,
 CAST(39e0 - {fspl('dist', '450e0')} - {knife('v')} + 116 >= 0 AS BIGINT) AS viable FROM v""")
def link_budget(spark, d):
    p = P.path_profiles(pairs(spark, d), elevation(spark, d))
    out = P.link_budget(P.path_diffraction_db(p, 450.0, 10.0, 1.5), 39.0, 450.0, -116.0)
    return out.select("pair_id", r("fspl_db"), r("diffraction_db"), r("rx_dbm"), r("margin_db"), big("viable"))


MAST_SQL = f"""
{profile_sql(120)},
gr AS (SELECT *, elev + d1 * (dist - d1) / (2 * 6371008.8e0 * 4 / 3) AS g, 0.6e0 * {_fres('d1', '450e0')} AS zone FROM full_prof WHERE dist > 0),
need AS (SELECT pair_id, site_id, max(a_g) AS a_g, greatest(max(CASE WHEN i > 0 AND i < 119 THEN (g + zone - (b_g + 1.5e0) * f) / nullif(1 - f, 0) END), max(a_g) + 2) AS tip FROM gr GROUP BY ALL),
req AS (SELECT *, greatest(2e0, ceil((tip - a_g) * 10) / 10) AS required_m FROM need),
mast AS (SELECT *, required_m > 30 AS limited, CASE WHEN required_m > 30 THEN 30e0 ELSE required_m END AS height_m FROM req)"""


@query("min_mast_height", f"""
WITH {MAST_SQL},
gap AS (SELECT pair_id, min(gr.a_g + height_m + (b_g + 1.5e0 - gr.a_g - height_m) * f - zone - g) AS gap FROM gr JOIN mast USING (pair_id) GROUP BY pair_id)
SELECT pair_id, {R('required_m')} AS required_m, CAST(limited AS BIGINT) AS limited, {R('height_m')} AS height_m, {R('gap', 3)} AS min_clearance_m
FROM mast JOIN gap USING (pair_id)""")
def min_mast_height(spark, d):
    p = pairs(spark, d).where((F.col("a_lat") != F.col("b_lat")) | (F.col("a_lng") != F.col("b_lng")))
    out = P.min_mast_height(p, elevation(spark, d), 450.0)
    return out.select("pair_id", r("required_m"), big("limited"), r("height_m"), r("min_clearance_m", 3))


@query("binding_link", f"""
WITH {MAST_SQL}
SELECT site_id, {R('max(required_m)')} AS required_m, {R('arg_max(height_m, required_m)')} AS height_m, CAST(bool_or(limited) AS BIGINT) AS limited,
 min(CASE WHEN required_m = top THEN pair_id END) AS binding_link FROM (SELECT *, max(required_m) OVER (PARTITION BY site_id) AS top FROM mast) GROUP BY site_id""")
def binding_link(spark, d):
    p = pairs(spark, d).where((F.col("a_lat") != F.col("b_lat")) | (F.col("a_lng") != F.col("b_lng")))
    out = P.min_mast_height(p, elevation(spark, d), 450.0, by=("pair_id", "site_id"))
    out = P.binding_link(out)
    return out.select("site_id", r("required_m"), r("height_m"), big("limited"), "binding_link")


def _envelope_cells(spark, d):
    b = site_boxes(spark, d).withColumn("n", G.grid_dims(F.col("box"), 24, 8))
    b = b.withColumn("cols", F.col("n.cols")).withColumn("rows", F.col("n.rows"))
    cells = grids.grid_cells(b)
    return cells.select(
        F.col("box_id").alias("station_id"), (F.col("row") * 1000 + F.col("col")).cast("bigint").alias("cell_id"), "lat", "lng"
    )


@query("flight_envelope", f"""
WITH {BOXES_SQL}, {GRID_DIMS_SQL}, n AS (SELECT *, {dims_sql(24, 8)} FROM dims),
cells AS (SELECT box_id AS station_id, r * 1000 + c AS cell_id, center_lat, center_lng, north - (r + 0.5e0) / rows * (north - south) AS lat, west + (c + 0.5e0) / cols * (east - west) AS lng
 FROM n, unnest(range(0, CAST(rows AS BIGINT))) AS a(r), unnest(range(0, CAST(cols AS BIGINT))) AS b(c)),
lk AS (SELECT *, {hav('center_lat', 'center_lng', 'lat', 'lng')} AS dist FROM cells),
inr AS (SELECT *, CAST(greatest(8, least(40, floor(dist / 1500 + 0.5e0))) AS BIGINT) AS n, {grid_elev('center_lng', 'center_lat')} + 10 AS tip, {grid_elev('lng', 'lat')} AS g
 FROM lk WHERE dist >= 1 AND 27e0 - {fspl('dist', '2400e0')} >= -95),
sm AS (SELECT *, i / (n * 1e0) AS f, {grid_elev('center_lng + (lng - center_lng) * (i / (n * 1e0))', 'center_lat + (lat - center_lat) * (i / (n * 1e0))')} + (dist * i / n) * (dist - dist * i / n) / (2 * 6371008.8e0 * 4 / 3) AS h FROM inr, unnest(range(1, n)) AS t(i)),
ok AS (SELECT station_id, cell_id, bool_and(h <= tip + (g + 50 - tip) * f) AS b0, bool_and(h <= tip + (g + 100 - tip) * f) AS b1, bool_and(h <= tip + (g + 120 - tip) * f) AS b2 FROM sm GROUP BY ALL)
SELECT c.station_id, c.cell_id, CAST(CASE WHEN b0 THEN 0 WHEN b1 THEN 1 WHEN b2 THEN 2 WHEN b0 IS NOT NULL THEN 3 END AS BIGINT) AS band FROM cells c LEFT JOIN ok USING (station_id, cell_id)""")
def flight_envelope(spark, d):
    st = frame(spark, d, "fx_areas").select(
        F.col("aoi_id").alias("station_id"), F.col("center_lat").alias("lat"), F.col("center_lng").alias("lng")
    )
    out = P.flight_envelope(
        _envelope_cells(spark, d), st, elevation(spark, d), eirp_dbm=27.0, freq_mhz=2400.0, rx_sens_dbm=-95.0
    )
    return out.select("station_id", "cell_id", big("band"))
