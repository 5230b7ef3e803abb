"""Missions, site recommendation, and coverage jobs over grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import frame
from ..functions import geo as G
from ..operators import coverage as C
from ..operators import grids
from ..operators import mission as M
from ..operators import recommend as RC
from ..operators.grid_runs import grid_runs
from ..plans import coverage as PC
from .coverage import _points, _sites
from .field import FIT_SQL, TOWER_SQL, _samples, towers
from .registry import PRESET, R, big, classes, fspl, grid_elev, hav, knife, query, r
from .spatial import BOXES_SQL, DEMAND_GRID_SQL, EDGES_SQL, GRID_DIMS_SQL, areas, dims_sql, site_boxes
from .terrain import elevation


def missions(spark, d):
    """One plan per country; it has the area of that number where there is one."""
    n = frame(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("mission_id"))
    b = site_boxes(spark, d).select(F.col("box_id").alias("aoi_id"), "box")
    a = areas(spark, d).join(b, "aoi_id")
    return n.join(a, n["mission_id"] == a["aoi_id"], "left").drop("aoi_id").withColumn(
        "coverage_frac", F.lit(0.5)
    )


def _parts(spark, d):
    return [frame(spark, d, f) for f in ("fx_m_sites", "fx_m_routes", "fx_m_points")]


@query("mission_summary", """
WITH s AS (SELECT mission_id, count(*) AS n FROM {fx_m_sites} GROUP BY 1), r AS (SELECT mission_id, count(*) AS n FROM {fx_m_routes} GROUP BY 1),
p AS (SELECT mission_id, count(*) AS n FROM {fx_m_points} GROUP BY 1)
SELECT CAST(n_nationkey AS BIGINT) AS mission_id, a.type AS aoi_type, coalesce(s.n, 0) AS sites, coalesce(r.n, 0) AS route, coalesce(p.n, 0) AS points,
 CAST(a.type IS NULL AND s.n IS NULL AND coalesce(r.n, 0) < 2 AND p.n IS NULL AS BIGINT) AS is_empty
FROM {nation} LEFT JOIN {fx_areas} a ON a.aoi_id = n_nationkey LEFT JOIN s ON s.mission_id = n_nationkey LEFT JOIN r ON r.mission_id = n_nationkey LEFT JOIN p ON p.mission_id = n_nationkey""")
def mission_summary(spark, d):
    out = M.mission_summary(missions(spark, d), *_parts(spark, d))
    return out.withColumn("is_empty", big("is_empty"))


@query("mission_bbox", """
WITH pts AS (SELECT mission_id, lng, lat FROM {fx_m_sites} UNION ALL SELECT mission_id, lng, lat FROM {fx_m_routes} UNION ALL SELECT mission_id, lng, lat FROM {fx_m_points}
 UNION ALL SELECT CAST(n_nationkey AS BIGINT), lng, lat FROM {nation} JOIN {fx_area_vertices} ON aoi_id = n_nationkey)
SELECT mission_id, min(lng) AS west, min(lat) AS south, max(lng) AS east, max(lat) AS north FROM pts GROUP BY mission_id""")
def mission_bbox(spark, d):
    return M.mission_bbox(missions(spark, d), *_parts(spark, d)).select("mission_id", "box.*")


_M_ROUTE = f"""
seg AS (SELECT *, lag(lat) OVER w AS lat0, lag(lng) OVER w AS lng0 FROM {{fx_m_routes}} WINDOW w AS (PARTITION BY mission_id ORDER BY seq)),
lens AS (SELECT *, coalesce({hav('lat0', 'lng0', 'lat', 'lng')}, 0e0) AS len FROM seg)"""


@query("demand_points", f"""
WITH {DEMAND_GRID_SQL}, {_M_ROUTE},
cum AS (SELECT *, sum(len) OVER (PARTITION BY mission_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS e FROM lens),
inner_s AS (SELECT mission_id, k * 250e0 AS pos, lat0 + (lat - lat0) * (k * 250e0 - (e - len)) / len AS lat, lng0 + (lng - lng0) * (k * 250e0 - (e - len)) / len AS lng
 FROM cum, unnest(range(CAST(floor((e - len) / 250) AS BIGINT) + 1, CAST(ceil(e / 250) AS BIGINT))) AS t(k) WHERE len > 0),
smp AS (SELECT mission_id, 0e0 AS pos, lat, lng FROM {{fx_m_routes}} WHERE seq = 1 UNION ALL SELECT * FROM inner_s),
fin AS (SELECT mission_id, arg_max(lat, seq) AS lat, arg_max(lng, seq) AS lng, max(seq) AS n FROM {{fx_m_routes}} GROUP BY mission_id),
tl AS (SELECT mission_id, arg_max(lat, pos) AS lat, arg_max(lng, pos) AS lng FROM smp GROUP BY mission_id),
rs AS (SELECT mission_id, lat, lng FROM smp UNION ALL SELECT f.mission_id, f.lat, f.lng FROM fin f JOIN tl t USING (mission_id) WHERE f.n > 1 AND {hav('t.lat', 't.lng', 'f.lat', 'f.lng')} > 62.5),
al AS (SELECT aoi_id AS mission_id, 'aoi' AS source, lat, lng FROM demand JOIN {{nation}} ON n_nationkey = aoi_id UNION ALL SELECT mission_id, 'route', lat, lng FROM rs
 UNION ALL SELECT mission_id, 'point', lat, lng FROM {{fx_m_points}})
SELECT mission_id, source, {R('lat', 5)} AS lat, {R('lng', 5)} AS lng FROM al""")
def demand_points(spark, d):
    _, routes, points = _parts(spark, d)
    out = M.demand_points(missions(spark, d), routes, points)
    return out.select("mission_id", "source", r("lat", 5), r("lng", 5))


@query("mission_metrics", f"""
WITH {EDGES_SQL}, {_M_ROUTE},
area AS (SELECT aoi_id, abs(sum(radians(x2 - x1) * (2 + sin(radians(y1)) + sin(radians(y2))))) * 6378137e0 * 6378137e0 / 2 / 1e6 AS km2 FROM edges GROUP BY aoi_id),
rl AS (SELECT mission_id, sum(len) / 1000 AS km FROM lens GROUP BY mission_id),
sd AS (SELECT a.mission_id, max({hav('a.lat', 'a.lng', 'b.lat', 'b.lng')}) / 1000 AS km FROM {{fx_m_sites}} a JOIN {{fx_m_sites}} b USING (mission_id) GROUP BY a.mission_id),
pc AS (SELECT mission_id, count(*) AS n FROM (SELECT mission_id FROM {{fx_m_sites}} UNION ALL SELECT mission_id FROM {{fx_m_points}}) GROUP BY mission_id)
SELECT CAST(n_nationkey AS BIGINT) AS mission_id, {R('coalesce(km2, 0e0)')} AS aoi_area_km2, {R('coalesce(rl.km, 0e0)')} AS route_length_km, {R('coalesce(sd.km, 0e0)')} AS max_site_distance_km, coalesce(n, 0) AS point_count
FROM {{nation}} LEFT JOIN area ON aoi_id = n_nationkey LEFT JOIN rl ON rl.mission_id = n_nationkey LEFT JOIN sd ON sd.mission_id = n_nationkey LEFT JOIN pc ON pc.mission_id = n_nationkey""")
def mission_metrics(spark, d):
    sites, routes, points = _parts(spark, d)
    out = M.mission_metrics(missions(spark, d), sites, routes, points)
    return out.select("mission_id", r("aoi_area_km2"), r("route_length_km"), r("max_site_distance_km"), "point_count")


# ---- recommendation --------------------------------------------------------------


def _runs(spark, d):
    return site_boxes(spark, d).withColumnRenamed("box_id", "run_id")


@query("local_maxima", f"""
WITH {BOXES_SQL},
p AS (SELECT box_id, west - (east - west) * 0.1e0 AS w, east + (east - west) * 0.1e0 AS e, south - (north - south) * 0.1e0 AS s, north + (north - south) * 0.1e0 AS n FROM boxes),
g AS (SELECT box_id, r, c, n - (r + 0.5e0) / 64 * (n - s) AS lat, w + (c + 0.5e0) / 64 * (e - w) AS lng FROM p CROSS JOIN range(64) a(r) CROSS JOIN range(64) b(c)),
h AS (SELECT *, {R(grid_elev('lng', 'lat'), 6)} AS z FROM g),
x AS (SELECT *, max(z) OVER (PARTITION BY box_id, r ORDER BY c ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m1 FROM h),
y AS (SELECT *, max(m1) OVER (PARTITION BY box_id, c ORDER BY r ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m2 FROM x)
SELECT box_id AS run_id, r AS row, c AS col, {R('z')} AS elev_m FROM y WHERE z >= m2 AND r BETWEEN 1 AND 62 AND c BETWEEN 1 AND 62""")
def local_maxima(spark, d):
    b = _runs(spark, d).withColumn("box", G.pad_bbox(F.col("box"), 0.1))
    g = grids.grid_cells(b.withColumn("cols", F.lit(64)).withColumn("rows", F.lit(64)))
    g = elevation(spark, d).sample(g.select("run_id", "row", "col", "lat", "lng"), "elev_m")
    out = RC.local_maxima(g.withColumn("elev_m", r("elev_m", 6)), "run_id", 64)
    return out.select("run_id", big("row"), big("col"), r("elev_m"))


@query("candidate_sites")
def candidate_sites(spark, d):
    out = RC.candidate_sites(_runs(spark, d), elevation(spark, d), top=30)
    return out.select("run_id", big("candidate"), r("lat", 6), r("lng", 6), r("elev_m"), "label")


@query("thin_by_distance")
def thin_by_distance(spark, d):
    """Demand points thinned per segment to at least 15 km, the first ones first."""
    p = frame(spark, d, "fx_points").select(
        F.col("kind").alias("run_id"), "lat", "lng", F.lit(0.0).alias("elev_m"), F.lit(15000.0).alias("min_sep_m"),
        F.lit(0).alias("row"), F.col("point_id").alias("col"),
    )
    return RC.thin_by_distance(p).select("run_id", big("col", "point_id"), r("lat"), r("lng"))


MATRIX_SQL = f"""
{DEMAND_GRID_SQL.strip()},
dem AS (SELECT aoi_id AS run_id, row_number() OVER (PARTITION BY aoi_id ORDER BY lat DESC, lng) AS demand_id, lat, lng FROM demand),
pad AS (SELECT box_id, center_lat, center_lng, west - (east - west) * 0.1e0 AS w, east + (east - west) * 0.1e0 AS e, south - (north - south) * 0.1e0 AS s, north + (north - south) * 0.1e0 AS n FROM boxes),
cand AS (SELECT box_id AS run_id, r * 5 + c AS candidate, n - (r + 0.5e0) / 5 * (n - s) AS lat, w + (c + 0.5e0) / 5 * (e - w) AS lng FROM pad CROSS JOIN range(5) a(r) CROSS JOIN range(5) b(c)
 UNION ALL SELECT box_id, 25, center_lat, center_lng FROM pad),
mx AS (SELECT c.run_id, c.candidate, dm.demand_id FROM cand c JOIN dem dm ON dm.run_id = c.run_id
 WHERE 12e0 - {fspl(hav('c.lat', 'c.lng', 'dm.lat', 'dm.lng'), '3500e0')} >= -105)"""
_RECOMMEND_LINK = C.LinkParams(12.0, 3500.0, thresholds=PRESET.thresholds)


def _recommend_inputs(spark, d):
    from pyspark.sql import Window

    b = site_boxes(spark, d).select(F.col("box_id").alias("aoi_id"), "box")
    a = areas(spark, d).join(b.hint("merge"), "aoi_id")
    w = Window.partitionBy("run_id").orderBy(F.desc("lat"), "lng")
    dem = grids.demand_grid(a, box="box").select(F.col("aoi_id").alias("run_id"), "lat", "lng")
    dem = dem.withColumn("demand_id", F.row_number().over(w).cast("bigint"))
    cand = RC.candidate_sites(_runs(spark, d))
    return dem, cand, RC.coverage_matrix(cand, dem, _RECOMMEND_LINK)


@query("coverage_matrix", f"WITH {MATRIX_SQL} SELECT run_id, candidate, count(*) AS covered FROM mx GROUP BY ALL")
def coverage_matrix(spark, d):
    _, _, m = _recommend_inputs(spark, d)
    return m.groupBy("run_id", big("candidate")).agg(F.count(F.lit(1)).alias("covered"))


def _pick_sql(k: int) -> str:
    prev = "mx" if k == 1 else f"m{k - 1}"
    covered = "0" if k == 1 else "p.covered"
    join = "" if k == 1 else f"JOIN b{k - 1} p ON p.run_id = g.run_id"
    return f"""
g{k} AS (SELECT run_id, candidate, count(*) AS gain FROM {prev} GROUP BY ALL),
b{k} AS (SELECT * FROM (SELECT g.run_id, g.candidate, g.gain, t.n, {covered} + g.gain AS covered,
   row_number() OVER (PARTITION BY g.run_id ORDER BY g.gain DESC, g.candidate) AS rn FROM g{k} g JOIN tot t ON t.run_id = g.run_id {join}
   WHERE {covered} < t.n * 0.95e0) WHERE rn = 1 AND gain >= n * 0.02e0),
m{k} AS (SELECT q.* FROM {prev} q JOIN b{k} b ON b.run_id = q.run_id WHERE NOT EXISTS (SELECT 1 FROM mx z WHERE z.run_id = b.run_id AND z.candidate = b.candidate AND z.demand_id = q.demand_id))"""


GREEDY_SQL = f"""
{MATRIX_SQL.strip()}, tot AS (SELECT run_id, count(*) AS n FROM dem GROUP BY run_id), {_pick_sql(1)}, {_pick_sql(2)}, {_pick_sql(3)},
picks AS (SELECT 1 AS pick, * FROM b1 UNION ALL SELECT 2, * FROM b2 UNION ALL SELECT 3, * FROM b3)"""


@query("greedy_max_cover", f"""
WITH {GREEDY_SQL}
SELECT run_id, CAST(pick AS BIGINT) AS pick, candidate, {R('gain / (n * 1e0)', 6)} AS newly_covered, {R('covered / (n * 1e0)', 6)} AS cumulative_frac FROM picks""")
def greedy_max_cover(spark, d):
    dem, _, m = _recommend_inputs(spark, d)
    out = RC.greedy_max_cover(m, dem)
    return out.select("run_id", big("pick"), big("candidate"), r("newly_covered", 6), r("cumulative_frac", 6))


@query("combined_plan", f"""
WITH {GREEDY_SQL},
st AS (SELECT p.run_id, c.lat, c.lng FROM picks p JOIN cand c ON c.run_id = p.run_id AND c.candidate = p.candidate UNION ALL SELECT site_id, lat, lng FROM {{fx_sites}}),
ex AS (SELECT b.box_id, count(*) AS sites, least(any_value(b.west), min(st.lng)) AS w, greatest(any_value(b.east), max(st.lng)) AS e, least(any_value(b.south), min(st.lat)) AS s, greatest(any_value(b.north), max(st.lat)) AS n
  FROM boxes b JOIN st ON st.run_id = b.box_id GROUP BY b.box_id)
SELECT box_id AS run_id, sites, {R('w - (e - w) * 0.12e0', 6)} AS west, {R('s - (n - s) * 0.12e0', 6)} AS south, {R('e + (e - w) * 0.12e0', 6)} AS east, {R('n + (n - s) * 0.12e0', 6)} AS north FROM ex""")
def combined_plan(spark, d):
    dem, cand, m = _recommend_inputs(spark, d)
    picks = RC.greedy_max_cover(m, dem).join(cand.select("run_id", "candidate", "lat", "lng").hint("merge"), ["run_id", "candidate"])
    locked = frame(spark, d, "fx_sites").select(F.col("site_id").alias("run_id"), F.lit(1).alias("ordinal"), "lat", "lng", "name")
    sites, boxes = RC.combined_plan(locked, picks, _runs(spark, d).select("run_id", "box"))
    n = sites.groupBy("run_id").agg(F.count(F.lit(1)).alias("sites"))
    return boxes.join(n.hint("merge"), "run_id").select("run_id", "sites", *[r(f"box.{k}", 6, k) for k in ("west", "south", "east", "north")])


# ---- grid runs ---------------------------------------------------------------------


def run_grid(spark, d):
    """Coverage over each site's box by all sites, clipped to the site's area, on the full grid."""
    a = areas(spark, d).withColumnRenamed("aoi_id", "run_id")
    runs = _runs(spark, d).select("run_id", "box").join(a, "run_id")
    return grid_runs(runs, _sites(spark, d), PRESET, clip_aoi="aoi")


RUN_GRID_SQL = f"""
{BOXES_SQL.strip()}, {GRID_DIMS_SQL.strip()}, n AS (SELECT *, {dims_sql(220, 8)} FROM dims),
cells AS MATERIALIZED (SELECT box_id AS run_id, r * CAST(cols AS BIGINT) + c AS cell_id, r, c, (east - west) / cols AS cell_w, (north - south) / rows AS cell_h,
  north - (r + 0.5e0) / rows * (north - south) AS lat, west + (c + 0.5e0) / cols * (east - west) AS lng
 FROM n, unnest(range(0, CAST(rows AS BIGINT))) AS a(r), unnest(range(0, CAST(cols AS BIGINT))) AS b(c)),
{EDGES_SQL.strip()},
hits AS MATERIALIZED (SELECT g.run_id, g.cell_id, count(*) AS n FROM cells g JOIN edges e ON e.aoi_id = g.run_id AND (e.y1 > g.lat) <> (e.y2 > g.lat)
  AND g.lng < e.x1 + (e.x2 - e.x1) * (g.lat - e.y1) / (e.y2 - e.y1) GROUP BY ALL),
ins AS MATERIALIZED (SELECT run_id, cell_id FROM hits WHERE n % 2 = 1 UNION ALL SELECT g.run_id, g.cell_id FROM cells g JOIN {{fx_areas}} a ON a.aoi_id = g.run_id AND a.type = 'radius'
  AND {hav('a.center_lat', 'a.center_lng', 'g.lat', 'g.lng')} <= a.radius_m),
lk AS MATERIALIZED (SELECT run_id, cell_id, site_id, 20e0 - {fspl(hav('s.lat', 's.lng', 'g.lat', 'g.lng'), '3500e0')} AS dbm FROM cells g JOIN ins USING (run_id, cell_id) JOIN {{fx_sites}} s ON abs(s.lat - g.lat) < 0.7e0),
bst AS MATERIALIZED (SELECT run_id, cell_id, max(dbm) AS dbm, arg_max(site_id, dbm) AS best_site FROM lk WHERE dbm >= -120 GROUP BY ALL),
rgrid AS MATERIALIZED (SELECT c.*, i.cell_id IS NOT NULL AS inside, best_site, dbm, {classes('dbm')} AS cls FROM cells c LEFT JOIN ins i USING (run_id, cell_id) LEFT JOIN bst USING (run_id, cell_id))"""


@query("coverage_grid", f"""
WITH {RUN_GRID_SQL}
SELECT run_id, cell_id, CAST(inside AS BIGINT) AS inside, {R('dbm')} AS best_dbm, CAST(cls AS BIGINT) AS cls FROM rgrid""")
def coverage_grid(spark, d):
    return run_grid(spark, d).select("run_id", "cell_id", big("inside"), r("best_dbm"), big("cls"))


_BRIGHT = "(cls > 1 OR cls IS NULL)"


@query("dead_zones", f"""
WITH {RUN_GRID_SQL},
dead AS (SELECT *, c - row_number() OVER (PARTITION BY run_id, r ORDER BY c) AS isle FROM rgrid WHERE inside AND {_BRIGHT}),
line AS MATERIALIZED (SELECT run_id, r, min(c) AS c0, max(c) AS c1, min(cell_id) AS node, count(*) AS n, sum(lng) AS lng, sum(lat) AS lat, sum(cos(radians(lat))) AS cs,
  any_value(cell_h) * 111.32e0 * any_value(cell_w) * 111.32e0 AS km2 FROM dead GROUP BY run_id, r, isle),
touch AS MATERIALIZED (SELECT p.run_id, p.node, q.node AS other FROM line p JOIN line q ON q.run_id = p.run_id AND (q.r = p.r + 1 OR q.r = p.r - 1) AND q.c0 <= p.c1 + 1 AND q.c1 >= p.c0 - 1),
lab AS (SELECT run_id, node, node AS root FROM line
 UNION SELECT l.run_id, t.other, l.root FROM lab l JOIN touch t ON t.run_id = l.run_id AND t.node = l.node WHERE l.root < t.other),
fin AS (SELECT run_id, node, min(root) AS root FROM lab GROUP BY ALL),
z AS (SELECT run_id, root, sum(n) AS cells, sum(lng) / sum(n) AS lng, sum(lat) / sum(n) AS lat, any_value(km2) * sum(cs) AS km2 FROM fin JOIN line USING (run_id, node) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY km2 DESC, root) AS rank FROM z)
SELECT run_id, rank, CAST(cells AS BIGINT) AS cells, {R('lng', 5)} AS lng, {R('lat', 5)} AS lat, {R('km2', 3)} AS area_km2 FROM k WHERE rank <= 5""", recursive=True)
def dead_zones(spark, d):
    """Zones below class 1, so that every run has some."""
    grid = run_grid(spark, d).where("inside").withColumn("cls", F.when(F.col("cls") > 1, 3).otherwise(F.col("cls")))
    out = C.dead_zones(grid, top=5)
    return out.select("run_id", big("rank"), big("cells"), r("lng", 5), r("lat", 5), r("area_km2", 3))


@query("coverage_by_generation", f"""
WITH {TOWER_SQL},
b AS (SELECT point_id, radio, max(30e0 - {fspl(hav('p.lat', 'p.lng', 't.lat', 't.lon'), "(CASE radio WHEN 'LTE' THEN 800e0 WHEN 'NR' THEN 3500e0 ELSE 900e0 END)")}) AS dbm FROM {{fx_points}} p CROSS JOIN towers t GROUP BY ALL)
SELECT k.radio, p.point_id, {R('dbm')} AS best_dbm, CAST({classes('dbm')} AS BIGINT) AS cls FROM {{fx_points}} p CROSS JOIN (VALUES ('GSM'), ('UMTS'), ('LTE'), ('NR')) AS k(radio)
LEFT JOIN b ON b.point_id = p.point_id AND b.radio = k.radio AND dbm >= -120""")
def coverage_by_generation(spark, d):
    out = PC.coverage_by_generation(frame(spark, d, "fx_points"), towers(spark, d))
    return out.select("radio", F.col("cell_id").alias("point_id"), r("best_dbm"), big("cls"))


@query("team_coverage", f"""
WITH {FIT_SQL},
tm AS (SELECT t.team, 3500e0 + 100 * length(t.team) AS mhz, 10 * log10(0.05e0 * length(t.team) * 1000) + 2.15e0 + coalesce(offset_db, 0e0) AS eirp FROM {{fx_traffic}} t LEFT JOIN fits ON fits.radio_id = t.team),
pnear AS (SELECT point_id, min({hav('p.lat', 'p.lng', 's.lat', 's.lng')}) AS dist FROM {{fx_points}} p CROSS JOIN {{fx_sites}} s GROUP BY point_id),
g AS (SELECT team, {classes('eirp - ' + fspl('dist', 'mhz'))} AS cls FROM tm CROSS JOIN pnear)
SELECT team, count(*) AS total, count(*) FILTER (cls <= 2) AS covered, count(*) FILTER (cls = 3) AS class_3, {R('count(*) FILTER (cls <= 2) / (count(*) * 1e0)', 6)} AS covered_frac FROM g GROUP BY team""")
def team_coverage(spark, d):
    from ..operators.calibration import fit_calibration

    t = frame(spark, d, "fx_traffic").select("team", F.col("team").alias("radio_id"), F.lit(1).alias("mission_id"))
    radios = t.select("radio_id", (3500.0 + 100.0 * F.length("team")).alias("default_freq_mhz"), (0.05 * F.length("team")).alias("power_w"))
    s = PC.team_sites(_sites(spark, d).withColumn("mission_id", F.lit(1)), t, radios, fit_calibration(_samples(spark, d)), PRESET)
    cells = _points(spark, d).withColumn("mission_id", F.lit(1)).join(t, "mission_id").select("team", "cell_id", "lat", "lng")
    out = PC.team_coverage(cells, s, PRESET, reach_m=2_000_000.0)
    return out.select("team", "total", "covered", "class_3", r("covered_frac", 6))


def _relays(spark, d):
    return frame(spark, d, "fx_areas").select(
        F.col("aoi_id").alias("run_id"), F.col("center_lat").alias("lat"), F.col("center_lng").alias("lng"), F.lit(120.0).alias("alt_m")
    )


@query("relay_gain", f"""
WITH {BOXES_SQL}, {GRID_DIMS_SQL}, n AS (SELECT *, {dims_sql(220, 8)} FROM dims),
cells AS (SELECT box_id AS run_id, center_lat AS s_lat, center_lng AS s_lng, north - (r + 0.5e0) / rows * (north - south) AS lat, west + (c + 0.5e0) / cols * (east - west) AS lng
 FROM n, unnest(range(0, CAST(rows AS BIGINT))) AS a(r), unnest(range(0, CAST(cols AS BIGINT))) AS b(c)),
k AS (SELECT row_number() OVER () AS id, *, {hav('s_lat', 's_lng', 'lat', 'lng')} AS dist FROM cells),
e AS (SELECT k.*, h, CAST(greatest(8, least(40, floor(dist / 2000 + 0.5e0))) AS BIGINT) AS n, {grid_elev('s_lng', 's_lat')} + h AS tx, {grid_elev('lng', 'lat')} + 1.5e0 AS rx FROM k CROSS JOIN (VALUES (2e0), (120e0)) AS v(h)),
s AS (SELECT *, i / (n * 1e0) AS f, dist * i / n AS d1, {grid_elev('s_lng + (lng - s_lng) * (i / (n * 1e0))', 's_lat + (lat - s_lat) * (i / (n * 1e0))')} AS z FROM e, unnest(range(1, n)) AS t(i) WHERE dist > 50),
v AS (SELECT id, h, max((z + d1 * (dist - d1) / (2 * 6371008.8e0 * 4 / 3) - (tx + (rx - tx) * f)) * sqrt(2 * dist / (299792458e0 / 3500e6 * d1 * (dist - d1)))) AS v FROM s GROUP BY ALL),
l AS (SELECT e.run_id, e.h, 20e0 - {fspl('e.dist', '3500e0')} - coalesce({knife('v.v')}, 0e0) AS dbm FROM e LEFT JOIN v ON v.id = e.id AND v.h = e.h),
q AS (SELECT run_id, count(*) FILTER (h = 2 AND dbm >= -105) / (count(*) FILTER (h = 2) * 1e0) AS g, count(*) FILTER (h = 120 AND dbm >= -105) / (count(*) FILTER (h = 120) * 1e0) AS a FROM l GROUP BY run_id)
SELECT run_id, {R('g', 6)} AS ground_frac, {R('a', 6)} AS alt_frac, {R('(a - g) * 100')} AS gain_pts FROM q""")
def relay_gain(spark, d):
    cells = PC.box_cells(_runs(spark, d).select("run_id", "box"))
    grid = PC.relay_scenarios(cells, _relays(spark, d), PRESET, elevation=elevation(spark, d))
    out = C.relay_gain(grid, by=["run_id"])
    return out.select("run_id", r("ground_frac", 6), r("alt_frac", 6), r("gain_pts"))
