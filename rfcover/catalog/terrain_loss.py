"""ITU-R P.1812 over the path pairs, terrain and land cover."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import path as P
from ..operators import raster as RA
from ..operators.terrain_loss import path_loss_p1812
from .registry import R, grid_elev, knife, query, r
from .terrain import _CLUTTER_SQL, PAIRS_SQL, elevation, land_cover, pairs

_AE = "(6371e0 * 157 / 112)"


def _ext(hts: str, hrs: str, g: str) -> str:
    top = f"({g} + 500e0 / {_AE} * d * (dt - d))"
    inner = "i > 0 AND i < n"
    return (
        f"max(CASE WHEN {inner} THEN ({top} - {hts}) / d END) AS st, max(CASE WHEN {inner} THEN ({top} - {hrs}) / (dt - d) END) AS sr, "
        f"max(CASE WHEN {inner} THEN ({top} - ({hts} * (dt - d) + {hrs} * d) / dt) * sqrt(0.002e0 * dt / (lam * d * (dt - d))) END) AS v"
    )


def _bull(p: str, hts: str, hrs: str) -> str:
    st, sr, v = f"{p}st", f"{p}sr", f"{p}v"
    db = f"(({hrs} - {hts} + {sr} * dt) / ({st} + {sr}))"
    vb = f"(({hts} + {st} * {db} - ({hts} * (dt - {db}) + {hrs} * {db}) / dt) * sqrt(0.002e0 * dt / (lam * {db} * (dt - {db}))))"
    return f"(CASE WHEN {st} < ({hrs} - {hts}) / dt THEN {knife(v)} ELSE {knife(vb)} END)"


def _with_slope(x: str) -> str:
    return f"({x} + (1 - exp(-{x} / 6)) * (10 + 0.02e0 * dt))"


def _first_term(a: str, ht: str, hr: str, name: str, src: str) -> str:
    """CTEs of the first-term loss over land, vertical polarisation; result column ``name``."""
    return f"""
{name}_1 AS (SELECT *, 0.036e0 * power({a} * f, -1 / 3e0) * power(441 + power(0.054e0 / f, 2), -0.25e0) * sqrt(484 + power(0.054e0 / f, 2)) AS {name}_k FROM {src}),
{name}_2 AS (SELECT *, (1 + 1.6e0 * power({name}_k, 2) + 0.67e0 * power({name}_k, 4)) / (1 + 4.5e0 * power({name}_k, 2) + 1.53e0 * power({name}_k, 4)) AS {name}_b FROM {name}_1),
{name}_3 AS (SELECT *, 21.88e0 * {name}_b * power(f / power({a}, 2), 1 / 3e0) * dt AS {name}_x, 0.9575e0 * {name}_b * {name}_b * power(f * f / {a}, 1 / 3e0) * {ht} AS {name}_p, 0.9575e0 * {name}_b * {name}_b * power(f * f / {a}, 1 / 3e0) * {hr} AS {name}_q FROM {name}_2),
{name}_4 AS (SELECT *, -(CASE WHEN {name}_x >= 1.6e0 THEN 11 + 10 * log10({name}_x) - 17.6e0 * {name}_x ELSE -20 * log10({name}_x) - 5.6488e0 * power({name}_x, 1.425e0) END)
 - greatest(CASE WHEN {name}_p > 2 THEN 17.6e0 * sqrt({name}_p - 1.1e0) - 5 * log10({name}_p - 1.1e0) - 8 ELSE 20 * log10({name}_p + 0.1e0 * power({name}_p, 3)) END, 2 + 20 * log10({name}_k))
 - greatest(CASE WHEN {name}_q > 2 THEN 17.6e0 * sqrt({name}_q - 1.1e0) - 5 * log10({name}_q - 1.1e0) - 8 ELSE 20 * log10({name}_q + 0.1e0 * power({name}_q, 3)) END, 2 + 20 * log10({name}_k)) AS {name} FROM {name}_3)"""


_CLUT = (
    "(SELECT CASE class " + _CLUTTER_SQL + " ELSE 0e0 END FROM {fx_landcover} l WHERE l.x = q.px AND l.y = q.py)"
)


@query("path_loss_p1812", f"""
WITH {PAIRS_SQL},
nn AS (SELECT *, CAST(greatest(10, least(60, floor(dist / 1000 + 0.5e0))) AS BIGINT) AS n, dist / 1000 AS dt, 0.45e0 AS f, 0.2998e0 / 0.45e0 AS lam FROM pairs WHERE dist > 0),
sm AS (SELECT pair_id, n, dt, f, lam, i, dist * (i / (n * 1e0)) / 1000 AS d, a_lat + (b_lat - a_lat) * (i / (n * 1e0)) AS p_lat, a_lng + (b_lng - a_lng) * (i / (n * 1e0)) AS p_lng FROM nn, unnest(range(0, n + 1)) AS t(i)),
q AS (SELECT *, {grid_elev('p_lng', 'p_lat')} AS h, CAST(greatest(0, least(399, floor((p_lng - 3.25e0) / 0.01e0 - 0.5e0 + 0.5e0))) AS INT) AS px, CAST(greatest(0, least(279, floor((p_lat - 50.75e0) / 0.01e0 - 0.5e0 + 0.5e0))) AS INT) AS py FROM sm),
c AS (SELECT q.*, CASE l.class {_CLUTTER_SQL} ELSE 0e0 END AS cl FROM q JOIN {{fx_landcover}} l ON l.x = q.px AND l.y = q.py),
e AS (SELECT pair_id, max(CASE WHEN i = 0 THEN h END) AS h0, max(CASE WHEN i = n THEN h END) AS hn, max(CASE WHEN i = 0 THEN cl END) AS c0, max(CASE WHEN i = n THEN cl END) AS cn FROM c GROUP BY pair_id),
g AS (SELECT c.*, h + CASE WHEN i > 0 AND i < n THEN cl ELSE 0 END AS g, h0, hn, c0, cn, h0 + 10 AS hts, hn + 1.5e0 AS hrs, lag(d) OVER w AS dp, lag(h) OVER w AS hp FROM c JOIN e USING (pair_id) WINDOW w AS (PARTITION BY c.pair_id ORDER BY i)),
p1 AS (SELECT pair_id, any_value(n) AS n, any_value(dt) AS dt, any_value(f) AS f, any_value(lam) AS lam, any_value(h0) AS h0, any_value(hn) AS hn, any_value(c0) AS c0, any_value(cn) AS cn, any_value(hts) AS hts, any_value(hrs) AS hrs,
 {_ext('hts', 'hrs', 'g')},
 sum((d - dp) * (h + hp)) AS v1, sum((d - dp) * (h * (2 * d + dp) + hp * (d + 2 * dp))) AS v2,
 max(CASE WHEN i > 0 AND i < n THEN g - (hts * (dt - d) + hrs * d) / dt END) AS hobs, max(CASE WHEN i > 0 AND i < n THEN (g - (hts * (dt - d) + hrs * d) / dt) / d END) AS aobt,
 max(CASE WHEN i > 0 AND i < n THEN (g - (hts * (dt - d) + hrs * d) / dt) / (dt - d) END) AS aobr,
 max(CASE WHEN i > 0 AND i < n THEN 1000 * atan((g - hts) / (1000 * d) - d / (2 * {_AE})) END) AS tt, max(CASE WHEN i > 0 AND i < n THEN 1000 * atan((g - hrs) / (1000 * (dt - d)) - (dt - d) / (2 * {_AE})) END) AS tr
 FROM g GROUP BY pair_id),
p2 AS (SELECT *, hts - least((2 * v1 * dt - v2) / (dt * dt) - CASE WHEN hobs > 0 THEN hobs * aobt / (aobt + aobr) ELSE 0 END, h0) AS hts2, hrs - least((v2 - v1 * dt) / (dt * dt) - CASE WHEN hobs > 0 THEN hobs * aobr / (aobt + aobr) ELSE 0 END, hn) AS hrs2 FROM p1),
fl AS (SELECT g.pair_id, i, g.n, d, p2.dt, p2.lam, hts2, hrs2 FROM g JOIN p2 USING (pair_id)),
p3 AS (SELECT pair_id, {_ext('hts2', 'hrs2', '0e0')} FROM fl GROUP BY pair_id),
x0 AS (SELECT p2.*, p3.st AS s_st, p3.sr AS s_sr, p3.v AS s_v, hts2 <= 0 OR hrs2 <= 0 AS low, CASE WHEN hts2 <= 0 OR hrs2 <= 0 THEN greatest(hts2, 0.1e0) ELSE hts2 END AS ht, CASE WHEN hts2 <= 0 OR hrs2 <= 0 THEN greatest(hrs2, 0.1e0) ELSE hrs2 END AS hr FROM p2 JOIN p3 USING (pair_id)),
{_first_term(_AE, 'ht', 'hr', 'far', 'x0')},
x1 AS (SELECT *, sqrt(2 * {_AE}) * (sqrt(0.001e0 * ht) + sqrt(0.001e0 * hr)) AS dlos, 250 * dt * dt / ({_AE} * (ht + hr)) AS m, (ht - hr) / (ht + hr) AS cc, 500 * power(dt / (sqrt(ht) + sqrt(hr)), 2) AS aem FROM far_4),
x2 AS (SELECT *, dt / 2 * (1 + 2 * sqrt((m + 1) / (3 * m)) * cos(pi() / 3 + acos(greatest(-1e0, least(1e0, 1.5e0 * cc * sqrt(3 * m / power(m + 1, 3))))) / 3)) AS d1 FROM x1),
x3 AS (SELECT *, dt - d1 AS d2, ((ht - 500 * d1 * d1 / {_AE}) * (dt - d1) + (hr - 500 * (dt - d1) * (dt - d1) / {_AE}) * d1) / dt AS hse, 17.456e0 * sqrt(greatest(0e0, d1 * (dt - d1) * lam / dt)) AS need FROM x2),
{_first_term('aem', 'ht', 'hr', 'near', 'x3')},
x4 AS (SELECT *, CASE WHEN low OR dt >= dlos THEN far WHEN hse > need THEN 0 WHEN near < 0 THEN 0 ELSE (1 - hse / need) * near END AS sph, {_bull('', 'hts', 'hrs')} AS la0, {_bull('s_', 'hts2', 'hrs2')} AS ls0,
  92.4e0 + 20 * log10(f) + 20 * log10(sqrt(dt * dt + power((hts - hrs) / 1000, 2))) AS lbfs, 1000 * atan((hrs - hts) / (1000 * dt) - dt / (2 * {_AE})) AS td, 1000 * atan((hts - hrs) / (1000 * dt) - dt / (2 * {_AE})) AS rd FROM near_4),
x5 AS (SELECT *, {_with_slope('la0')} + greatest(sph - {_with_slope('ls0')}, 0) AS ld, 1000 * dt / {_AE} + CASE WHEN tt < td THEN td ELSE tt END + CASE WHEN tr >= rd THEN tr ELSE rd END AS theta FROM x4),
x6 AS (SELECT *, 190.1e0 + 25 * log10(f) - 2.5e0 * power(log10(f / 2), 2) + 20 * log10(dt) + 0.573e0 * theta - 0.15e0 * 325 AS lbs, lbfs + ld AS lbam,
  CASE WHEN c0 > 0 AND 10 < c0 THEN greatest(0e0, {knife('(0.342e0 * sqrt(f) * sqrt((c0 - 10) * degrees(atan((c0 - 10) / 27))))')} - 6.03e0) ELSE 0 END AS ct,
  CASE WHEN cn > 0 AND 1.5e0 < cn THEN greatest(0e0, {knife('(0.342e0 * sqrt(f) * sqrt((cn - 1.5e0) * degrees(atan((cn - 1.5e0) / 27))))')} - 6.03e0) ELSE 0 END AS cr FROM x5)
SELECT pair_id, {R('lbfs', 3)} AS fspl_db, {R('ld', 3)} AS diffraction_db, {R('lbs', 3)} AS troposcatter_db, {R('greatest(lbfs, -5 * log10(power(10e0, -0.2e0 * lbs) + power(10e0, -0.2e0 * lbam)) + ct + cr)', 3)} AS loss_db FROM x6""")
def path_loss(spark, d):
    p = pairs(spark, d).withColumn("distance_m", G.haversine_m("a_lat", "a_lng", "b_lat", "b_lng")).where("distance_m > 0")
    p = P.link_profiles(p, kind="p1812", start=("a_lat", "a_lng"), end=("b_lat", "b_lng"))
    p = elevation(spark, d).sample(p, "terrain_m", lng="p_lng", lat="p_lat")
    p = RA.sample_clutter(p.withColumnsRenamed({"p_lng": "lng", "p_lat": "lat"}), None, land_cover(spark, d))
    p = p.select(
        F.col("pair_id").alias("link_id"), "i", "n", F.col("d1").alias("dist_m"), "terrain_m", "clutter_m",
        F.lit(450.0).alias("freq_mhz"), F.lit(10.0).alias("tx_height_m"), F.lit(1.5).alias("rx_height_m"), F.lit(52.0).alias("lat_deg"),
    )
    out = path_loss_p1812(p)
    return out.select(F.col("link_id").alias("pair_id"), r("fspl_db", 3), r("diffraction_db", 3), r("troposcatter_db", 3), r("loss_db", 3))
