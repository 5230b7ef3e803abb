"""Links, best server, classes, zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import frame
from ..functions import link as L
from ..functions.geo import haversine_m
from ..functions.link import LinkParams
from ..operators import coverage as C
from .registry import PRESET, R, big, classes, fspl, hav, query, r


def _points(spark, d):
    return frame(spark, d, "fx_points").withColumnRenamed("point_id", "cell_id")


def _sites(spark, d):
    return frame(spark, d, "fx_sites")


def _grid(spark, d):
    """Every point with its best server and class: the flat-earth coverage run."""
    return C.coverage_grid(
        _points(spark, d).select("cell_id", "kind", "lat", "lng"),
        _sites(spark, d).select("site_id", "lat", "lng", "tx_height_m"),
        PRESET,
    )


LINKS_SQL = f"""
links AS (
  SELECT p.point_id AS cell_id, s.site_id, {hav('s.lat', 's.lng', 'p.lat', 'p.lng')} AS dist
  FROM {{fx_points}} p CROSS JOIN {{fx_sites}} s),
leveled AS (SELECT *, 20e0 - {fspl('dist', '3500e0')} AS dbm FROM links),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY dbm DESC, site_id) AS rn
  FROM leveled WHERE dbm >= -120),
best AS (
  SELECT cell_id, max(CASE WHEN rn = 1 THEN site_id END) AS best_site,
         max(CASE WHEN rn = 1 THEN dbm END) AS best_dbm,
         max(CASE WHEN rn = 2 THEN dbm END) AS second_dbm
  FROM ranked WHERE rn <= 2 GROUP BY cell_id),
grid AS (
  SELECT p.point_id AS cell_id, p.kind, p.lat, p.lng, b.best_site, b.best_dbm, b.second_dbm,
         b.best_dbm - b.second_dbm AS margin_db, {classes('b.best_dbm')} AS cls
  FROM {{fx_points}} p LEFT JOIN best b ON b.cell_id = p.point_id)"""


@query("link_levels", f"""
SELECT radio_id, {R('10 * log10(greatest(power_w, 1e-9) * 1000)')} AS tx_dbm,
       {R('power(10e0, (power_w - 60) / 10) / 1000 * 1e9', 3)} AS nanowatts,
       {R('299792458e0 / (default_freq_mhz * 1e6)')} AS wavelength_m,
       {R(fspl('(radio_id * 31 % 70000)', 'default_freq_mhz'))} AS fspl,
       {R('power_w - ' + fspl('(radio_id * 31 % 70000)', 'default_freq_mhz') + ' + 2.15e0 - 1.5e0')} AS rx_dbm
FROM {{fx_radios}}""")
def link_levels(spark, d):
    dist = F.col("radio_id") * 31 % 70000
    return frame(spark, d, "fx_radios").select(
        "radio_id",
        r(L.watts_to_dbm("power_w"), name="tx_dbm"),
        r(L.dbm_to_watts(F.col("power_w") - 60) * 1e9, 3, "nanowatts"),
        r(L.wavelength_m("default_freq_mhz"), name="wavelength_m"),
        r(L.fspl_db(dist, "default_freq_mhz"), name="fspl"),
        r(L.received_dbm(dist, "power_w", "default_freq_mhz", 2.15, 0.5, 1.0), name="rx_dbm"),
    )


@query("max_range_m", f"""
SELECT radio_id, {R('power(10e0, (10 * log10(power_w * 1000) + 2.15e0 + 120 - 20 * log10(default_freq_mhz * 1e6) - 20 * log10(4 * pi() / 299792458e0)) / 20)', 2)} AS range_m
FROM {{fx_radios}}""")
def max_range(spark, d):
    eirp = L.watts_to_dbm("power_w") + L.TX_GAIN_DBI
    return frame(spark, d, "fx_radios").select(
        "radio_id", r(L.max_range_m(eirp, "default_freq_mhz"), 2, "range_m")
    )


@query("knife_edge_db", f"""
WITH v AS (SELECT meas_id, (dbm + 60) / 20 AS v, meas_id % 5000 + 1e0 AS d1, 9000e0 AS d2 FROM {{fx_measurements}})
SELECT meas_id, {R('CASE WHEN v > -0.78e0 THEN 6.9e0 + 20 * log10(sqrt(power(v - 0.1e0, 2) + 1) + v - 0.1e0) ELSE 0 END')} AS loss_db,
       {R('d1 * d2 / (2 * 6371008.8e0 * 4 / 3)')} AS bulge_m
FROM v""")
def knife_edge(spark, d):
    m = frame(spark, d, "fx_measurements")
    return m.select(
        "meas_id",
        r(L.knife_edge_db((F.col("dbm") + 60) / 20), name="loss_db"),
        r(L.earth_bulge_m(F.col("meas_id") % 5000 + 1.0, F.lit(9000.0)), name="bulge_m"),
    )


_MIXED_DBM = "(site_id % 5) * 8e0 - 2"
_MIXED_MHZ = "(CASE site_id % 3 WHEN 0 THEN 3500e0 WHEN 1 THEN 1800e0 ELSE 700e0 END)"


@query("best_server_mixed", f"""
WITH l AS (SELECT p.point_id AS cell_id, s.site_id, {_MIXED_DBM} - {fspl(hav('s.lat', 's.lng', 'p.lat', 'p.lng'), _MIXED_MHZ)} AS dbm FROM {{fx_points}} p CROSS JOIN {{fx_sites}} s),
k AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY dbm DESC, site_id) AS rn FROM l WHERE dbm >= -120)
SELECT cell_id, max(CASE WHEN rn = 1 THEN site_id END) AS best_site, {R('max(CASE WHEN rn = 1 THEN dbm END)')} AS best_dbm, {R('max(CASE WHEN rn = 2 THEN dbm END)')} AS second_dbm
FROM k WHERE rn <= 2 GROUP BY cell_id""")
def best_server_mixed(spark, d):
    """Best server among sites of unequal power and frequency."""
    sites = _sites(spark, d).select("site_id", "lat", "lng", F.expr(_MIXED_DBM.replace("e0", "D")).alias("eirp_dbm"), F.expr(_MIXED_MHZ.replace("e0", "D")).alias("freq_mhz"))
    link = LinkParams(F.col("eirp_dbm"), F.col("freq_mhz"))
    links = C.score_links(_points(spark, d).select("cell_id", "lat", "lng"), sites, link, nearest=2)
    return C.best_server(links, link.floor_dbm).select("cell_id", "best_site", r("best_dbm"), r("second_dbm"))


@query("score_links", f"""
WITH {LINKS_SQL}
SELECT cell_id, site_id, {R('dist', 3)} AS distance_m, {R('dbm')} AS dbm FROM leveled WHERE dbm >= -120""")
def score_links(spark, d):
    links = C.score_links(_points(spark, d), _sites(spark, d), PRESET)
    return links.select("cell_id", "site_id", r("distance_m", 3), r("dbm"))


@query("best_server", f"""
WITH {LINKS_SQL}
SELECT cell_id, best_site, {R('best_dbm')} AS best_dbm, {R('second_dbm')} AS second_dbm,
       {R('best_dbm - second_dbm')} AS margin_db
FROM best""")
def best_server(spark, d):
    links = C.score_links(
        _points(spark, d).select("cell_id", "lat", "lng"), _sites(spark, d), PRESET, nearest=2
    )
    return C.best_server(links, PRESET.floor_dbm).select(
        "cell_id", "best_site", r("best_dbm"), r("second_dbm"), r("margin_db")
    )


@query("coverage_points", f"""
WITH {LINKS_SQL}
SELECT cell_id, kind, best_site, {R('best_dbm')} AS best_dbm, {R('margin_db')} AS margin_db,
       CAST(cls AS BIGINT) AS cls
FROM grid""")
def coverage_points(spark, d):
    return _grid(spark, d).select(
        "cell_id", "kind", "best_site", r("best_dbm"), r("margin_db"), big("cls")
    )


@query("classify_dbm", f"""
SELECT meas_id, CAST({classes('dbm', ('-85', '-95', '-103', '-110'))} AS BIGINT) AS cls FROM {{fx_measurements}}""")
def classify_dbm(spark, d):
    return frame(spark, d, "fx_measurements").select("meas_id", big(L.classify_dbm("dbm"), "cls"))


@query("mode_thresholds", """
SELECT radio_id, CASE radio_id % 5 WHEN 0 THEN 'Analogue' WHEN 1 THEN 'DMR' WHEN 2 THEN 'P25' WHEN 3 THEN 'dPMR' ELSE 'other' END AS mode,
  -85e0 AS excellent,
  CASE radio_id % 5 WHEN 1 THEN -98e0 WHEN 2 THEN -98e0 WHEN 3 THEN -100e0 ELSE -95e0 END AS good,
  CASE radio_id % 5 WHEN 1 THEN -107e0 WHEN 2 THEN -107e0 WHEN 3 THEN -109e0 ELSE -103e0 END AS marginal,
  CASE radio_id % 5 WHEN 1 THEN -108e0 WHEN 2 THEN -108e0 ELSE -110e0 END AS none,
  -120e0 AS floor
FROM {fx_radios}""")
def mode_thresholds(spark, d):
    k = F.col("radio_id") % 5
    mode = F.when(k == 0, "Analogue").when(k == 1, "DMR").when(k == 2, "P25").when(
        k == 3, "dPMR").otherwise("other")
    df = frame(spark, d, "fx_radios").select("radio_id", mode.alias("mode"))
    return df.select("radio_id", "mode", L.mode_thresholds("mode").alias("t")).select(
        "radio_id", "mode", "t.*"
    )


@query("thresholds_from_sensitivity", """
WITH s AS (SELECT meas_id, CASE WHEN meas_id % 9 = 0 THEN NULL ELSE dbm END AS sens FROM {fx_measurements})
SELECT meas_id, floor(sens + 25 + 0.5e0) AS excellent, floor(sens + 15 + 0.5e0) AS good,
       floor(sens + 7 + 0.5e0) AS marginal, floor(sens + 0.5e0) AS none,
       floor((coalesce(sens, -110) + 25) * 1e4 + 0.5e0) / 1e4 AS cell_excellent,
       floor((coalesce(sens, -110) + 5) * 1e4 + 0.5e0) / 1e4 AS cell_marginal
FROM s""")
def thresholds(spark, d):
    s = frame(spark, d, "fx_measurements").select(
        "meas_id", F.when(F.col("meas_id") % 9 != 0, F.col("dbm")).alias("sens")
    )
    radio, cell = L.thresholds_from_sensitivity("sens"), L.thresholds_from_sensitivity("sens", "cellular")
    return s.select("meas_id", radio.alias("t"), cell.alias("c")).select(
        "meas_id", "t.*", r("c.excellent", 4, "cell_excellent"), r("c.marginal", 4, "cell_marginal")
    )


@query("coverage_stats", f"""
WITH {LINKS_SQL}
SELECT kind, count(*) AS total, count(*) FILTER (cls <= 2) AS covered,
  count(*) FILTER (cls = 0) AS class_0, count(*) FILTER (cls = 1) AS class_1,
  count(*) FILTER (cls = 2) AS class_2, count(*) FILTER (cls = 3) AS class_3,
  count(*) FILTER (cls = 4) AS class_4,
  {R("count(*) FILTER (cls <= 2) / (count(*) * 1e0)", 6)} AS covered_frac
FROM grid GROUP BY kind""")
def coverage_stats(spark, d):
    out = C.coverage_stats(_grid(spark, d), by=["kind"])
    return out.withColumn("covered_frac", r("covered_frac", 6))


_CONTESTED = "margin_db IS NOT NULL AND least(254e0, greatest(0e0, floor(margin_db * 4 + 0.5e0))) <= 24"


@query("server_zones", f"""
WITH {LINKS_SQL}
SELECT g.best_site AS site_id, max(s.name) AS name, count(*) AS cells,
       count(*) FILTER ({_CONTESTED}) AS contested,
       {R('count(*) / (sum(count(*)) OVER () * 1e0)', 6)} AS share
FROM grid g JOIN {{fx_sites}} s ON s.site_id = g.best_site GROUP BY g.best_site""")
def server_zones(spark, d):
    zones = C.server_zones(_grid(spark, d), _sites(spark, d))
    return zones.select("site_id", "name", "cells", "contested", r("share", 6))


@query("contested_cells", f"""
WITH {LINKS_SQL}
SELECT cell_id, best_site, {R('margin_db')} AS margin_db FROM grid WHERE {_CONTESTED}""")
def contested_cells(spark, d):
    return C.contested_cells(_grid(spark, d)).select("cell_id", "best_site", r("margin_db"))


@query("cliff_band", f"""
WITH {LINKS_SQL}
SELECT cell_id, best_site, {R('best_dbm')} AS best_dbm FROM grid
WHERE {classes('best_dbm', ('-85', '-98', '-107', '-108'))} = 3""")
def cliff_band(spark, d):
    t = dict(zip(("excellent", "good", "marginal", "none"), L.MODE_THRESHOLDS["DMR"]))
    grid = _grid(spark, d).withColumn("cls", L.classify_dbm("best_dbm", t))
    return C.cliff_band(grid, "DMR").select("cell_id", "best_site", r("best_dbm"))


@query("coverage_summary", f"""
WITH {LINKS_SQL},
inside AS (SELECT g.*, {hav('52.15e0', '5.25e0', 'lat', 'lng')} <= 90000 AS inside FROM grid g)
SELECT kind, count(*) FILTER (inside) AS cells,
  {R('coalesce(100e0 * count(*) FILTER (inside AND cls <= 2) / nullif(count(*) FILTER (inside), 0), 0)')} AS covered_pct,
  CASE coalesce(max(CASE WHEN inside THEN coalesce(cls, 4) END), 0)
    WHEN 0 THEN -85e0 WHEN 1 THEN -95e0 WHEN 2 THEN -105e0 ELSE -110e0 END AS weakest_dbm,
  CAST(coalesce(max(CASE WHEN inside THEN coalesce(cls, 4) END) >= 4, false) AS BIGINT) AS weakest_below
FROM inside GROUP BY kind""")
def coverage_summary(spark, d):
    near = haversine_m(F.lit(52.15), F.lit(5.25), "lat", "lng") <= 90000
    grid = _grid(spark, d).withColumn("inside", near)
    out = C.coverage_summary(grid, by=["kind"], inside="inside", thresholds=PRESET.thresholds)
    return out.select(
        "kind", "cells", r("covered_pct"), "weakest_dbm", big("weakest_below")
    )
