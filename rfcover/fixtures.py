"""Views over the test tables: sites, points, measurements, cells, radios, routes.

Each body is plain SQL that Spark and DuckDB read alike. A name in braces is a
table; :func:`frame` binds it to a parquet scan or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS = {
    "fx_sites": """
SELECT s_suppkey AS site_id, s_name AS name,
       50.75e0 + ((s_suppkey * 7919) % 28000) / 1e4 AS lat,
       3.25e0 + ((s_suppkey * 104729) % 40000) / 1e4 AS lng,
       10e0 + (s_suppkey % 5) * 5e0 AS tx_height_m
FROM {supplier}""",
    "fx_points": """
SELECT c_custkey AS point_id, c_mktsegment AS kind,
       50.75e0 + ((c_custkey * 6007) % 28000) / 1e4 AS lat,
       3.25e0 + ((c_custkey * 15013) % 40000) / 1e4 AS lng
FROM {customer}""",
    "fx_measurements": """
SELECT event_id AS meas_id, ts, event_type AS radio_id,
       50.75e0 + ((event_id * 3571) % 28000) / 1e4 AS lat,
       3.25e0 + ((event_id * 9203 + user_id * 17) % 40000) / 1e4 AS lon,
       -40e0 - value AS dbm
FROM {events}""",
    "fx_cells": """
SELECT o_orderkey AS cell_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'NR' WHEN '2-HIGH' THEN 'LTE'
            WHEN '3-MEDIUM' THEN 'UMTS' WHEN '5-LOW' THEN 'GSM' ELSE 'CDMA' END AS radio,
       CASE o_custkey % 5 WHEN 0 THEN 204 WHEN 1 THEN 206 WHEN 2 THEN 262 WHEN 3 THEN 208 ELSE 310 END AS mcc,
       CAST(o_custkey % 24 AS INT) AS net,
       50.75e0 + ((o_orderkey * 31) % 280) / 1e2 AS lat,
       3.25e0 + ((o_orderkey * 57) % 200) / 5e1 AS lon
FROM {orders}""",
    "fx_radios": """
SELECT p_partkey AS radio_id, p_name AS label,
       CASE p_size % 9 WHEN 0 THEN 'handheld' WHEN 1 THEN 'manpack' WHEN 2 THEN 'manet'
            WHEN 3 THEN 'mobile' WHEN 4 THEN 'base' WHEN 5 THEN 'repeater'
            WHEN 6 THEN 'lora' WHEN 7 THEN 'satcom' ELSE 'hf' END AS role,
       CASE p_partkey % 4 WHEN 0 THEN 7e0 WHEN 1 THEN 155e0 WHEN 2 THEN 450e0 ELSE 1800e0 END AS default_freq_mhz,
       1e0 + p_size AS power_w,
       CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS price
FROM {part}""",
    "fx_routes": """
SELECT user_id AS route_id,
       ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
       51e0 + ((user_id * 37) % 100) / 1e2 + ((event_id * 7) % 50) / 1e4 AS lat,
       4e0 + ((user_id * 53) % 100) / 1e2 + ((event_id * 11) % 50) / 1e4 AS lng
FROM {events}""",
    "fx_traffic": """
SELECT event_type AS team, COUNT(DISTINCT user_id) AS users,
       COUNT(*) / 720e0 / COUNT(DISTINCT user_id) AS calls_per_user_hour,
       AVG(value) AS avg_call_sec
FROM {events} GROUP BY event_type""",
    # Areas of interest, one per site: discs for even ids, concave five-corner rings else.
    "fx_areas": """
SELECT s_suppkey AS aoi_id,
       CASE WHEN s_suppkey % 2 = 0 THEN 'radius' ELSE 'polygon' END AS type,
       50.75e0 + ((s_suppkey * 7919) % 28000) / 1e4 AS center_lat,
       3.25e0 + ((s_suppkey * 104729) % 40000) / 1e4 AS center_lng,
       8000e0 + (s_suppkey % 7) * 3000e0 AS radius_m,
       5e-2 + (s_suppkey % 5) / 5e1 AS half
FROM {supplier}""",
    "fx_area_vertices": """
SELECT a.aoi_id, k.i,
       a.center_lng + k.dx * a.half AS lng, a.center_lat + k.dy * a.half AS lat
FROM {fx_areas} a CROSS JOIN (VALUES (0, -1e0, -1e0), (1, 1e0, -1e0), (2, 2e-1, 1e-1),
     (3, 1e0, 1e0), (4, -1e0, 1e0)) AS k(i, dx, dy)
WHERE a.type = 'polygon'""",
    # Missions: one per site; its customers' points, its users' route, its radios.
    "fx_missions": """
SELECT s_suppkey AS mission_id, s_name AS name,
       (s_suppkey * 13 % 400) / 1e0 AS aoi_area_km2,
       (s_suppkey * 7 % 90) / 1e0 AS route_length_km,
       (s_suppkey * 3 % 50) / 2e0 AS max_site_distance_km,
       (s_suppkey * 11 % 160) / 1e0 AS ruggedness_m,
       (s_suppkey * 5 % 50) / 1e2 AS urban_frac,
       (s_suppkey * 17 % 100) / 1e2 AS coverage_frac,
       s_suppkey % 14 AS point_count,
       s_suppkey % 3 AS fixed_sites, (s_suppkey * 7) % 3 AS recommended_sites,
       s_suppkey % 4 = 0 AS drone_relay,
       CASE WHEN s_suppkey % 8 = 0 THEN 120e0 ELSE NULL END AS drone_alt_m,
       CASE s_suppkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS ew_threat,
       CASE s_suppkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'alternate' ELSE 'contingency' END AS cell_for_pace,
       s_suppkey % 5 < 3 AS terrain, 15e-1 AS rx_height_m,
       4e0 + (s_suppkey % 70) AS hours,
       30e0 AS every_min, (s_suppkey % 6) / 1e0 AS tx_min, (s_suppkey % 4) / 1e0 AS continuous_h,
       CASE WHEN s_suppkey % 2 = 0 THEN 12e0 ELSE 24e0 END AS bank_v,
       370e0 AS drone_wh, 600e0 AS eud_ma, 5000e0 AS eud_mah,
       50.75e0 + ((s_suppkey * 7919) % 28000) / 1e4 AS lat
FROM {supplier}""",
    # Plans by country: its sites, its customers as demand, its users' routes in a row.
    "fx_m_sites": """
SELECT CAST(s_nationkey AS BIGINT) AS mission_id, f.site_id, f.name, f.lat, f.lng
FROM {supplier} s JOIN {fx_sites} f ON f.site_id = s.s_suppkey""",
    "fx_m_points": """
SELECT CAST(c_nationkey AS BIGINT) AS mission_id, f.point_id, f.lat, f.lng
FROM {customer} c JOIN {fx_points} f ON f.point_id = c.c_custkey""",
    "fx_m_routes": """
SELECT route_id % 25 AS mission_id, ROW_NUMBER() OVER (PARTITION BY route_id % 25 ORDER BY route_id, seq) AS seq, lat, lng
FROM {fx_routes}""",
    # Radios carried by each mission: the parts its site ships.
    "fx_arsenal": """
SELECT DISTINCT l.l_suppkey AS mission_id, r.radio_id, r.label, r.role, r.default_freq_mhz,
       r.power_w, r.price,
       CASE WHEN r.radio_id % 3 = 0 THEN 2000e0 + (r.radio_id % 5) * 400e0 ELSE NULL END AS battery_mah
FROM {lineitem} l JOIN {fx_radios} r ON l.l_partkey = r.radio_id""",
}

# The terrain grid: 280 x 400 pixels of 0.01 degree, row 0 in the south.
ELEVATION_EXPR = "(16 - ABS((x % 32) - 16)) * 12 + (10 - ABS((y % 20) - 10)) * 9"
GRID_WEST, GRID_SOUTH, GRID_STEP, GRID_COLS, GRID_ROWS = 3.25, 50.75, 0.01, 400, 280
VIEWS_DUCKDB = {
    "fx_elevation": f"""
SELECT x, y, CAST({ELEVATION_EXPR} AS DOUBLE) AS elev_m
FROM (SELECT CAST(i % 400 AS INT) AS x, CAST(i // 400 AS INT) AS y FROM range(112000) t(i))""",
    "fx_landcover": """
SELECT x, y, [10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100][1 + (x * 7 + y * 13) % 11] AS class
FROM (SELECT CAST(i % 400 AS INT) AS x, CAST(i // 400 AS INT) AS y FROM range(112000) t(i))""",
}
# The bodies that Spark reads; a view named here and above gives the same rows.
VIEWS_SPARK = {
    # Each pair of site and part once before the join, which so carries no repeats.
    "fx_arsenal": VIEWS["fx_arsenal"].replace("FROM {lineitem} l", "FROM (SELECT DISTINCT l_suppkey, l_partkey FROM {lineitem}) l"),
    "fx_elevation": f"""
SELECT x, y, CAST({ELEVATION_EXPR} AS DOUBLE) AS elev_m
FROM (SELECT CAST(id % 400 AS INT) AS x, CAST(id DIV 400 AS INT) AS y FROM range(112000))""",
    "fx_landcover": """
SELECT x, y, array(10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100)[(x * 7 + y * 13) % 11] AS class
FROM (SELECT CAST(id % 400 AS INT) AS x, CAST(id DIV 400 AS INT) AS y FROM range(112000))""",
}

_NAME = re.compile(r"\{(\w+)\}")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table or one of the views above, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    body = VIEWS_SPARK.get(name) or VIEWS[name]
    return sql(spark, sf_dir, body)


def sql(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    deps = {n: frame(spark, sf_dir, n) for n in dict.fromkeys(_NAME.findall(body))}
    return spark.sql(body, **deps)


def oracle(body: str, recursive: bool = False) -> str:
    """DuckDB text of a query: every ``{view}`` it names becomes a WITH clause."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in TABLES or name in order:
                continue
            view = VIEWS.get(name) or VIEWS_DUCKDB[name]
            visit(view)
            if name not in order:
                order.append(name)

    visit(body)

    def plain(text: str) -> str:
        return _NAME.sub(r"\1", text).strip()

    ctes = [f"{n} AS ({plain(VIEWS.get(n) or VIEWS_DUCKDB[n])})" for n in order]
    body = plain(body)
    head = "WITH RECURSIVE " if recursive else "WITH "
    if body.upper().startswith("WITH "):
        return head + ",\n".join(ctes + [body[5:]])
    return (head + ",\n".join(ctes) + "\n" if ctes else "") + body
