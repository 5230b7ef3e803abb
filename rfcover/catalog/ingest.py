"""Sources and sinks over texts that Spark derives from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import frame, sql
from ..sources import documents as D
from ..sources import tables as TB
from .missions import missions
from .registry import R, big, query, r
from .spatial import UTM_INVERSE_SQL, areas

_MEAS = """
SELECT meas_id, CASE WHEN meas_id % 50 = 0 THEN '99.5' WHEN meas_id % 51 = 0 THEN 'abc' WHEN meas_id % 52 = 0 THEN '' ELSE CAST(lat AS VARCHAR(40)) END AS lat_t,
 CAST(lon AS VARCHAR(40)) AS lon_t, CASE WHEN meas_id % 53 = 0 THEN '12' ELSE CAST(dbm AS VARCHAR(40)) END AS dbm_t, CASE WHEN meas_id % 7 = 0 THEN ' ' ELSE radio_id END AS rid FROM {fx_measurements}"""


def _measurement_rows(spark, d):
    """Measurements as the text columns a CSV with odd headers gives."""
    return sql(spark, d, _MEAS).select(
        F.col("lat_t").alias("Latitude"), F.col("lon_t").alias("LONGITUDE"), F.col("dbm_t").alias("Signal dBm"), F.col("rid").alias("radio_name")
    )


_GOOD = "TRY_CAST(lat_t AS DOUBLE) BETWEEN -90 AND 90 AND TRY_CAST(lon_t AS DOUBLE) BETWEEN -180 AND 180 AND TRY_CAST(dbm_t AS DOUBLE) BETWEEN -160 AND 0"


@query("read_measurements", f"""
WITH t AS ({_MEAS.strip()}) SELECT CAST(lat_t AS DOUBLE) AS lat, CAST(lon_t AS DOUBLE) AS lon, CAST(dbm_t AS DOUBLE) AS dbm, nullif(trim(rid), '') AS radio_id FROM t WHERE {_GOOD}""")
def read_measurements(spark, d):
    return TB.measurements_from_rows(_measurement_rows(spark, d))[0]


@query("rejected_measurements", f"""
WITH t AS ({_MEAS.strip()}) SELECT count(*) AS rejected FROM t WHERE NOT coalesce({_GOOD}, false)""")
def rejected_measurements(spark, d):
    return TB.measurements_from_rows(_measurement_rows(spark, d))[1].agg(F.count(F.lit(1)).alias("rejected"))


@query("read_cell_export", """
SELECT cell_id, floor(lat * 1e5 + 0.5e0) / 1e5 AS lat, floor(lon * 1e5 + 0.5e0) / 1e5 AS lon, radio, CAST(mcc AS BIGINT) AS mcc, CAST(nullif(net, 0) AS BIGINT) AS net FROM {fx_cells} WHERE radio <> 'CDMA'""")
def read_cell_export(spark, d):
    c = frame(spark, d, "fx_cells")
    rows = c.select(*[F.col(k).cast("string").alias(k) for k in c.columns if k != "cell_id"], "cell_id")
    return TB.cells_from_rows(rows, order="cell_id").select("cell_id", "lat", "lon", "radio", big("mcc"), big("net"))


@query("snapshot_index", """
SELECT 'R' || mcc AS region, 'r' || mcc || '.json' AS file, min(lon) AS west, max(lat) AS north, count(*) AS count FROM {fx_cells} WHERE radio <> 'CDMA' GROUP BY mcc""")
def snapshot_index(spark, d):
    c = TB.cells_from_rows(frame(spark, d, "fx_cells")).withColumn("region", F.concat(F.lit("R"), F.col("mcc")))
    return TB.snapshot_index(c).select("region", "file", "box.west", "box.north", "count")


def _docs(df, key, value):
    return df.select(F.col(key).cast("string").alias("doc_id"), value.alias("value"))


def _snapshot_docs(spark, d):
    """One snapshot document per cell of the table: a small region file each."""
    c = frame(spark, d, "fx_cells")
    cell = F.struct("lat", "lon", "radio", "mcc", "net", (F.col("cell_id") % 900 * 1.0).alias("range"))
    broken = F.struct(F.lit(None).cast("double").alias("lat"), F.col("lon"), F.col("radio"), F.col("mcc"), F.col("net"), F.lit(0.0).alias("range"))
    body = F.struct(F.concat(F.lit("C"), F.col("mcc")).alias("region"), F.lit("2026-01-01").alias("generated"), F.array(cell, broken).alias("cells"))
    return _docs(c, "cell_id", F.to_json(body))


@query("read_cell_snapshot", """
SELECT CAST(cell_id AS VARCHAR) AS doc_id, 'C' || mcc AS region, lat, lon, radio, CAST(mcc AS BIGINT) AS mcc, CAST(net AS BIGINT) AS net, (cell_id % 900) * 1e0 AS range FROM {fx_cells}""")
def read_cell_snapshot(spark, d):
    out = D.parse_cell_snapshot(_snapshot_docs(spark, d)).where("lat IS NOT NULL")
    return out.select("doc_id", "region", "lat", "lon", "radio", big("mcc"), big("net"), "range")


_TAGS = "CASE cell_id % 6 WHEN 0 THEN 'communication:5g' WHEN 1 THEN 'communication:lte' WHEN 2 THEN 'communication:3g' WHEN 3 THEN 'communication:gsm' ELSE 'height' END"
_OPNAME = "CASE cell_id % 5 WHEN 0 THEN 'Net 5G' WHEN 1 THEN ' Mobile UMTS ' WHEN 2 THEN '' WHEN 3 THEN 'Telco 2g' ELSE 'Plain' END"


@query("read_osm_towers", f"""
WITH t AS (SELECT CAST(cell_id AS VARCHAR) AS doc_id, lat, lon, {_TAGS} AS tag, {_OPNAME} AS op FROM {{fx_cells}}),
a AS (SELECT *, CASE tag WHEN 'communication:5g' THEN 'NR' WHEN 'communication:lte' THEN 'LTE' WHEN 'communication:3g' THEN 'UMTS' WHEN 'communication:gsm' THEN 'GSM'
 ELSE CASE WHEN op = 'Net 5G' THEN 'NR' WHEN op = ' Mobile UMTS ' THEN 'UMTS' WHEN op = 'Telco 2g' THEN 'GSM' ELSE 'LTE' END END AS radio FROM t)
SELECT doc_id, lat, lon, radio, nullif(trim(op), '') AS operator FROM a UNION ALL SELECT doc_id, lat + 1, lon, 'LTE', NULL FROM a""")
def read_osm_towers(spark, d):
    c = frame(spark, d, "fx_cells").select("cell_id", "lat", "lon", F.expr(_TAGS).alias("tag"), F.expr(_OPNAME).alias("op"))
    node = F.struct("lat", "lon", F.create_map(F.col("tag"), F.lit("yes"), F.lit("operator"), F.col("op")).alias("tags"))
    twin = F.struct("lat", "lon", F.create_map(F.lit("operator"), F.lit("late 4g")).alias("tags"))
    bare = F.struct((F.col("lat") + 1).alias("lat"), F.col("lon"), F.lit(None).cast("map<string,string>").alias("tags"))
    lost = F.struct(F.lit(None).cast("double").alias("lat"), F.col("lon"), F.lit(None).cast("map<string,string>").alias("tags"))
    docs = _docs(c, "cell_id", F.to_json(F.struct(F.array(node, twin, bare, lost).alias("elements"))))
    return D.parse_osm_towers(docs)


def geojson_docs(spark, d):
    """Per area a collection (centre, ring or line, one invalid); per point a bare geometry or
    a lone feature."""
    a = areas(spark, d).join(frame(spark, d, "fx_areas").select("aoi_id", "center_lat", "center_lng", "half"), "aoi_id")
    x, y, h = F.col("center_lng"), F.col("center_lat"), F.col("half")

    def text(v):
        return F.to_json(v)

    props = F.concat(F.lit('{"name":"area '), F.col("aoi_id"), F.lit('"}'))
    ring = F.transform("aoi.ring", lambda v: F.array(v["lng"], v["lat"]))
    shape = F.when(F.col("aoi.ring").isNotNull(), F.concat(F.lit('"Polygon","coordinates":['), text(ring), F.lit("]"))).otherwise(
        F.concat(F.lit('"LineString","coordinates":'), text(F.array(F.array(x - h, y), F.array(x + h, y + h)))))
    coll = F.concat(
        F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":'), props, F.lit(',"geometry":{"type":"Point","coordinates":'), text(F.array(x, y)),
        F.lit('}},{"type":"Feature","geometry":{"type":'), shape, F.lit('}},{"type":"Feature","geometry":{"type":"Circle","coordinates":[1,2]}},{"type":"Other"}]}'),
    )
    p = frame(spark, d, "fx_points")
    spot = text(F.array("lng", "lat"))
    geom = F.concat(F.lit('{"type":"Point","coordinates":'), spot, F.lit("}"))
    lone = F.concat(F.lit('{"type":"Feature","properties":{"name":"'), F.col("kind"), F.lit('"},"geometry":'), geom, F.lit("}"))
    one = F.when(F.col("point_id") % 3 == 0, geom).when(F.col("point_id") % 3 == 1, lone).otherwise(F.lit('{"type":"Topology"}'))
    return _docs(a, "aoi_id", coll).withColumn("doc_id", F.concat(F.lit("a"), "doc_id")).unionByName(
        _docs(p, "point_id", one).withColumn("doc_id", F.concat(F.lit("p"), "doc_id")))


FEATURES_SQL = """
feat AS (SELECT 'a' || aoi_id AS doc_id, 0 AS no, 'Point' AS type, 'area ' || aoi_id AS name, center_lng AS w, center_lat AS s, center_lng AS e, center_lat AS n FROM {fx_areas}
 UNION ALL SELECT 'a' || aoi_id, 1, CASE type WHEN 'polygon' THEN 'Polygon' ELSE 'LineString' END, NULL, center_lng - half, CASE type WHEN 'polygon' THEN center_lat - half ELSE center_lat END, center_lng + half, center_lat + half FROM {fx_areas}
 UNION ALL SELECT 'p' || point_id, 0, 'Point', CASE WHEN point_id % 3 = 1 THEN kind END, lng, lat, lng, lat FROM {fx_points} WHERE point_id % 3 <> 2)"""


@query("read_geojson_features", f"WITH {FEATURES_SQL} SELECT doc_id, CAST(no AS BIGINT) AS no, type, name FROM feat")
def read_geojson_features(spark, d):
    f = D.parse_geojson(geojson_docs(spark, d))
    return f.select("doc_id", big("no"), "type", F.element_at("properties", "name").alias("name"))


@query("feature_counts", f"""
WITH {FEATURES_SQL} SELECT substr(doc_id, 1, 1) AS source, count(*) FILTER (type = 'Point') AS points, count(*) FILTER (type = 'LineString') AS lines, count(*) FILTER (type = 'Polygon') AS polygons FROM feat GROUP BY ALL""")
def feature_counts(spark, d):
    f = D.parse_geojson(geojson_docs(spark, d)).withColumn("source", F.substring("doc_id", 1, 1))
    return D.feature_counts(f, ["source"])


@query("feature_extent", f"""
WITH {FEATURES_SQL} SELECT doc_id, {R('min(w)', 6)} AS west, {R('min(s)', 6)} AS south, {R('max(e)', 6)} AS east, {R('max(n)', 6)} AS north FROM feat GROUP BY doc_id""")
def feature_extent(spark, d):
    out = D.feature_extent(D.parse_geojson(geojson_docs(spark, d)), ["doc_id"])
    return out.select("doc_id", *[r(k, 6) for k in ("west", "south", "east", "north")])


@query("promote_features", f"""
WITH {FEATURES_SQL} SELECT doc_id, 'point' AS target, 1 AS n FROM feat WHERE type = 'Point'
UNION ALL SELECT doc_id, CASE type WHEN 'Polygon' THEN 'aoi' ELSE 'route' END, CASE type WHEN 'Polygon' THEN 5 ELSE 2 END FROM feat WHERE type <> 'Point'""".replace("1 AS n", "CAST(1 AS BIGINT) AS n").replace("CASE type WHEN 'Polygon' THEN 5 ELSE 2 END", "CAST(CASE type WHEN 'Polygon' THEN 5 ELSE 2 END AS BIGINT)"))
def promote_features(spark, d):
    """Rows each document gives to each mission table."""
    parts = D.promote_features(D.parse_geojson(geojson_docs(spark, d)))
    out = None
    for target, key in (("point", "points"), ("route", "route"), ("aoi", "aoi")):
        p = parts[key].groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).select("doc_id", F.lit(target).alias("target"), "n")
        out = p if out is None else out.unionByName(p)
    return out


@query("read_kml_features")
def read_kml_features(spark, d):
    """Placemarks written from the sites and areas, read back."""
    a = areas(spark, d).join(frame(spark, d, "fx_areas").select("aoi_id", "center_lat", "center_lng"), "aoi_id")
    ring = F.array_join(F.transform("aoi.ring", lambda v: F.concat(v["lng"], F.lit(","), v["lat"], F.lit(",0"))), " ")
    point = F.concat(F.lit("<Point><coordinates>"), F.col("center_lng"), F.lit(","), F.col("center_lat"), F.lit("</coordinates></Point>"))
    poly = F.concat(F.lit("<Polygon><outerBoundaryIs><LinearRing><coordinates>"), ring, F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon>"))
    xml = F.concat(F.lit("<Placemark><name>area "), F.col("aoi_id"), F.lit("</name>"), F.when(ring.isNotNull(), F.concat(
        F.lit("<MultiGeometry>"), point, poly, F.lit("</MultiGeometry>"))).otherwise(point), F.lit("</Placemark>"))
    out = D.parse_kml(a.select("aoi_id", xml.alias("value")))
    return out.select("aoi_id", big("no"), "type", "coordinates", F.element_at("properties", "name").alias("name"))


@query("read_gpx_features")
def read_gpx_features(spark, d):
    """Routes written as GPX route elements, one per user and 16 vertices, read back."""
    rt = frame(spark, d, "fx_routes").withColumn("leg", F.floor(F.col("seq") / 16))
    pt = F.concat(F.lit('<rtept lat="'), F.col("lat"), F.lit('" lon="'), F.col("lng"), F.lit('"/>'))
    docs = rt.groupBy("route_id", "leg").agg(F.array_sort(F.collect_list(F.struct("seq", pt.alias("pt")))).alias("v"))
    xml = F.concat(F.lit("<rte><name>r</name>"), F.array_join(F.transform("v", lambda s: s["pt"]), ""), F.lit("</rte>"))
    rows = docs.select("route_id", "leg", F.from_xml(xml, D.GPX_SCHEMAS["rte"]).alias("x")).select("route_id", "leg", "x.*")
    return D.gpx_features(rows, "rte").select("route_id", "leg", "type", "coordinates")


_PLACES = """
SELECT CAST(c_custkey AS VARCHAR(20)) AS doc_id, c_mktsegment AS name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN 'Town' END AS city, CASE WHEN c_custkey % 2 = 0 THEN 'State' END AS state, 'County' AS county,
 CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'Land' END AS country, lat, lng FROM {customer} JOIN {fx_points} ON point_id = c_custkey"""


@query("parse_places", f"""
WITH p AS ({_PLACES.strip()})
SELECT doc_id, concat_ws(', ', name, CASE WHEN city <> name THEN city END, coalesce(state, county), country) AS display_name, lat, lng AS lon, lat - 1 AS south, lng + 1 AS east FROM p""")
def parse_places(spark, d):
    p = sql(spark, d, _PLACES)
    x, y = F.col("lng"), F.col("lat")
    ok = F.struct(F.struct(F.array(x, y).alias("coordinates")).alias("geometry"), F.struct(
        "name", "city", "state", "county", "country", F.array(x - 1, y + 1, x + 1, y - 1).alias("extent")).alias("properties"))
    docs = p.select("doc_id", F.to_json(F.struct(F.array(ok).alias("features"))).alias("value"))
    out = D.parse_places(docs)
    return out.select("doc_id", "display_name", "lat", "lon", "box.south", "box.east")


_LINES = """
SELECT point_id AS line_no, CASE point_id % 6
 WHEN 0 THEN CAST(lat AS VARCHAR(30)) || ', ' || CAST(lng AS VARCHAR(30)) || '  north gate'
 WHEN 1 THEN CAST(lat AS VARCHAR(30)) || 'S ' || CAST(lng AS VARCHAR(30)) || 'W post 7'
 WHEN 2 THEN (point_id % 60 + 10) || '°' || (point_id % 50 + 10) || '''' || (point_id % 40 + 10) || '"N ' || (point_id % 100) || '°' || (point_id % 55) || '''30.5"E camp'
 WHEN 3 THEN '31U ' || (400000 + point_id * 7 % 200000) || ' ' || (5500000 + point_id * 11 % 300000)
 WHEN 4 THEN 'hello world ' || point_id ELSE '   ' END AS text FROM {fx_points}"""


@query("parse_coordinates", f"""
WITH t AS ({_LINES.strip()}),
p AS (SELECT line_no, 31 AS zone, 400000e0 + line_no * 7 % 200000 AS e, 5500000e0 + line_no * 11 % 300000 AS nn, true AS north FROM t WHERE line_no % 6 = 3),
{UTM_INVERSE_SQL}
SELECT line_no, {R('CAST(regexp_extract(text, $$^(-?[0-9.]+), ([0-9.]+)  north gate$$, 1) AS DOUBLE)', 6)} AS lat, {R('CAST(regexp_extract(text, $$^(-?[0-9.]+), ([0-9.]+)  north gate$$, 2) AS DOUBLE)', 6)} AS lng, 'latlng' AS fmt, 'north gate' AS name FROM t WHERE line_no % 6 = 0
UNION ALL SELECT line_no, {R('-CAST(regexp_extract(text, $$^([0-9.]+)S ([0-9.]+)W$$, 1) AS DOUBLE)', 6)}, {R('-CAST(regexp_extract(text, $$^([0-9.]+)S ([0-9.]+)W$$, 2) AS DOUBLE)', 6)}, 'latlng', 'post 7' FROM t WHERE line_no % 6 = 1
UNION ALL SELECT line_no, {R('(line_no % 60 + 10) + (line_no % 50 + 10) / 60e0 + (line_no % 40 + 10) / 3600e0', 6)}, {R('line_no % 100 + (line_no % 55) / 60e0 + 30.5e0 / 3600', 6)}, 'dms', 'camp' FROM t WHERE line_no % 6 = 2
UNION ALL SELECT line_no, {R('lat', 6)}, {R('lng', 6)}, 'utm', '' FROM latlng""")
def parse_coordinates(spark, d):
    """Lines of every form; the bad ones are in ``rejected_coordinates``."""
    good, _ = D.parse_coordinates(sql(spark, d, _LINES))
    return good.select("line_no", r("lat", 6), r("lng", 6), "fmt", "name")


@query("rejected_coordinates", f"WITH t AS ({_LINES.strip()}) SELECT line_no, text FROM t WHERE line_no % 6 = 4")
def rejected_coordinates(spark, d):
    return D.parse_coordinates(sql(spark, d, _LINES))[1].select("line_no", "text")


@query("read_radio_catalog", """
SELECT 'k' || radio_id AS id, label, role, default_freq_mhz - 1 AS freq_lo, default_freq_mhz, power_w, price FROM {fx_radios}""")
def read_radio_catalog(spark, d):
    x = frame(spark, d, "fx_radios")
    js = F.to_json(F.struct(F.concat(F.lit("k"), F.col("radio_id")).alias("id"), "label", "role", F.array(F.col("default_freq_mhz") - 1, F.col("default_freq_mhz") + 1).alias("freqRangeMHz"),
                            F.col("power_w").alias("powerW"), "price"))
    rows = x.select(F.from_json(js, D.RADIO_SCHEMA).alias("j")).select("j.*")
    return D.radios_from_json(rows).select("id", "label", "role", "freq_lo", "default_freq_mhz", "power_w", "price")


def _mission_docs(spark, d):
    m = frame(spark, d, "fx_missions")
    body = F.struct(
        F.struct(F.lit("radius").alias("type"), F.struct("lat", F.lit(5.0).alias("lng")).alias("center"), (F.col("hours") * 100.0).alias("radiusM")).alias("aoi"),
        F.array(F.struct("lat", F.lit(5.0).alias("lng"), "name"), F.struct(F.lit(None).cast("double").alias("lat"), F.lit(5.0).alias("lng"), F.lit("lost").alias("name"))).alias("sites"),
        F.struct("hours", F.col("bank_v").alias("bankV")).alias("power"), F.lit("x").alias("unknown"),
    )
    k = F.col("mission_id") % 5
    marker = F.when(k == 1, "other").otherwise(D.MISSION_MARKER)
    text = F.to_json(F.struct(marker.alias("format"), F.when(k == 2, 2).otherwise(1).alias("version"), F.lit("2026-01-01").alias("savedAt"), body.alias("mission")))
    text = F.when(k == 3, F.concat(F.lit("{broken "), F.col("name"))).otherwise(text)
    return m.select(F.col("mission_id").cast("string").alias("doc_id"), text.alias("value"))


@query("read_missions", """
SELECT CAST(mission_id AS VARCHAR) AS doc_id, CASE mission_id % 5 WHEN 1 THEN 'The format marker is absent or unknown.' WHEN 2 THEN 'Version 2 is newer than 1, the last that this reader knows.' WHEN 3 THEN 'The text is not JSON.' END AS error,
 CASE WHEN mission_id % 5 NOT IN (1, 2, 3) THEN CAST(1 AS BIGINT) END AS sites, CASE WHEN mission_id % 5 NOT IN (1, 2, 3) THEN hours * 100e0 END AS radius_m FROM {fx_missions}""")
def read_missions(spark, d):
    ok, bad = D.parse_missions(_mission_docs(spark, d))
    good = ok.select("doc_id", F.lit(None).cast("string").alias("error"), big(F.size("mission.sites"), "sites"), F.col("mission.aoi.radius_m").alias("radius_m"))
    return good.unionByName(bad, allowMissingColumns=True)


@query("write_mission")
def write_mission(spark, d):
    """Missions read, written and read again."""
    ok, _ = D.parse_missions(_mission_docs(spark, d))
    again, _ = D.parse_missions(D.mission_json(ok, saved_at="2026-01-01"))
    return again.select("doc_id", "version", F.to_json("mission").alias("mission"))


@query("to_geojson")
def to_geojson(spark, d):
    sites = frame(spark, d, "fx_m_sites").drop("site_id")
    return D.to_geojson(sites, None, frame(spark, d, "fx_m_points").drop("point_id"), frame(spark, d, "fx_m_routes"), missions(spark, d).where("aoi IS NOT NULL"))
