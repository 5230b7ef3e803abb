"""Readers and writers over small files."""

import json

import pytest

from rfcover.functions import coords as X
from rfcover.sources import documents as D
from rfcover.sources import tables as T


def test_measurement_csv(spark, tmp_path):
    f = tmp_path / "m.csv"
    f.write_bytes(b'RSSI,LONGITUDE,Latitude,radio_id\r\n-90,0.5,0.5,"PRC, 152"\r\n-90,0.5,99,a\r\n12,0.5,0.5,a\r\n-900,0.5,0.5,a\r\nc,b,a,x\r\n-80,1,2,\r\n')
    good, bad = T.read_measurements(spark, str(f))
    rows = sorted((r.lat, r.lon, r.dbm, r.radio_id) for r in good.collect())
    assert rows == [(0.5, 0.5, -90.0, "PRC, 152"), (2.0, 1.0, -80.0, None)]
    assert bad.count() == 4
    with pytest.raises(ValueError):
        T.measurements_from_rows(spark.createDataFrame([("1", "2")], "lat string, foo string"))


def test_measurement_files_with_other_headers(spark, tmp_path):
    (tmp_path / "a b+c.csv").write_text("lat,lon,dBm\n52,5,-90\n")
    (tmp_path / "b.csv").write_text("dBm,lat,lon\n-80,51,4\n5,51,4\n")
    (tmp_path / "c.csv").write_text("")
    good, bad = T.read_measurements(spark, str(tmp_path))
    assert sorted((r.lat, r.lon, r.dbm) for r in good.collect()) == [(51.0, 4.0, -80.0), (52.0, 5.0, -90.0)]
    assert bad.count() == 1


def test_cell_snapshot_round_trip(spark, tmp_path):
    cells = spark.createDataFrame(
        [("NL", 52.0, 5.0, "LTE", 204, 8), ("BE", 50.5, 4.0, "NR", 206, 1)], "region string, lat double, lon double, radio string, mcc int, net int"
    )
    out, index = str(tmp_path / "cells"), str(tmp_path / "index")
    T.write_cell_snapshot(cells, out, index, "2026-01-01")
    T.write_cell_snapshot(cells.where("region = 'NL'").unionByName(cells.where("region = 'NL'")), out, index, "2026-02-01")
    got = {r.region: (r["count"], r.generated) for r in T.read_snapshot_index(spark, index).collect()}
    assert got == {"NL": (2, "2026-02-01"), "BE": (1, "2026-01-01")}
    rows = sorted((r.region, r.lat, r.lon, r.radio, r.mcc, r.net, r.generated) for r in T.read_snapshot_cells(spark, out, index).collect())
    assert rows == [("BE", 50.5, 4.0, "NR", 206, 1, "2026-01-01")] + 2 * [("NL", 52.0, 5.0, "LTE", 204, 8, "2026-02-01")]
    assert all((tmp_path / "cells" / r.file).is_dir() for r in T.read_snapshot_index(spark, index).collect())


KML = """<?xml version="1.0"?><kml><Document><Placemark><name>A</name><Point><coordinates>5.1,52.1,0</coordinates></Point></Placemark>
<Folder><Placemark><name>L</name><LineString><coordinates>5,52 5.1,52.1 x,y</coordinates></LineString></Placemark></Folder>
<Placemark><name>Z</name><Polygon><outerBoundaryIs><LinearRing><coordinates>5,52 6,52 6,53 5,52</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>
<Placemark><name>S</name><LineString><coordinates>5,52</coordinates></LineString></Placemark></Document></kml>"""
GPX = """<gpx><wpt lat="52.1" lon="5.1"><name>W</name><desc>d</desc></wpt><trk><name>T</name><trkseg><trkpt lat="1" lon="2"/><trkpt lat="3" lon="4"/></trkseg>
<trkseg><trkpt lat="1" lon="2"/></trkseg></trk><rte><name>R</name><rtept lat="1" lon="2"/><rtept lat="3" lon="4"/><rtept lat="5" lon="6"/></rte></gpx>"""


def test_kml_and_gpx(spark, tmp_path):
    (tmp_path / "a.kml").write_text(KML)
    (tmp_path / "a.gpx").write_text(GPX)
    k = {(r.type, r.properties["name"]): json.loads(r.coordinates) for r in D.read_kml_features(spark, str(tmp_path / "a.kml")).collect()}
    assert k == {("Point", "A"): [5.1, 52.1], ("LineString", "L"): [[5, 52], [5.1, 52.1]], ("Polygon", "Z"): [[[5, 52], [6, 52], [6, 53], [5, 52]]]}
    g = [(r.type, r.properties["name"], json.loads(r.coordinates)) for r in D.read_gpx_features(spark, str(tmp_path / "a.gpx")).collect()]
    assert sorted(g) == [("LineString", "R", [[2, 1], [4, 3], [6, 5]]), ("LineString", "T", [[2, 1], [4, 3]]), ("Point", "W", [5.1, 52.1])]


def test_mission_round_trip(spark, tmp_path):
    body = {"sites": [{"lat": 52, "lng": 5, "name": "x"}, {"lng": 1}], "route": [{"lat": 1, "lng": 2}], "aoi": {"type": "polygon", "ring": [[0, 0], [1, 0], [1, 1]]}, "extra": 1,
            "pace": {"ewThreat": ""}, "drone": {"lngLat": [5, 52]}}
    docs = {"ok": json.dumps({"format": D.MISSION_MARKER, "version": 1, "mission": body}), "v2": json.dumps({"format": D.MISSION_MARKER, "version": 2}),
            "other": json.dumps({"format": "x", "version": 1}), "bad": "{oops"}
    for k, v in docs.items():
        (tmp_path / k).write_text(v)
    ok, bad = D.read_missions(spark, str(tmp_path))
    m = ok.first().mission
    assert len(m.sites) == 1 and m.aoi.type == "polygon" and m.pace.ew_threat == "medium" and m.drone.alt_m == 120 and m.arsenal == []
    assert bad.count() == 3
    again, _ = D.parse_missions(D.mission_json(ok))
    assert again.first().mission == m


def test_mission_fields_of_other_types(spark):
    body = {"sites": [{"lat": "52", "lng": 5, "name": 7}, "x", 3, None, {"lat": {}, "lng": 1}], "points": "none", "route": {"lat": 1}, "power": {"hours": "72"},
            "aoi": [1], "teams": [{"name": "a", "members": "4"}], "coverage": 5, "opDatetime": 12}
    docs = [(str(i), json.dumps({"format": D.MISSION_MARKER, "version": "1", "mission": m})) for i, m in enumerate([body, "text", None, [1]])]
    ok, bad = D.parse_missions(spark.createDataFrame(docs, "doc_id string, value string"))
    m = {r.doc_id: r.mission for r in ok.collect()}
    assert len(m) == 4 and bad.count() == 0
    assert [(s.lat, s.lng, s.name) for s in m["0"].sites] == [(52.0, 5.0, "7")] and m["0"].points == [] and m["0"].route == [] and m["0"].aoi is None
    assert m["0"].power.hours == 72 and m["0"].teams[0].members == 4 and m["0"].coverage is None and m["0"].op_datetime == "12"
    assert all(m[k].sites == [] for k in "123")


COORDS = [
    ("52.3676, 4.9041", 52.3676, 4.9041), ("33.9249S 18.4241E", -33.9249, 18.4241), ("-1.95 30.06", -1.95, 30.06),
    ("52°22'03\"N 4°54'15\"E", 52.3675, 4.904167), ("31UFU 91733 09227", None, None), ("34H 261877 6243185", -33.9249, 18.4241),
    ("hello world", None, None), ("99.5, 4.9", None, None),
]


def test_coordinates(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(COORDS)], "i int, text string").select("i", X.parse_coordinate("text").alias("p"))
    got = {r.i: r.p for r in df.collect()}
    for i, (text, lat, lng) in enumerate(COORDS):
        if lat is not None:
            assert got[i].lat == pytest.approx(lat, abs=2e-4) and got[i].lng == pytest.approx(lng, abs=2e-4), text
        elif not text.startswith("31U"):
            assert got[i] is None, text
    assert got[4].fmt == "mgrs" and 48 < got[4].lat < 56


def test_grid_reference_round_trip(spark):
    pts = [(52.37, 4.9), (-33.92, 18.42), (0.5, -179.9), (60.4, 5.3), (78.2, 15.6), (-54.8, -68.3), (35.7, 139.7)]
    df = spark.createDataFrame(pts, "lat double, lng double").withColumn("m", X.format_mgrs("lat", "lng"))
    for r in df.withColumn("p", X.parse_mgrs("m")).collect():
        assert r.p.lat == pytest.approx(r.lat, abs=2e-5) and r.p.lng == pytest.approx(r.lng, abs=6e-5), r.m
    u = spark.createDataFrame([(52.3676, 4.9041)], "lat double, lng double").select(X.to_utm("lat", "lng").alias("u")).first().u
    assert (u.zone, u.band) == (31, "U") and u.easting == pytest.approx(629657, abs=300)


def test_coordinate_forms(spark):
    """Forms that are read, with their name, and near misses that are not."""
    from rfcover.functions import coords as X

    good = {
        "52.1, 4.5": "latlng", "-52.1,-4.5": "latlng", "52.1 ° s , -4.5 ° w": "latlng", "52.1N 4.5W": "latlng",
        "31U DQ 48251 11932": "mgrs", "31u dq 48 25 11 93": "mgrs", "31 u 448251.5 5411932.25": "utm",
        "52°30'15.5\"N, 4°20'10\"W": "dms", "4:20:10E,52:30:15N": "dms", "52 30 N 4 20 E": "dms",
    }
    bad = ["100.5, 20", "052.1 4", "31U IQ 12 34", "31U DW 12 34", "31U DQ 123", "52.5°30'15\"N 4°20'10\"E", "52°130'15\"N 4°20'10\"E", "10-20", "5 N 6 N", "N52.1 E4.5", "1 2 3", "", "camp 7"]
    df = spark.createDataFrame([(t,) for t in [*good, *bad]], "t string")
    got = {r.t: r.p for r in df.select("t", X.parse_coordinate("t").alias("p")).collect()}
    assert {t: p and p.fmt for t, p in got.items()} == {**good, **dict.fromkeys(bad)}
    assert got["52.1 ° s , -4.5 ° w"].lat == -52.1 and got["52.1 ° s , -4.5 ° w"].lng == -4.5


def test_per_row_work_is_dealt_to_all_tasks(spark):
    from rfcover.operators.search import search_labels
    from rfcover.sources.documents import parse_coordinates, parse_missions

    def dealt(df):
        return "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()

    lines = spark.createDataFrame([(1, "52.1, 4.2 gate"), (2, "no place")], "line_no int, text string")
    good, bad = parse_coordinates(lines)
    assert dealt(good) and dealt(bad) and [r.line_no for r in bad.collect()] == [2]
    docs = spark.createDataFrame([("a", "{broken")], "doc_id string, value string")
    assert all(dealt(df) for df in parse_missions(docs))
    items = spark.createDataFrame([("s", i, f"Post {i}", "mast") for i in range(9)], "section string, ordinal int, label string, keywords string")
    found = search_labels(items, spark.createDataFrame([(1, "po")], "query_id int, query string"), top=2)
    assert dealt(found) and [r.label for r in found.orderBy("rank").collect()] == ["Post 0", "Post 1"]


def test_a_mission_text_is_read_once_and_after_the_spread(spark):
    docs = spark.createDataFrame([("a", '{"format": "%s", "version": 1, "mission": {}}' % D.MISSION_MARKER), ("b", None), ("c", "{broken"), ("d", "[1]")], "doc_id string, value string")
    ok, bad = D.parse_missions(docs)
    plan = ok._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and "from_json(" not in plan[plan.index("RepartitionByExpression"):]  # all above it, so done after it
    assert [r.doc_id for r in ok.collect()] == ["a"]
    assert {r.doc_id: r.error for r in bad.collect()} == {"b": "The text is not JSON.", "c": "The text is not JSON.", "d": "The text is not JSON."}
