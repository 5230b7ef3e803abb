"""Calibration, power, capacity and radio rules."""

import pytest
from pyspark.sql import functions as F

from rfcover.operators import calibration as K
from rfcover.operators import power as P
from rfcover.operators import radios as R
from rfcover.operators import towers as T


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_fit(spark):
    s = spark.createDataFrame(
        [("a", -90.0, -84.0), ("a", -80.0, -76.0), ("b", -70.0, -73.0), ("b", float("nan"), -1.0), (None, -50.0, -50.0)],
        "radio_id string, measured_dbm double, predicted_dbm double",
    )
    rows = K.fit_calibration(s).collect()
    assert rows[0].radio_id == "a"
    a = rows[0]
    assert (a.n, a.offset_db, a.rmse_before, a.rmse_after, a.sd_delta) == (2, -5.0, 5.1, 1.0, 1.0)
    assert {r.radio_id: r.offset_db for r in rows} == {"a": -5.0, "b": 3.0, None: 0.0}
    assert "lat" not in K.calibration_json(K.fit_calibration(s)).first().value


def test_power(spark):
    usual = F.struct(F.lit(0.05).alias("tx"), F.lit(0.05).alias("rx"), F.lit(0.9).alias("standby"))
    e = value(spark, P.operator_endurance(P.profile_of(F.lit("handheld")), F.lit(24.0), usual))
    assert e.hours == pytest.approx(15.3, abs=0.1) and e.batteries == 2 and e.with_spare == 3
    assert value(spark, P.site_energy(5.0, 72.0)).energy_wh == pytest.approx(108)
    d = value(spark, P.drone_endurance(370.0))
    assert (d.minutes, d.packs) == (118, 37)
    assert [value(spark, P.panel_size_w(float(w))) for w in (0, 15, 51, 399, 401)] == [0, 20, 100, 400, 500]


def test_capacity(spark):
    assert value(spark, P.erlang_b(F.lit(1), F.lit(1.0))) == pytest.approx(0.5)
    assert value(spark, P.erlang_b(F.lit(0), F.lit(1.0))) == 1
    t = spark.createDataFrame([("a", 2, 2, 2.0, 10.0), ("b", 2, 0, 4.0, 20.0), ("c", 2, 100, 6.0, 30.0), ("d", 2, 2500, 60.0, 60.0)],
                              "team string, timeslots int, users int, calls_per_user_hour double, avg_call_sec double")
    rows = {r.team: r for r in P.capacity_plan(t).collect()}
    assert rows["a"].meets_target and rows["a"].recommendation.startswith("Enough")
    assert rows["b"].recommendation.startswith("Nothing to carry")
    assert not rows["c"].meets_target and rows["c"].needed_slots > 2
    need = rows["d"].needed_slots
    assert value(spark, P.erlang_b(F.lit(need), F.lit(2500.0))) <= 0.02 < value(spark, P.erlang_b(F.lit(need - 1), F.lit(2500.0)))
    few = {r.team: r for r in P.capacity_plan(t, cap=64).collect()}["d"]
    assert few.needed_slots is None and "more than 64 slots" in few.recommendation


def test_roles_without_radios(spark):
    m = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "mission_id long, reach_km double, urban_frac double, ruggedness_m double")
    a = spark.createDataFrame([], "mission_id long, radio_id long, label string, role string, default_freq_mhz double, power_w double")
    rows = R.assign_roles(a, m).collect()
    assert len(rows) == 5 and all(r.radio_label is None and r.why == R.NO_RADIOS for r in rows)


def test_operator_names(spark):
    df = spark.createDataFrame([(204, 8), (204, 99), (None, 1)], "mcc int, net int")
    assert [r.o for r in df.select(T.resolve_operator("mcc", "net").alias("o")).collect()] == ["KPN", "MCC 204 · MNC 99", None]


def test_costed_bom(spark):
    n = spark.createDataFrame([(1, 0, "HQ", 5, "set", 100.0), (1, 1, "Rebro", 5, "set", 100.0), (1, 2, "Op", 6, "other", None)],
                              "mission_id long, node_no int, node_label string, radio_id long, radio_label string, price double")
    lines = spark.createDataFrame([(1, "bank", 3, "x")], "mission_id long, item string, qty long, unit_spec string")
    prices = spark.createDataFrame([("bank", "2.5")], "item string, price string")
    b = P.costed_bom(n, lines, prices)
    rows = {r.item: r for r in b.collect()}
    assert (rows["set"].qty, rows["set"].unit_spec, rows["set"].total) == (2, "HQ · Rebro", 200.0)
    assert rows["other"].total is None and rows["bank"].total == 7.5
    t = P.bom_totals(b).first()
    assert (t.total_known, t.unpriced, t.priced) == (207.5, 1, 2)


def test_roles_are_scored_by_one_formula(spark):
    a = spark.createDataFrame(
        [(1, 1, "a", "manpack", 155.0, 5.0), (1, 2, "b", "hf", 7.0, 200.0), (1, 3, "c", "base", 450.0, 60.0), (1, 4, None, None, None, None), (None, 5, "e", "lora", 868.0, 1.0)],
        "mission_id int, radio_id int, label string, role string, default_freq_mhz double, power_w double",
    )
    m = spark.createDataFrame([(1, 40.0, 0.3, 130.0), (2, 1.0, None, None)], "mission_id int, reach_km double, urban_frac double, ruggedness_m double")
    out = R.assign_roles(a, m)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("-18.0") == 1
    got = {(r.mission_id, r.node): (r.radio_id, r.score, r.alternatives) for r in out.collect()}
    assert got[1, "operator"] == (1, 38.0, "c") and got[1, "hq"] == (3, 62.0, "a")
    assert got[1, "rebro-static"] == (3, 48.0, "a") and got[2, "hq"] == (None, 0.0, "")


def test_arsenal_pairs_are_read_once(spark, tmp_path):
    from rfcover.fixtures import frame

    spark.createDataFrame([(1, 7), (1, 7), (2, 7), (2, 8), (None, 8), (2, None)], "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(7, "x", 3, 9.0), (7, "x", 3, 9.0), (8, "y", 4, 9.0)], "p_partkey long, p_name string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    out = frame(spark, str(tmp_path), "fx_arsenal")
    assert sorted((r.mission_id or 0, r.radio_id) for r in out.collect()) == [(0, 8), (1, 7), (2, 7), (2, 8)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2
