"""Anchors of the terrain path-loss model on synthetic profiles."""

import pytest
from pyspark.sql import functions as F

from rfcover.operators.terrain_loss import inverse_normal, path_loss_p1812


def profile(name, km, n=50, ridge=0.0, tx=30.0, rx=10.0, mhz=600.0, clutter=0.0):
    return [
        (name, i, n, km * 1000.0 * i / n, 100.0 + (ridge if i == n // 2 else 0.0), float(clutter) if i == n else 0.0, mhz, float(tx), float(rx), 50.0)
        for i in range(n + 1)
    ]


def losses(spark, rows, **kw):
    schema = (
        "link_id string, i int, n int, dist_m double, terrain_m double, clutter_m double, freq_mhz double, "
        "tx_height_m double, rx_height_m double, lat_deg double"
    )
    return {r.link_id: r for r in path_loss_p1812(spark.createDataFrame(rows, schema), **kw).collect()}


def test_anchors(spark):
    rows = profile("near", 2, tx=60, rx=60) + profile("far", 40) + profile("low", 20) + profile("high", 20, tx=150)
    rows += profile("ridge", 20, ridge=120) + profile("ridge2", 20, ridge=240) + profile("street", 20, rx=1.5)
    rows += profile("trees", 20, rx=1.5, clutter=20.0) + profile("beyond", 20, mhz=9000.0) + profile("long", 300)
    got = losses(spark, rows)
    assert got["near"].loss_db == pytest.approx(got["near"].fspl_db, abs=3)
    assert got["far"].loss_db > got["low"].loss_db > got["high"].loss_db
    assert got["ridge2"].loss_db > got["ridge"].loss_db > got["low"].loss_db
    assert got["trees"].loss_db > got["street"].loss_db + 5 and got["street"].clutter_rx_db == 0
    assert got["beyond"].loss_db is None
    # Far beyond the horizon scatter bounds the loss.
    assert got["long"].loss_db == pytest.approx(got["long"].troposcatter_db, abs=1)


def test_percentages(spark):
    rows = profile("a", 60)
    half = losses(spark, rows)["a"].loss_db
    assert losses(spark, rows, p=1)["a"].loss_db < half
    assert losses(spark, rows, p_loc=90)["a"].loss_db == pytest.approx(half + 5.5 * 1.2816, abs=0.05)


def test_inverse_normal(spark):
    row = spark.range(1).select(*[inverse_normal(F.lit(v)).alias(k) for k, v in (("a", 0.01), ("b", 0.5), ("c", 0.99))]).first()
    assert row.a == pytest.approx(2.3263, abs=1e-3) and row.b == pytest.approx(0, abs=1e-3) and row.c == pytest.approx(-2.3263, abs=1e-3)
