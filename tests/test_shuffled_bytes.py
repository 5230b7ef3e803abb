"""What the distance joins and grid runs carry through their shuffles."""

import re

from pyspark.sql import functions as F

from rfcover.functions.link import LinkParams
from rfcover.operators import grid_runs as G
from rfcover.operators.spatial_join import near_pairs, nearest_pairs


def carried(df):
    """The columns made below the exchanges of the executed plan."""
    plan = df._jdf.queryExecution().executedPlan()
    out = []

    def walk(node):
        if "Exchange" in node.nodeName():
            out.append(node.output().mkString(","))
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan.inputPlan())
    return out


def rows(spark):
    left = spark.range(30).select(F.col("id").alias("cell_id"), (50 + F.col("id") * 0.01).alias("lat"), (4 + F.col("id") % 7 * 0.01).alias("lng"))
    right = spark.range(9).select(F.col("id").alias("site_id"), (50 + F.col("id") * 0.04).alias("site_lat"), (4 + F.col("id") % 3 * 0.02).alias("site_lng"))
    return left, right


def test_vectors_are_made_after_the_shuffles(spark):
    left, right = rows(spark)
    for pairs in (near_pairs(left, right, 9000.0), nearest_pairs(left, right, 9000.0, k=2)):
        columns = carried(pairs)
        assert columns and not any(re.search(r"_[uv][xyz]#|_limit#", c) for c in columns)
    brute = left.crossJoin(right).where("abs(lat - site_lat) < 1").select("cell_id", "site_id", "lat", "lng", "site_lat", "site_lng")
    from rfcover.functions.geo import haversine_m

    want = {(r.cell_id, r.site_id) for r in brute.where(haversine_m("lat", "lng", "site_lat", "site_lng") <= 9000).collect()}
    assert {(r.cell_id, r.site_id) for r in near_pairs(left, right, 9000.0).collect()} == want


def test_grid_lists_hold_sites_once_and_no_vectors(spark, monkeypatch):
    written, cut = [], G.cut_lineage

    def noted(df):
        written.append(df)
        return cut(df)

    monkeypatch.setattr(G, "cut_lineage", noted)
    slots, near = [], G.near_pairs
    monkeypatch.setattr(G, "near_pairs", lambda *a, **kw: slots.append(kw.get("salts")) or near(*a, **kw))
    runs = spark.createDataFrame([(1, (4.0, 50.0, 4.3, 50.2))], "run_id long, box struct<west:double,south:double,east:double,north:double>")
    sites = spark.createDataFrame([(i, 50.0 + i * 0.03, 4.0 + i * 0.05) for i in range(6)], "site_id long, lat double, lng double")
    out = G.grid_runs(runs, sites, LinkParams(20.0, 3500.0), max_dim=40)
    near_type = {f.name: f.dataType.simpleString() for f in written[-1].schema.fields}["_near"]
    assert slots == [1] and near_type == "array<struct<site_id:bigint,site_lat:double,site_lng:double>>"
    assert out.where("best_site IS NULL").isEmpty() and out.count() == out.select("cell_id").distinct().count() > 500
