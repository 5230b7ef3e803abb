"""Links over terrain: what is shuffled, and what repeated cells give."""

from pyspark.sql import functions as F

from rfcover.functions.link import LinkParams
from rfcover.operators import coverage as C
from rfcover.operators.raster import Raster


def hills(spark):
    pixels = spark.range(20 * 20).select((F.col("id") % 20).cast("int").alias("x"), F.floor(F.col("id") / 20).cast("int").alias("y"), (F.col("id") * 37 % 90).cast("double").alias("z"))
    return Raster.from_pixels(pixels, "z", west=0.0, origin_lat=0.0, step_x=0.01, step_y=0.01, cols=20, rows=20, size=8)


def test_terrain_links_stay_in_their_tasks(spark):
    cells = spark.range(40).select(F.col("id").alias("cell_id"), (F.col("id") * 0.004).alias("lat"), (F.col("id") * 7 % 40 * 0.004).alias("lng"))
    cells = cells.unionByName(cells.where("cell_id < 3"))
    sites = spark.createDataFrame([(1, 0.05, 0.05, 10.0), (2, 0.12, 0.1, 30.0), (3, 0.05, 0.05, 20.0)], "site_id long, lat double, lng double, tx_height_m double")
    link = LinkParams(20.0, 3500.0)
    links = C.score_links(cells, sites, link, elevation=hills(spark))
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(cell_id" not in plan
    assert not {"_tx", "_ty", "_slot"} & set(links.columns)
    got = {(r.cell_id, r.site_id): r for r in links.collect()}
    assert len(got) == links.count() == 120  # repeated cells give one link
    best = {(r.cell_id, r.site_id): r for r in C.score_links(cells, sites, link, elevation=hills(spark), nearest=2).collect()}
    assert all(abs(got[k].dbm - r.dbm) < 1e-9 for k, r in best.items())
