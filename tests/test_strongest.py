"""The strongest sites of unequal power against all pairs, in free space and over terrain."""

import random

import pytest
from pyspark.sql import functions as F

from rfcover.functions import link as L
from rfcover.functions.geo import haversine_m
from rfcover.functions.link import LinkParams
from rfcover.operators import coverage as C
from rfcover.operators import strongest as S
from rfcover.operators.raster import Raster
from rfcover.operators.strongest import strongest_links

def _link():
    return LinkParams(F.col("eirp_dbm"), F.col("mhz"))


def _place(rng):
    lat = rng.choice([rng.uniform(50, 53), rng.uniform(-90, 90), 89.9, 52 + rng.random() / 100])
    return lat, rng.choice([rng.uniform(3, 6), rng.uniform(-180, 180), 179.99, -179.99, 4 + rng.random() / 100])


def _tables(spark, n, seed=4):
    rng = random.Random(seed)
    sites = [(i, *_place(rng), rng.choice([0.0, 10.0, 20.0, 33.0, 50.0]), rng.choice([150.0, 450.0, 3500.0])) for i in range(n)]
    sites += [(n + i, *sites[i % 2][1:]) for i in range(20)]  # many equal sites on one spot
    cells = [(i, *_place(rng)) for i in range(200)] + [(200, None, 4.0), (201, 52.0, None)]
    return (
        spark.createDataFrame(sites, "site_id long, site_lat double, site_lng double, eirp_dbm double, mhz double"),
        spark.createDataFrame(cells, "cell_id long, lat double, lng double"),
    )


def _by_cell(rows):
    out = {}
    for r in rows:
        out.setdefault(r.cell_id, []).append((-r.dbm, r.site_id))
    return {k: sorted(v) for k, v in out.items()}


def _all(sites, cells):
    d = haversine_m("site_lat", "site_lng", "lat", "lng")
    pairs = cells.crossJoin(sites).withColumn("distance_m", d)
    return pairs.withColumn("dbm", L.received_dbm("distance_m", "eirp_dbm", "mhz")).where("dbm >= -120")


@pytest.mark.parametrize("k", [1, 2])
def test_strongest(spark, k):
    sites, cells = _tables(spark, 100)
    got = strongest_links(cells, sites, _link(), k=k).withColumn("dbm", L.received_dbm("distance_m", "eirp_dbm", "mhz")).collect()
    best, full = _by_cell(got), _by_cell(_all(sites, cells).collect())
    assert set(best) == set(full)
    assert all(best[c][:k] == full[c][:k] for c in full)
    assert len(got) == len({(r.cell_id, r.site_id) for r in got})


def test_all_above_a_level(spark):
    sites, cells = _tables(spark, 60)
    cells = cells.withColumn("want", F.when(F.col("cell_id") % 3 > 0, -95.0 - F.col("cell_id") % 9))
    got = strongest_links(cells, sites, _link(), k=None, least="want").withColumn("dbm", L.received_dbm("distance_m", "eirp_dbm", "mhz")).collect()
    full = _all(sites, cells).where("want IS NULL OR dbm >= want").collect()
    assert _by_cell(got) == _by_cell(full)


def test_links_do_not_grow_with_sites(spark):
    """Spread sites of five powers: four times the sites, about as many links per cell."""
    rng = random.Random(1)
    cells = spark.createDataFrame([(i, rng.uniform(50, 53), rng.uniform(3, 7)) for i in range(400)], "cell_id long, lat double, lng double")
    per_cell = []
    for n in (500, 2000):
        rows = [(i, rng.uniform(50, 53), rng.uniform(3, 7), float(rng.choice([0, 6, 12, 20, 30])), 450.0) for i in range(n)]
        sites = spark.createDataFrame(rows, "site_id long, site_lat double, site_lng double, eirp_dbm double, mhz double")
        per_cell.append(strongest_links(cells, sites, _link(), k=2).count() / 400)
    assert per_cell[1] < 1.5 * per_cell[0] and per_cell[1] < 20


def test_groups_and_empty_tables(spark):
    sites, cells = _tables(spark, 30)
    sites, cells = sites.withColumn("run_id", F.col("site_id") % 2), cells.withColumn("run_id", F.col("cell_id") % 3)
    got = strongest_links(cells, sites, _link(), on=("run_id",)).select("run_id", "cell_id", "site_id").collect()
    assert got and all(r.cell_id % 3 == r.site_id % 2 == r.run_id for r in got)
    assert strongest_links(cells.limit(0), sites, _link(), on=("run_id",)).count() == 0
    assert strongest_links(cells, sites.limit(0), _link(), on=("run_id",)).count() == 0


def test_bounded_over_terrain(spark):
    """The bounded search gives the same two best sites as scoring every link in range."""
    rng = random.Random(7)
    pixels = spark.range(100 * 100).select((F.col("id") % 100).cast("int").alias("x"), (F.col("id") / 100).cast("int").alias("y"))
    pixels = pixels.withColumn("elev_m", ((F.col("x") * 37 + F.col("y") * 91) % 53 * 12).cast("double"))
    terrain = Raster.from_pixels(pixels, "elev_m", west=4.0, origin_lat=51.0, step_x=0.01, step_y=0.01, cols=100, rows=100)
    rows = [(i, rng.uniform(51, 52), rng.uniform(4, 5), float(rng.choice([5, 15, 30])), float(rng.choice([450, 3500])), float(rng.choice([5, 40]))) for i in range(40)]
    rows += [(40 + i, *rows[3][1:]) for i in range(5)]
    sites = spark.createDataFrame(rows, "site_id long, lat double, lng double, eirp_dbm double, mhz double, tx_height_m double")
    cells = spark.createDataFrame([(i, rng.uniform(51, 52), rng.uniform(4, 5), float(i % 4) * 3) for i in range(60)], "cell_id long, lat double, lng double, loss double")
    every = C.best_server(C.score_links(cells, sites, _link(), elevation=terrain, clutter_db="loss", tile_m=50_000.0))
    links = C.score_links(cells, sites, _link(), elevation=terrain, clutter_db="loss", nearest=2)
    got = C.best_server(links)
    assert sorted(got.collect()) == sorted(every.collect())
    assert links.count() < 45 * 60 / 2


def test_groups_meet_few_groups_in_many_tasks(spark, monkeypatch):
    """Of places lying close, cubes meet some of their neighbours, not all children of all neighbours."""
    rng = random.Random(9)

    def places(n, *more):
        return [(i, rng.uniform(51, 51.3), rng.uniform(3, 3.5), *[rng.choice(m) for m in more]) for i in range(n)]

    sites = spark.createDataFrame(places(900, [0.0, 10.0, 20.0], [150.0, 3500.0]), "site_id long, site_lat double, site_lng double, eirp_dbm double, mhz double")
    cells = spark.createDataFrame(places(900), "cell_id long, lat double, lng double")
    seen, plain = [], S._pruned

    def watched(pairs, *rest):
        seen.append((pairs.count(), pairs.rdd.getNumPartitions()))
        return plain(pairs, *rest)

    def best():
        seen.clear()
        rows = strongest_links(cells, sites, _link()).select("cell_id", "site_id").collect()
        return {tuple(r) for r in rows}, sum(n for n, _ in seen)

    monkeypatch.setattr(S, "_pruned", watched)
    found, pairs = best()
    assert min(tasks for _, tasks in seen[1:]) >= 4
    monkeypatch.setattr(S, "_LEVELS", (4, 7, 10, 13))
    same, more = best()
    assert found == same and 2 * pairs < more, (pairs, more)
