"""The tile joins against brute force over all pairs."""

import math
import random

from pyspark.sql import functions as F

from rfcover.operators.recommend import greedy_max_cover, thin_by_distance
from rfcover.operators.spatial_join import near_pairs, nearest_pairs

R = 6371008.8


def hav(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * R * math.asin(min(1, math.sqrt(h)))


def clouds(seed):
    """Points with a crowd in one spot, copies, and both sides of the date line."""
    rnd = random.Random(seed)
    pts = [(rnd.uniform(50, 53), rnd.uniform(3, 7)) for _ in range(60)]
    pts += [(52 + rnd.uniform(0, 0.01), 5 + rnd.uniform(0, 0.01)) for _ in range(40)]
    pts += [(52.005, 5.005)] * 10
    pts += [(10 + rnd.uniform(-1, 1), rnd.choice([-180, 180 - 1e-9]) * (1 - rnd.uniform(0, 0.004))) for _ in range(20)]
    return pts


def frames(spark, left, right):
    a = spark.createDataFrame([(i, *p) for i, p in enumerate(left)], "cell_id long, lat double, lng double")
    b = spark.createDataFrame([(i, *p) for i, p in enumerate(right)], "site_id long, site_lat double, site_lng double")
    return a, b


def test_near_pairs_equals_all_pairs(spark):
    left, right = clouds(1), clouds(2)
    a, b = frames(spark, left, right)
    for radius in (900.0, 40_000.0, 400_000.0):
        got = {(r.cell_id, r.site_id) for r in near_pairs(a, b, radius).collect()}
        want = {(i, j) for i, p in enumerate(left) for j, q in enumerate(right) if hav(p, q) <= radius}
        assert got == want


def test_nearest_pairs_hold_the_nearest(spark):
    left, right = clouds(3), clouds(4)
    a, b = frames(spark, left, right)
    for radius in (30_000.0, 300_000.0, math.pi * R):
        got = {}
        for r in nearest_pairs(a, b, radius, k=2).collect():
            got.setdefault(r.cell_id, []).append((r.distance_m, r.site_id))
        for i, p in enumerate(left):
            want = sorted((hav(p, q), j) for j, q in enumerate(right))
            want = [w for w in want if w[0] <= radius][:2]
            have = sorted(got.get(i, []))[:2]
            assert [round(d, 3) for d, _ in have] == [round(d, 3) for d, _ in want]


def test_thinning_equals_the_sequential_rule(spark):
    rnd = random.Random(5)
    pts = [(i, rnd.uniform(50, 51), rnd.uniform(3, 4), float(rnd.randint(0, 9))) for i in range(120)]
    df = spark.createDataFrame(
        [("a", *p, 15_000.0, 0) for p in pts], "run_id string, col int, lat double, lng double, elev_m double, min_sep_m double, row int"
    )
    kept = []
    for p in sorted(pts, key=lambda p: (-p[3], p[0])):
        if all(hav(p[1:3], q[1:3]) >= 15_000 for q in kept):
            kept.append(p)
    assert {r.col for r in thin_by_distance(df).collect()} == {p[0] for p in kept}


def test_greedy_cover_equals_the_sequential_rule(spark):
    rnd = random.Random(6)
    rows = [(run, c, d) for run in ("x", "y") for c in range(8) for d in range(50) if rnd.random() < 0.25]
    demand = [(run, d) for run in ("x", "y") for d in range(50)]
    m = spark.createDataFrame(rows, "run_id string, candidate int, demand_id int")
    dem = spark.createDataFrame(demand, "run_id string, demand_id int")
    locked = spark.createDataFrame([("x", d) for d in range(10)], "run_id string, demand_id int")
    got = {(r.run_id, r.pick): (r.candidate, round(r.cumulative_frac, 6)) for r in greedy_max_cover(m, dem, locked=locked).collect()}
    want = {}
    for run in ("x", "y"):
        covered = set(range(10)) if run == "x" else set()
        for pick in range(1, 4):
            if len(covered) >= 0.95 * 50:
                break
            gains = [(len({d for r, c, d in rows if r == run and c == k} - covered), -k) for k in range(8)]
            gain, neg = max(gains)
            if gain < 0.02 * 50 or gain == 0:
                break
            covered |= {d for r, c, d in rows if r == run and c == -neg}
            want[(run, pick)] = (-neg, round(len(covered) / 50, 6))
    assert got == want


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_for_tiles_are_not_broadcast(spark):
    cells = spark.createDataFrame([(i, 50.0 + i / 50, 4.0) for i in range(30)], "cell_id int, lat double, lng double")
    sites = spark.createDataFrame([(i, 50.3, 4.0 + i / 50) for i in range(30)], "site_id int, site_lat double, site_lng double")
    assert "BroadcastHashJoin" not in _plan(near_pairs(cells, sites, 20_000.0))
    near = _plan(nearest_pairs(cells, sites, 20_000.0))
    assert near.count("SortMergeJoin") >= 2


def test_thinning_stores_no_pairs_of_a_crowd(spark, monkeypatch):
    from rfcover.operators import recommend

    sizes, cut = [], recommend.cut_lineage

    def counted(df):
        out = cut(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(recommend, "cut_lineage", counted)
    df = spark.range(300).select(
        F.lit("a").alias("run_id"), F.col("id").cast("int").alias("col"), (50 + F.col("id") / 1e5).alias("lat"), F.lit(4.0).alias("lng"),
        F.lit(1.0).alias("elev_m"), F.lit(15_000.0).alias("min_sep_m"), F.lit(0).alias("row"),
    )
    assert [r.col for r in thin_by_distance(df).collect()] == [0]
    assert max(sizes) <= 300


def test_thinning_of_repeated_ids_places_and_unequal_separations(spark):
    rnd = random.Random(8)
    pts = [(i % 90, rnd.uniform(-0.5, 0.5), rnd.uniform(3, 4), 1.0, rnd.choice([3_000.0, 15_000.0, 30_000.0])) for i in range(100)]
    pts += [(200, None, 3.5, 1.0, 15_000.0)]
    df = spark.createDataFrame(
        [("a", *p, 0) for p in pts], "run_id string, col int, lat double, lng double, elev_m double, min_sep_m double, row int"
    )
    kept = {200}
    for i in range(90):
        own = [p for p in pts if p[0] == i]
        high = [q for q in pts if q[0] < i and q[0] in kept]
        if all(hav(p[1:3], q[1:3]) >= p[4] for p in own for q in high):
            kept.add(i)
    assert {r.col for r in thin_by_distance(df).collect()} == kept


def test_cover_and_plan_send_nothing_to_the_driver(spark, monkeypatch):
    from rfcover.operators import recommend

    plans, cut = [], recommend.cut_lineage

    def seen(df):
        plans.append(_plan(df))
        return cut(df)

    monkeypatch.setattr(recommend, "cut_lineage", seen)
    m = spark.createDataFrame([(1, c, d) for c in range(4) for d in range(c, 20, 3)], "run_id int, candidate int, demand_id int")
    dem = spark.createDataFrame([(1, d) for d in range(20)], "run_id int, demand_id int")
    locked = spark.createDataFrame([(1, 0)], "run_id int, demand_id int")
    recommend.greedy_max_cover(m, dem, locked=locked)
    site = spark.createDataFrame([(1, 1, 50.0, 4.0, "a")], "run_id int, ordinal int, lat double, lng double, name string")
    runs = spark.createDataFrame([(1, (3.0, 49.0, 5.0, 51.0))], "run_id int, box struct<west: double, south: double, east: double, north: double>")
    plans.append(_plan(recommend.combined_plan(site, site.withColumnRenamed("ordinal", "pick"), runs)[1]))
    assert len(plans) > 5 and not any("BroadcastHashJoin" in p for p in plans)


def test_best_network_looks_towers_up_once_per_block(spark, monkeypatch):
    from rfcover.operators import towers as T

    rnd = random.Random(11)
    points = [(i, rnd.uniform(50, 51), rnd.uniform(3, 4)) for i in range(300)]
    kinds = [(o, k) for o in ("A", " ", None, "B") for k in ("GSM", "UMTS", "LTE", "NR")]
    masts = [(i, rnd.uniform(49.5, 51.5), rnd.uniform(2.5, 4.5), *rnd.choice(kinds)) for i in range(200)]
    masts += [(300 + i, *masts[i][1:]) for i in range(20)]
    looked, nearest = [], T.nearest_pairs

    def counted(left, *args, **kw):
        looked.append(left.count())
        return nearest(left, *args, **kw)

    monkeypatch.setattr(T, "nearest_pairs", counted)
    p = spark.createDataFrame([*points, points[0], (points[1][0], 50.2, 3.3), (None, 50.5, 3.5)], "point_id int, lat double, lng double")
    t = spark.createDataFrame(masts, "cell_id int, lat double, lon double, operator string, radio string")
    got = {(r.point_id, r.operator): (r["rank"], r.radio, round(r.score, 3), round(r.distance_m, 3)) for r in T.best_network(p, t).collect()}
    assert looked[0] < 300 * 12 / 4
    places = {}
    for r in p.collect():
        places.setdefault(r.point_id, []).append((r.lat, r.lng))
    want = {}
    for point, at in places.items():
        best = {}
        for c, la, lo, op, radio in masts:
            op = (op or "").strip() or T.UNKNOWN_OPERATOR
            for x in at:
                d = hav((la, lo), x)
                best[op] = min(best.get(op, (1e18,)), (d / T.TYPE_WEIGHT[radio], c, radio, d))
        for n, op in enumerate(sorted(best, key=lambda o: best[o][0]), 1):
            s, _, radio, d = best[op]
            want[(point, op)] = (n, radio, round(s, 3), round(d, 3))
    assert got == want


def test_grids_are_spread_by_bands_of_rows(spark, monkeypatch):
    from rfcover.operators import grids

    sent, spread = [], grids.spread

    def counted(df, *keys):
        sent.append(df.count())
        return spread(df, *keys)

    monkeypatch.setattr(grids, "spread", counted)
    boxes = spark.createDataFrame(
        [(1, (3.0, 50.0, 4.0, 51.0), 3, 200), (2, (3.0, 50.0, 4.0, 51.0), 2, 1), (3, (3.0, 50.0, 4.0, 51.0), 1, 64)],
        "box_id int, box struct<west: double, south: double, east: double, north: double>, cols int, rows int",
    )
    got = sorted((r.box_id, r.row, r.col) for r in grids.grid_cells(boxes).collect())
    assert got == sorted((b, y, x) for b, w, h in ((1, 3, 200), (2, 2, 1), (3, 1, 64)) for y in range(h) for x in range(w))
    assert sent == [6]


def test_thinning_sends_nothing_to_the_driver(spark, monkeypatch):
    from rfcover.operators import recommend

    plans, write = [], recommend.cut_lineage

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(recommend, "cut_lineage", noted)
    rows = [("a", i, i % 5, 52.0 + i % 5 * 0.01, 5.0 + i * 0.003, float(i % 3), 900.0) for i in range(40)]
    df = spark.createDataFrame(rows, "run_id string, row int, col int, lat double, lng double, elev_m double, min_sep_m double")
    thin_by_distance(df).collect()
    assert len(plans) >= 4 and not any("Broadcast" in p for p in plans)
