"""Path analysis: profiles, diffraction, Fresnel clearance, mast heights, envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import link as L
from ..functions.geo import haversine_m
from ..functions.link import LinkParams
from ..functions.numeric import clamp, col, dbl, round_half_up
from .runtime import spread


def _along(a: str, b: str) -> Column:
    return F.col(a) + (F.col(b) - F.col(a)) * F.col("f")


def link_profiles(
    links: DataFrame,
    *,
    kind: str = "coverage",
    start=("site_lat", "site_lng"),
    end=("lat", "lng"),
    distance: str = "distance_m",
    step_m: float | None = None,
) -> DataFrame:
    """Sample positions along every link: columns i, n, f, d1, p_lat, p_lng.

    ``coverage``: about 2 km apart, 8..40 parts, interior samples only; links of
    50 m or less keep one row with NULL position. ``p1812``: about 1 km apart,
    10..60 parts, both ends. ``envelope``: about 1.5 km apart, interior only.
    """
    step, lo, hi = {
        "coverage": (2000.0, 8.0, 40.0), "p1812": (1000.0, 10.0, 60.0), "envelope": (1500.0, 8.0, 40.0)
    }[kind]
    d = F.col(distance)
    n = clamp(round_half_up(d / F.lit(step_m or step)), F.lit(lo), F.lit(hi)).cast("int")
    links = links.withColumn("n", n)
    if kind == "p1812":
        samples = F.sequence(F.lit(0), F.col("n"))
    else:
        samples = F.sequence(F.lit(1), F.col("n") - 1)
    if kind == "coverage":
        samples = F.when(d > 50, samples).otherwise(F.array(F.lit(None).cast("int")))
    out = links.withColumn("i", F.explode(samples)).withColumn("f", F.col("i") / F.col("n"))
    return (
        out.withColumn("d1", F.col("f") * d)
        .withColumn("p_lat", _along(start[0], end[0]))
        .withColumn("p_lng", _along(start[1], end[1]))
    )


def diffraction_db(
    links: DataFrame,
    elevation,
    link: LinkParams,
    *,
    bulge: bool = True,
    by=("cell_id", "site_id"),
    on=(),
    tx_height: str = "tx_height_m",
    dealt=(),
) -> DataFrame:
    """Loss over the worst single edge of each link, added as ``diffraction_db``.

    Links carry ``tx_ground_m`` and ``rx_ground_m``. Samples are spread over the
    raster's blocks and come back as one maximum per link, so only partial maxima are
    shuffled the second time. ``dealt`` names columns by which the links are spread over the
    tasks already: they then stay where they are, unless the raster is too large to be sent.
    """
    by = [*on, *dealt, *by]
    keep = [c for c in links.columns if c not in by]
    # By cell: the maximum per link and the best server per cell reuse this partitioning.
    links = links if dealt else spread(links, *by[:-1])
    p = elevation.sample(link_profiles(links), "terrain_m", lng="p_lng", lat="p_lat")
    d2 = F.col("distance_m") - F.col("d1")
    tx = F.col("tx_ground_m") + F.col(tx_height)
    rx = F.col("rx_ground_m") + F.lit(float(link.rx_height_m))
    ground = F.col("terrain_m") + (L.earth_bulge_m("d1", d2) if bulge else F.lit(0.0))
    above = ground - (tx + (rx - tx) * F.col("f"))
    v = F.when(F.col("i").isNotNull(), L.fresnel_v(above, F.col("d1"), d2, link.freq_mhz))
    return (
        p.groupBy(*by)
        .agg(*[F.first(c).alias(c) for c in keep], F.max(v).alias("_v"))
        .withColumn("diffraction_db", L.knife_edge_db("_v"))
        .drop("_v", *dealt)
    )


# ---- single paths -------------------------------------------------------------------


def path_profiles(pairs: DataFrame, elevation, steps: int = 100, by=("pair_id",)) -> DataFrame:
    """Evenly spaced ground heights, both ends: pair columns plus i, f, d1, elev_m.

    Pairs hold a_lat, a_lng, b_lat, b_lng.
    """
    n = max(2, round(steps))
    p = (
        spread(pairs, *by).withColumn("distance_m", haversine_m("a_lat", "a_lng", "b_lat", "b_lng"))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .withColumn("f", F.col("i") / F.lit(float(n - 1)))
        .withColumn("d1", F.col("distance_m") * F.col("f"))
        .withColumn("p_lat", _along("a_lat", "b_lat"))
        .withColumn("p_lng", _along("a_lng", "b_lng"))
    )
    return elevation.sample(p, "elev_m", lng="p_lng", lat="p_lat")


def with_end_heights(profiles: DataFrame, by=("pair_id",)) -> DataFrame:
    """Add the ground heights of both ends (a_ground_m, b_ground_m) to every sample."""
    ends = profiles.groupBy(*by).agg(
        F.min_by("elev_m", "i").alias("a_ground_m"), F.max_by("elev_m", "i").alias("b_ground_m")
    )
    return profiles.join(ends, list(by))


def clearance_m(tx_tip: Column, rx_tip: Column, ground: Column, freq_mhz, fraction=0.6) -> Column:
    """Gap between the ground and the protected part of the first Fresnel zone."""
    d2 = F.col("distance_m") - F.col("d1")
    los = tx_tip + (rx_tip - tx_tip) * F.col("d1") / F.when(
        F.col("distance_m") != 0, F.col("distance_m")
    ).otherwise(F.lit(1.0))
    return los - L.fresnel_radius_m(F.col("d1"), d2, freq_mhz) * fraction - ground


def fresnel_clearance(
    profiles: DataFrame, freq_mhz, tx_height_m, rx_height_m, by=("pair_id",)
) -> DataFrame:
    """Worst clearance per path, its sample (first on ties) and whether it is blocked."""
    p = with_end_heights(profiles, by)
    gap = clearance_m(
        F.col("a_ground_m") + dbl(tx_height_m), F.col("b_ground_m") + dbl(rx_height_m),
        F.col("elev_m"), freq_mhz,
    )
    out = p.groupBy(*by).agg(F.min(F.struct(gap.alias("gap"), F.col("i").alias("i"))).alias("w"))
    return out.select(
        *by,
        F.col("w.gap").alias("min_clearance_m"),
        F.col("w.i").alias("min_clearance_i"),
        (F.col("w.gap") < 0).alias("obstructed"),
    )


def path_diffraction_db(
    profiles: DataFrame, freq_mhz, tx_height_m, rx_height_m, by=("pair_id",), bulge: bool = False
) -> DataFrame:
    """Knife-edge loss per path over its own samples (no bulge in the path tool)."""
    p = with_end_heights(profiles, by)
    d2 = F.col("distance_m") - F.col("d1")
    tx, rx = F.col("a_ground_m") + dbl(tx_height_m), F.col("b_ground_m") + dbl(rx_height_m)
    ground = F.col("elev_m") + (L.earth_bulge_m("d1", d2) if bulge else F.lit(0.0))
    inner = (F.col("d1") > 0) & (d2 > 0)
    v = F.when(
        inner, L.fresnel_v(ground - (tx + (rx - tx) * F.col("f")), F.col("d1"), d2, freq_mhz)
    )
    return p.groupBy(*by).agg(
        F.first("distance_m").alias("distance_m"), L.knife_edge_db(F.max(v)).alias("diffraction_db")
    )


def link_budget(
    paths: DataFrame, eirp_dbm, freq_mhz, rx_threshold_dbm, diffraction: str = "diffraction_db"
) -> DataFrame:
    """Free-space loss, level, margin and viability of each path."""
    level = dbl(eirp_dbm) - F.col("fspl_db") - F.col(diffraction)
    return (
        paths.withColumn("fspl_db", L.fspl_db("distance_m", freq_mhz))
        .withColumn("rx_dbm", level)
        .withColumn("margin_db", F.col("rx_dbm") - dbl(rx_threshold_dbm))
        .withColumn("viable", F.col("margin_db") >= 0)
    )


def min_mast_height(
    pairs: DataFrame, elevation, freq_mhz, *, clutter=None, rx_height_m: float = 1.5,
    fraction: float = 0.6, min_m: float = 2.0, max_m: float = 30.0, steps: int = 120,
    by=("pair_id",),
) -> DataFrame:
    """Lowest mast at the start that keeps the Fresnel fraction clear on each path.

    The needed tip height has a closed form per sample, so one maximum answers it; a
    second pass gives the margins at the height chosen. Above ``max_m`` the path is
    ``limited`` and the worst sample at the capped mast is named as the obstacle.
    """
    n = max(8, round(steps))
    by = list(by)
    p = path_profiles(pairs, elevation, n, by)
    if clutter is not None:
        p = clutter.sample(p, "_clutter", lng="p_lng", lat="p_lat", method="nearest")
    else:
        p = p.withColumn("_clutter", F.lit(0.0))
    inner = (F.col("i") > 0) & (F.col("i") < n - 1)
    p = with_end_heights(p, by).withColumn(
        "clutter_m", F.when(inner, F.greatest(F.col("_clutter"), F.lit(0.0))).otherwise(F.lit(0.0))
    )
    d2 = F.col("distance_m") - F.col("d1")
    p = p.withColumn("ground_m", F.col("elev_m") + L.earth_bulge_m("d1", d2) + F.col("clutter_m"))
    rx_tip = F.col("b_ground_m") + float(rx_height_m)
    r1 = L.fresnel_radius_m(F.col("d1"), d2, freq_mhz)
    tip = (F.col("ground_m") + r1 * fraction - rx_tip * F.col("f")) / F.nullif(
        1 - F.col("f"), F.lit(0.0)
    )
    base = F.col("a_ground_m") + float(min_m)
    needs = p.groupBy(*by).agg(
        F.max(F.when(inner & (tip > base), F.struct(tip.alias("tip"), (-F.col("i")).alias("i")))).alias("w"),
        F.first("a_ground_m").alias("_a"),
    )
    needed = F.coalesce(F.col("w.tip"), F.col("_a") + float(min_m)) - F.col("_a")
    needs = (
        needs.withColumn(
            "required_m", F.greatest(F.lit(float(min_m)), F.ceil(needed * 10) / 10)
        )
        .withColumn("limited", F.col("required_m") > float(max_m))
        .withColumn("height_m", F.when(F.col("limited"), float(max_m)).otherwise(F.col("required_m")))
        .select(*by, "required_m", "limited", "height_m", (-F.col("w.i")).alias("_worst_i"))
    )
    m = p.join(needs, by)
    gap = clearance_m(F.col("a_ground_m") + F.col("height_m"), rx_tip, F.col("ground_m"), freq_mhz, fraction)
    spot = F.struct("i", "d1", "elev_m", "clutter_m")
    out = m.groupBy(*by).agg(
        F.first("required_m").alias("required_m"),
        F.first("limited").alias("limited"),
        F.first("height_m").alias("height_m"),
        F.min(F.struct(gap.alias("gap"), spot.alias("at"))).alias("low"),
        F.max(F.when(F.col("i") == F.col("_worst_i"), spot)).alias("worst"),
    )
    obstacle = F.when(F.col("limited"), F.col("low.at")).otherwise(F.col("worst"))
    return out.select(
        *by, "required_m", "limited", "height_m",
        F.col("low.gap").alias("min_clearance_m"),
        obstacle["i"].alias("obstacle_i"),
        obstacle["d1"].alias("obstacle_dist_m"),
        obstacle["elev_m"].alias("obstacle_terrain_m"),
        obstacle["clutter_m"].alias("obstacle_clutter_m"),
    )


def binding_link(links: DataFrame, site: str = "site_id", order: str = "pair_id") -> DataFrame:
    """Per site the link that asks for the tallest mast; the first wins ties."""
    row = F.struct(F.col("required_m"), (-F.col(order)).alias("neg"))
    return links.groupBy(site).agg(
        F.max("required_m").alias("required_m"),
        F.max_by("height_m", row).alias("height_m"),
        F.max_by("limited", row).alias("limited"),
        F.max_by(order, row).alias("binding_link"),
    )


# ---- flight envelope ------------------------------------------------------------------


def flight_envelope(
    cells: DataFrame, stations: DataFrame, elevation, *, eirp_dbm: float, freq_mhz: float,
    rx_sens_dbm: float, station_height_m: float = 10.0, bands=(50.0, 100.0, 120.0),
    by=("station_id", "cell_id"),
) -> DataFrame:
    """Lowest altitude band with a clear sight line, per cell of each station.

    ``band`` is the index of that band, len(bands) for "in range but shadowed" and
    NULL for out of link range. Cells carry their station_id, so this is an equi-join.
    """
    st = stations.select(
        "station_id", F.col("lat").alias("st_lat"), F.col("lng").alias("st_lng")
    )
    st = elevation.sample(st, "st_ground_m", lng="st_lng", lat="st_lat")
    by = list(by)
    c = elevation.sample(cells.select(*by, "lat", "lng"), "ground_m")
    links = c.join(st, "station_id").withColumn(
        "distance_m", haversine_m("st_lat", "st_lng", "lat", "lng")
    )
    level = dbl(eirp_dbm) - L.fspl_db("distance_m", freq_mhz)
    links = links.where((F.col("distance_m") >= 1) & (level >= float(rx_sens_dbm)))
    p = link_profiles(spread(links, *by), kind="envelope", start=("st_lat", "st_lng"))
    p = elevation.sample(p, "terrain_m", lng="p_lng", lat="p_lat")
    d2 = F.col("distance_m") - F.col("d1")
    ground = F.col("terrain_m") + L.earth_bulge_m("d1", d2)
    tip = F.col("st_ground_m") + float(station_height_m)
    clear = [
        F.every(ground <= tip + (F.col("ground_m") + float(b) - tip) * F.col("f")).alias(f"_b{k}")
        for k, b in enumerate(bands)
    ]
    seen = p.groupBy(*by).agg(*clear)
    band = F.coalesce(
        *[F.when(F.col(f"_b{k}"), F.lit(k)) for k in range(len(bands))], F.lit(len(bands))
    )
    return cells.join(seen.select(*by, band.alias("band")), by, "left")
