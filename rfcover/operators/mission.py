"""Mission tables: summaries, boxes, demand, metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import bbox_of, haversine_m, ring_area_m2
from .grids import demand_grid, resample_route

ID = "mission_id"


def _union(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def mission_summary(missions: DataFrame, sites: DataFrame, routes: DataFrame, points: DataFrame) -> DataFrame:
    """Counts per mission, its area type, and whether it is empty. A route of one
    vertex does not count as content. Missions: mission_id, aoi (struct or NULL)."""
    parts = _union(
        [f.select(ID, F.lit(k).alias("k")) for k, f in (("s", sites), ("r", routes), ("p", points))]
    )
    n = parts.groupBy(ID).agg(
        *[F.count_if(F.col("k") == k).alias(name) for k, name in (("s", "sites"), ("r", "route"), ("p", "points"))]
    )
    out = missions.select(ID, F.col("aoi.type").alias("aoi_type")).join(n, ID, "left")
    for c in ("sites", "route", "points"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    empty = F.col("aoi_type").isNull() & (F.col("sites") == 0) & (F.col("route") < 2) & (F.col("points") == 0)
    return out.withColumn("is_empty", empty)


def mission_bbox(missions: DataFrame, sites: DataFrame, routes: DataFrame, points: DataFrame) -> DataFrame:
    """Box over area ring, sites, route and points; a mission without any has no row."""
    ring = missions.where(F.col("aoi.ring").isNotNull()).select(ID, F.inline("aoi.ring"))
    at = _union([f.select(ID, "lng", "lat") for f in (ring, sites, routes, points)])
    return at.groupBy(ID).agg(bbox_of().alias("box"))


def demand_points(missions: DataFrame, routes: DataFrame, points: DataFrame, max_dim: int = 28) -> DataFrame:
    """Area grid, route samples and explicit points of each mission, with their source.

    Missions: mission_id, aoi, box (the area's bounds). Duplicates stay.
    """
    grid = demand_grid(missions.where(F.col("aoi").isNotNull() & F.col("box").isNotNull()), box="box", max_dim=max_dim)
    route = resample_route(routes, by=ID)
    return _union(
        [f.select(ID, F.lit(k).alias("source"), "lat", "lng") for k, f in (("aoi", grid), ("route", route), ("point", points))]
    )


def max_distance_km(sites: DataFrame, order: str = "site_id") -> DataFrame:
    """Largest distance between two sites of a mission.

    Every site is compared with the sites that can be an end of the longest span:
    the extreme ones in ``directions`` around the box centre bound it from below, and
    a site farther from the centre than the bound allows to skip is kept.
    """
    centre = sites.groupBy(ID).agg(bbox_of().alias("b")).select(
        ID, ((F.col("b.west") + F.col("b.east")) / 2).alias("c_lng"), ((F.col("b.south") + F.col("b.north")) / 2).alias("c_lat")
    )
    s = sites.select(ID, order, "lat", "lng").join(centre, ID).withColumn(
        "rad", haversine_m("c_lat", "c_lng", "lat", "lng")
    )
    # The site farthest from the centre gives a first span; both ends of a longer one
    # lie at least (span - farthest) from the centre.
    far = s.groupBy(ID).agg(F.max(F.struct("rad", "lat", "lng")).alias("f"))
    s = s.join(far, ID).withColumn("span", haversine_m("f.lat", "f.lng", "lat", "lng"))
    low = s.groupBy(ID).agg(F.max("span").alias("low"))
    ends = s.join(low, ID).where(F.col("rad") >= F.col("low") - F.col("f.rad") - 1e-6)
    a = ends.select(ID, F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"), F.col(order).alias("a_id")).distinct()
    b = ends.select(ID, "lat", "lng", F.col(order).alias("b_id")).distinct()
    d = a.join(b, ID).where(F.col("a_id") <= F.col("b_id"))
    return d.groupBy(ID).agg((F.max(haversine_m("a_lat", "a_lng", "lat", "lng")) / 1000).alias("max_site_distance_km"))


def mission_metrics(missions: DataFrame, sites: DataFrame, routes: DataFrame, points: DataFrame) -> DataFrame:
    """Inputs of the radio mix: area, route length, site span, points.

    Missions: mission_id, aoi (ring as drawn), coverage_frac.
    """
    w = Window.partitionBy(ID).orderBy("seq")
    step = haversine_m(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng"))
    length = routes.select(ID, step.alias("d")).groupBy(ID).agg((F.sum("d") / 1000).alias("route_length_km"))
    count = _union([sites.select(ID), points.select(ID)]).groupBy(ID).agg(F.count(F.lit(1)).alias("point_count"))
    out = missions.select(
        ID, F.coalesce(ring_area_m2("aoi.ring") / 1e6, F.lit(0.0)).alias("aoi_area_km2"),
        F.coalesce("coverage_frac", F.lit(0.0)).alias("coverage_frac"),
    )
    for f in (length, max_distance_km(sites), count):
        out = out.join(f, ID, "left")
    zero = {c: 0.0 for c in ("route_length_km", "max_site_distance_km")}
    return out.fillna({**zero, "point_count": 0})
