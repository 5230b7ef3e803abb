"""Distance joins through map tiles.

Spark has no distance join, so both sides are keyed by square tiles of the
latitude-longitude grid and joined on equal tiles; the exact distance is tested
after. Two forms:

* :func:`near_pairs` finds every pair within a radius.
* :func:`nearest_pairs` finds, for each left row, a candidate set that holds its
  k nearest right rows within a radius. Tile size follows the local density, so a
  crowded area is cut into small tiles and no left row meets the whole crowd.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, haversine_m
from ..functions.numeric import col
from .runtime import spread

M_PER_DEG = EARTH_RADIUS_M * math.pi / 180


def _tile(value: Column, deg: float) -> Column:
    return F.floor(value / F.lit(deg)).cast("bigint")


def _wrap(x: Column, deg: float) -> Column:
    """Tile column modulo the circumference, so 180 E and 180 W are neighbours."""
    return F.pmod(x, F.lit(round(360 / deg)).cast("bigint"))


_AXES = ("x", "y", "z")


def _with_vector(df: DataFrame, prefix: str, lat: Column, lng: Column) -> DataFrame:
    """Add the position as a unit vector, so that pairs are tested without trigonometry."""
    c = F.cos(F.radians(lat))
    parts = (c * F.cos(F.radians(lng)), c * F.sin(F.radians(lng)), F.sin(F.radians(lat)))
    for axis, v in zip(_AXES, parts):
        df = df.withColumn(prefix + axis, v)
    return df


def _chord2_limit(reach_m: Column) -> Column:
    """Square of the chord of a distance, a hair wide: a quick first test of pairs."""
    half = F.sin(F.least(reach_m / F.lit(2 * EARTH_RADIUS_M), F.lit(math.pi / 2)))
    return half * half * (4 * (1 + 1e-9)) + 1e-15


def _chord2() -> Column:
    d = [F.col("_u" + a) - F.col("_v" + a) for a in _AXES]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


PAIR_KEYS = ("_tx", "_ty", "_slot")
_VECTOR_COLUMNS = [p + a for p in ("_u", "_v") for a in _AXES]


HALF_EARTH_M = EARTH_RADIUS_M * math.pi  # no two points are farther apart


def _slots(n: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


def _tile_size(radius_m: float) -> float:
    """Divisor of 360 degrees nearest above the radius, at most 45 degrees."""
    want = min(45.0, max(radius_m / M_PER_DEG, 1e-4))
    return 360.0 / max(8, math.floor(360.0 / want))


def lng_reach(lat: Column, radius_m: Column) -> Column:
    """Largest longitude difference (degrees) of two points this close, one at ``lat``."""
    s = F.sin(F.least(radius_m / F.lit(EARTH_RADIUS_M), F.lit(math.pi / 2)))
    c = F.cos(F.radians(lat))
    return F.when(s < c, F.degrees(F.asin(s / c)) * 1.000001 + 1e-9).otherwise(F.lit(180.0))


def _tile_range(center: Column, reach: Column, deg: float, limit: float) -> Column:
    lo = F.greatest(center - reach, F.lit(-limit))
    hi = F.least(center + reach, F.lit(limit))
    return F.sequence(_tile(lo, deg), _tile(hi, deg))


def _lng_tiles(lng: Column, reach: Column, deg: float) -> Column:
    """Wrapped tile columns within reach, each once."""
    raw = F.sequence(_tile(lng - reach, deg), _tile(lng + reach, deg))
    return F.array_distinct(F.transform(raw, lambda x: _wrap(x, deg)))


def near_pairs(
    left: DataFrame,
    right: DataFrame,
    radius_m,
    *,
    left_pos=("lat", "lng"),
    right_pos=("site_lat", "site_lng"),
    on=(),
    tile_m: float | None = None,
    salts: int = 4,
    distance: str = "distance_m",
    keep: bool = False,
) -> DataFrame:
    """All (left, right) pairs at most ``radius_m`` apart, with their distance.

    ``radius_m`` is a number or a column of the right side; with a column give the
    tile edge ``tile_m`` (about the usual radius). ``on`` names group columns that
    must be equal. The right side is copied to the tiles it reaches and to ``salts``
    slots; left rows pick a slot by hash, so one crowded tile still spreads over
    several tasks. Column names of the two sides must differ except for ``on``. ``keep``
    leaves the columns ``PAIR_KEYS``: grouping by them too needs no shuffle of the pairs.
    """
    if isinstance(radius_m, (int, float)):
        tile_m = tile_m or float(radius_m)
    deg = _tile_size(tile_m)
    radius = F.lit(float(radius_m)) if isinstance(radius_m, (int, float)) else col(radius_m)
    la, lo = (F.col(c) for c in left_pos)
    ra, ro = (F.col(c) for c in right_pos)
    reach_lat = radius / F.lit(M_PER_DEG) + 1e-9
    keys = [*on, *PAIR_KEYS]
    lhs = (
        left.withColumn("_tx", _wrap(_tile(lo, deg), deg))
        .withColumn("_ty", _tile(la, deg))
        .withColumn("_slot", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    )
    # Tiles come before the copies; the few right rows are spread first.
    rhs = spread(right, *on, *right_pos).withColumn("_radius", radius)
    radius = F.col("_radius")
    rhs = (
        rhs.withColumn("_ys", _tile_range(ra, reach_lat, deg, 90.0))
        .withColumn("_xs", _lng_tiles(ro, lng_reach(ra, radius), deg))
        .withColumn("_ty", F.explode("_ys"))
        .withColumn("_tx", F.explode("_xs"))
        .withColumn("_slot", F.explode(_slots(salts)))
        .drop("_ys", "_xs")
    )
    # vectors are made after the shuffles, which so carry positions alone
    lhs = _with_vector(spread(lhs, *keys), "_u", la, lo)
    rhs = _with_vector(spread(rhs, *keys), "_v", ra, ro).withColumn("_limit", _chord2_limit(radius))
    # Spark sizes the copies like the rows they come from and would send them whole to the driver.
    pairs = lhs.join(rhs.hint("merge"), keys).where(_chord2() <= F.col("_limit"))
    pairs = pairs.withColumn(distance, haversine_m(ra, ro, la, lo)).where(F.col(distance) <= radius)
    return pairs.drop(*([] if keep else PAIR_KEYS), "_radius", "_limit", *_VECTOR_COLUMNS)


def nearest_pairs(
    left: DataFrame,
    right: DataFrame,
    radius_m: float,
    *,
    k: int = 2,
    left_pos=("lat", "lng"),
    right_pos=("site_lat", "site_lng"),
    right_id: str = "site_id",
    on=(),
    levels: int = 10,
    salts: int = 4,
    distance: str = "distance_m",
) -> DataFrame:
    """Pairs within the radius that hold each left row's k nearest right rows.

    Tiles come in ``levels`` sizes, halving from the radius down. A left row uses the
    finest tile of its own that holds at least k right rows: its k-th nearest is then
    no farther than the tile's diagonal, so right rows within that diagonal suffice.
    Where no tile holds k, the whole radius is searched. Of right rows on one spot
    only the k lowest ids can be among the nearest (ties go to the lower id), so the
    rest drop out first. Left rows of one tile spread over ``salts`` slots. ``on``
    names group columns that must be equal.
    """
    top = _tile_size(radius_m)
    fine = top / 2 ** (levels - 1)
    la, lo = (F.col(c) for c in left_pos)
    ra, ro = (F.col(c) for c in right_pos)
    on = list(on)
    spot = Window.partitionBy(*on, *right_pos).orderBy(right_id)
    right = (
        right.withColumn("_rank", F.row_number().over(spot)).where(F.col("_rank") <= k).drop("_rank")
    )

    # Tile edge per level: exact halves, so a fine tile's ancestors are shifts of it.
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("_lv")
    edge = F.lit(top) / F.pow(F.lit(2.0), F.col("_lv"))
    around = F.pow(F.lit(2.0), F.col("_lv")) * round(360 / top)

    def x_tile(lng: Column) -> Column:
        return F.pmod(F.floor(lng / edge), around).cast("bigint")

    def y_tile(lat: Column) -> Column:
        return F.floor(lat / edge).cast("bigint")

    # Tiles that hold at least k right rows, per level.
    full = (
        right.select(*on, ra.alias("_a"), ro.alias("_o"), level)
        .groupBy(*on, "_lv", x_tile(F.col("_o")).alias("_tx"), y_tile(F.col("_a")).alias("_ty"))
        .count()
        .where(F.col("count") >= k)
        .drop("count")
    )
    # For every finest tile in use on the left: the finest full tile above it.
    fx, fy = _wrap(_tile(lo, fine), fine), _tile(la, fine)
    used = left.select(*on, fx.alias("_fx"), fy.alias("_fy")).distinct()
    up = F.pow(F.lit(2.0), F.lit(levels - 1) - F.col("_lv"))
    choice = (
        used.select(*on, "_fx", "_fy", level)
        .withColumn("_tx", F.floor(F.col("_fx") / up).cast("bigint"))
        .withColumn("_ty", F.floor(F.col("_fy") / up).cast("bigint"))
        .join(full.hint("merge"), [*on, "_lv", "_tx", "_ty"], "left_semi")
        .groupBy(*on, "_fx", "_fy")
        .agg(F.max(F.struct("_lv", "_tx", "_ty")).alias("t"))
    )
    lhs = (
        left.withColumn("_fx", fx)
        .withColumn("_fy", fy)
        .join(choice.hint("merge"), [*on, "_fx", "_fy"], "left")
        .withColumn("_lv", F.coalesce(F.col("t._lv"), F.lit(-1)))
        .withColumn("_tx", F.coalesce(F.col("t._tx"), _wrap(_tile(lo, top), top)))
        .withColumn("_ty", F.coalesce(F.col("t._ty"), _tile(la, top)))
        .withColumn("_slot", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
        .drop("t", "_fx", "_fy")
    )

    # Tiles in use look at every tile within reach of their rows: the tile's diagonal,
    # or the radius where no full tile was found (-1). Right rows sit in one tile per
    # level.
    edge_of = F.when(F.col("_lv") >= 0, edge).otherwise(F.lit(top))
    count_x = F.when(F.col("_lv") >= 0, around).otherwise(F.lit(round(360 / top)))
    diagonal = F.when(F.col("_lv") >= 0, edge).otherwise(F.lit(1e9)) * F.lit(
        M_PER_DEG * math.sqrt(2) * 1.000001
    )
    e = F.col("_edge")
    lat_reach = F.col("_reach") / F.lit(M_PER_DEG) + 1e-9
    high = F.greatest(F.abs(F.col("_ty") * e), F.abs((F.col("_ty") + 1) * e))
    reach_lng = lng_reach(F.least(high, F.lit(90.0)), F.col("_reach"))
    first_x = F.floor(F.col("_tx") - reach_lng / e)
    last_x = F.floor(F.col("_tx") + 1 + reach_lng / e)
    look = (
        lhs.select(*on, "_lv", "_tx", "_ty")
        .distinct()
        .withColumn("_edge", edge_of)
        .withColumn("_around", count_x.cast("bigint"))
        .withColumn("_reach", F.least(diagonal, F.lit(float(radius_m))))
        .withColumn(
            "_ny",
            F.explode(
                F.sequence(
                    F.floor(F.greatest(F.col("_ty") * e - lat_reach, F.lit(-90.0)) / e),
                    F.floor(F.least((F.col("_ty") + 1) * e + lat_reach, F.lit(90.0)) / e),
                )
            ),
        )
        .withColumn("_x", F.explode(F.sequence(first_x, F.least(last_x, first_x + F.col("_around") - 1))))
        .withColumn("_nx", F.pmod("_x", "_around"))
        .select(*on, "_lv", "_tx", "_ty", "_nx", "_ny")
    )
    placed = (
        right.withColumn("_lv", F.explode(F.sequence(F.lit(-1), F.lit(levels - 1))))
        .withColumn("_edge", edge_of)
        .withColumn("_nx", F.pmod(F.floor(ro / e), count_x.cast("bigint")))
        .withColumn("_ny", F.floor(ra / e))
        .drop("_edge")
    )
    rhs = (
        look.join(placed.hint("merge"), [*on, "_lv", "_nx", "_ny"])
        .drop("_nx", "_ny")
        .withColumn("_slot", F.explode(_slots(salts)))
    )
    # Rows beyond the left tile's own reach cannot be among its k nearest.
    reach = F.least(diagonal, F.lit(float(radius_m)))
    lhs = spread(lhs, *on, "_lv", "_tx", "_ty", "_slot")
    lhs = _with_vector(lhs, "_u", la, lo).withColumn("_limit", _chord2_limit(reach))
    # vectors are made after the shuffles, which so carry positions alone
    rhs = _with_vector(spread(rhs, *on, "_lv", "_tx", "_ty", "_slot"), "_v", ra, ro)
    pairs = lhs.join(rhs.hint("merge"), [*on, "_lv", "_tx", "_ty", "_slot"]).where(_chord2() <= F.col("_limit"))
    pairs = pairs.withColumn(distance, haversine_m(ra, ro, la, lo))
    return pairs.where(F.col(distance) <= float(radius_m)).drop(
        "_lv", "_tx", "_ty", "_slot", "_limit", *_VECTOR_COLUMNS
    )
