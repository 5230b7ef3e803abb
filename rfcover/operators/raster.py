"""Sampling of pixel tables: elevation, land cover, canopy height.

A pixel table is (x, y, value). For sampling it is packed into square blocks, one
array of values per row with a one-pixel rim, so that a sample needs one block and
no second aggregation: point -> block is an equi-join, and the corner values are
read from the array by position.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import tile_xy
from ..functions.numeric import clamp, col, round_half_up

# Land-cover classes, their map colour, extra loss (dB), height (m).
LAND_COVER = (
    (10, (0, 100, 0), 12.0, 20.0),
    (20, (255, 187, 34), 6.0, 4.0),
    (30, (255, 255, 76), 2.0, 1.0),
    (40, (240, 150, 255), 3.0, 2.0),
    (50, (250, 0, 0), 10.0, 8.0),
    (60, (180, 180, 180), 0.0, 0.0),
    (70, (240, 240, 240), 0.0, 0.0),
    (80, (0, 100, 200), 0.0, 0.0),
    (90, (0, 150, 160), 4.0, 2.0),
    (95, (0, 207, 117), 14.0, 15.0),
    (100, (250, 230, 160), 1.0, 0.5),
)


def decode_elevation(red="r", green="g", blue="b") -> Column:
    """Metres from an RGB-coded elevation pixel."""
    return col(red) * 256.0 + col(green) + col(blue) / 256.0 - 32768.0


def classify_land_cover(red="r", green="g", blue="b", alpha="a") -> Column:
    """Class whose map colour is nearest; the first wins; transparent gives 0."""
    r, g, b = col(red), col(green), col(blue)
    scored = F.array(
        *[
            F.struct(
                ((r - c[0]) * (r - c[0]) + (g - c[1]) * (g - c[1]) + (b - c[2]) * (b - c[2])).alias("d"),
                F.lit(i).alias("i"),
                F.lit(cls).alias("cls"),
            )
            for i, (cls, c, _, _) in enumerate(LAND_COVER)
        ]
    )
    return F.when(col(alpha) == 0, F.lit(0)).otherwise(F.array_min(scored)["cls"])


def _class_lookup(cls, pos: int) -> Column:
    out = F.lit(0.0)
    for row in LAND_COVER:
        out = F.when(col(cls) == row[0], F.lit(row[pos])).otherwise(out)
    return out


def clutter_height_m(cls) -> Column:
    return _class_lookup(cls, 3)


def clutter_class_db(cls) -> Column:
    return _class_lookup(cls, 2)


def clutter_height_db(height_m) -> Column:
    """Loss for a bare clutter height when no class is known."""
    h = col(height_m)
    return F.when(h > 0, F.least(F.lit(14.0), F.log1p(h) * 4.3)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Raster:
    """A packed pixel table with its place on the map.

    ``north_up``: row 0 is the northern edge; else the southern one.
    """

    blocks: DataFrame
    west: float
    origin_lat: float
    step_x: float
    step_y: float
    cols: int
    rows: int
    size: int
    north_up: bool = False
    neutral: float | None = 0.0

    @classmethod
    def from_pixels(
        cls, pixels: DataFrame, value: str, *, west: float, origin_lat: float, step_x: float,
        step_y: float, cols: int, rows: int, size: int = 64, north_up: bool = False,
        nodata: float | None = None, neutral: float | None = 0.0,
    ) -> "Raster":
        """Pack (x, y, value). A pixel goes to its block and to the rim of the block
        before it; positions without a pixel hold NULL."""
        v = F.col(value).cast("double")
        v = F.when(~F.isnan(v), v)
        if nodata is not None:
            v = F.nullif(v, F.lit(float(nodata)))

        def homes(axis: str) -> Column:
            own = F.floor(F.col(axis) / size)
            rim = (F.col(axis) % size == 0) & (F.col(axis) > 0)
            return F.explode(F.when(rim, F.array(own, own - 1)).otherwise(F.array(own)))

        side = size + 1
        placed = (
            pixels.select("x", "y", v.alias("v"))
            .withColumn("bx", homes("x"))
            .withColumn("by", homes("y"))
            .withColumn("i", (F.col("y") - F.col("by") * size) * side + F.col("x") - F.col("bx") * size)
            .select("bx", "by", F.col("i").cast("int").alias("i"), "v")
        )
        slots = placed.select("bx", "by").distinct().withColumn(
            "i", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1)))
        )
        filled = slots.unionByName(placed, allowMissingColumns=True).groupBy("bx", "by", "i").agg(
            F.max("v").alias("v")
        )
        blocks = filled.groupBy("bx", "by").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("px")
        )
        return cls(blocks, west, origin_lat, step_x, step_y, cols, rows, size, north_up, neutral)

    def with_neutral(self, neutral: float | None) -> "Raster":
        return replace(self, neutral=neutral)

    def _index(self, lng: Column, lat: Column) -> tuple[Column, Column]:
        fx = (lng - self.west) / F.lit(self.step_x)
        dy = (F.lit(self.origin_lat) - lat) if self.north_up else (lat - self.origin_lat)
        return fx, dy / F.lit(self.step_y)

    def sample(
        self, points: DataFrame, out: str, *, lng="lng", lat="lat", method: str = "grid"
    ) -> DataFrame:
        """Add column ``out`` to every point.

        ``grid``: bilinear between pixel centres, missing corners take the mean of
        those present, outside or all missing gives ``neutral``.
        ``nearest``: the pixel around the position, clamped to the edge inside.
        ``corner``: bilinear between pixel corners as in map tiles, indices clamped.
        """
        lng, lat = col(lng), col(lat)
        fx, fy = self._index(lng, lat)
        last_x, last_y = F.lit(self.cols - 1.0), F.lit(self.rows - 1.0)
        zero = F.lit(0.0)
        if method != "corner":
            fx, fy = fx - 0.5, fy - 0.5
            inside = (
                (fx >= -0.5) & (fy >= -0.5) & (fx <= self.cols - 0.5) & (fy <= self.rows - 0.5)
            )
        else:
            inside = F.lit(True)
        if method == "nearest":
            x0, y0 = (round_half_up(clamp(f, zero, m)) for f, m in ((fx, last_x), (fy, last_y)))
        else:
            x0, y0 = (clamp(F.floor(f).cast("double"), zero, m) for f, m in ((fx, last_x), (fy, last_y)))
        x0, y0 = x0.cast("int"), y0.cast("int")
        placed = (
            points.withColumn("_fx", fx)
            .withColumn("_fy", fy)
            .withColumn("_in", inside)
            .withColumn("_x0", x0)
            .withColumn("_y0", y0)
            .withColumn("bx", F.when(F.col("_in"), F.floor(F.col("_x0") / self.size)))
            .withColumn("by", F.when(F.col("_in"), F.floor(F.col("_y0") / self.size)))
        )
        joined = placed.join(self.blocks, ["bx", "by"], "left")
        side = self.size + 1
        base = (
            (F.col("_y0") - F.col("by") * self.size) * side + F.col("_x0") - F.col("bx") * self.size + 1
        ).cast("int")

        def corner(dx: Column, dy: Column) -> Column:
            return F.get(F.col("px"), base - 1 + dx + dy * side)

        if method == "nearest":
            value = corner(F.lit(0), F.lit(0))
        else:
            step_x = F.when(F.col("_x0") < self.cols - 1, 1).otherwise(0)
            step_y = F.when(F.col("_y0") < self.rows - 1, 1).otherwise(0)
            if method == "corner":
                # Left of or above the first pixel both corners clamp to it.
                step_x = F.when(F.col("_fx") >= 0, step_x).otherwise(0)
                step_y = F.when(F.col("_fy") >= 0, step_y).otherwise(0)
                dx, dy = F.col("_fx") - F.floor("_fx"), F.col("_fy") - F.floor("_fy")
            else:
                dx = clamp(F.col("_fx") - F.col("_x0"), zero, F.lit(1.0))
                dy = clamp(F.col("_fy") - F.col("_y0"), zero, F.lit(1.0))
            c = [corner(F.lit(0), F.lit(0)), corner(step_x, F.lit(0)),
                 corner(F.lit(0), step_y), corner(step_x, step_y)]
            joined = (
                joined.withColumn("_c", F.array(*c)).withColumn("_dx", dx).withColumn("_dy", dy)
            )
            present = F.filter("_c", lambda v: v.isNotNull())
            mean = F.aggregate(present, zero, lambda a, v: a + v) / F.nullif(
                F.size(present), F.lit(0)
            )
            # The usual case, four present corners, stays free of array functions.
            gap = (
                F.col("_c")[0].isNull() | F.col("_c")[1].isNull()
                | F.col("_c")[2].isNull() | F.col("_c")[3].isNull()
            )
            fill = F.when(gap, mean)
            v = [F.coalesce(F.col("_c")[i], fill) for i in range(4)]
            dx, dy = F.col("_dx"), F.col("_dy")
            value = (
                v[0] * (1 - dx) * (1 - dy) + v[1] * dx * (1 - dy)
                + v[2] * (1 - dx) * dy + v[3] * dx * dy
            )
        neutral = F.lit(self.neutral).cast("double")
        joined = joined.withColumn(out, F.coalesce(value, neutral))
        return joined.drop("bx", "by", "px", "_fx", "_fy", "_in", "_x0", "_y0", "_c", "_dx", "_dy")


def sample_tiles(
    points: DataFrame, pixels: DataFrame, z: int, out: str = "elev_m", *, tile_px: int = 256
) -> DataFrame:
    """Bilinear sample of map-tile pixels (z, px, py, value) at zoom ``z``.

    Pixel indices are clamped to the pixels present at that zoom; a missing pixel
    adds nothing (0 m). One row per corner is joined and the weights are summed. Equal
    positions are sampled once and joined back, so repeated points all stay and a crowded
    spot costs four pixel rows.
    """
    at = tile_xy("lng", "lat", F.lit(z))
    level = pixels.where(F.col("z") == z)
    box = level.agg(
        F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1")
    )
    spots = points.select("lng", "lat").distinct()
    fx, fy = at["x"] * tile_px, at["y"] * tile_px
    dx, dy = fx - F.floor(fx), fy - F.floor(fy)
    corners = F.array(
        *[
            F.struct(
                (F.floor(fx) + i).alias("px"),
                (F.floor(fy) + j).alias("py"),
                ((dx if i else 1 - dx) * (dy if j else 1 - dy)).alias("w"),
            )
            for j in (0, 1)
            for i in (0, 1)
        ]
    )
    rows = spots.select("lng", "lat", F.explode(corners).alias("c")).join(F.broadcast(box))
    rows = rows.select(
        "lng",
        "lat",
        F.least(F.greatest("c.px", "x0"), "x1").alias("px"),
        F.least(F.greatest("c.py", "y0"), "y1").alias("py"),
        F.col("c.w").alias("w"),
    )
    got = rows.join(level.select("px", "py", "value"), ["px", "py"], "left")
    sampled = got.groupBy(F.col("lng").alias("_lng"), F.col("lat").alias("_lat")).agg(
        F.sum(F.col("w") * F.coalesce("value", F.lit(0.0))).alias(out)
    )
    same = points["lng"].eqNullSafe(sampled["_lng"]) & points["lat"].eqNullSafe(sampled["_lat"])
    return points.join(sampled, same, "left").drop("_lng", "_lat")


def sample_elevation(points: DataFrame, rasters, out: str = "elev_m") -> DataFrame:
    """Elevation from the first raster that has a value; 0 m where none has."""
    names = []
    for i, raster in enumerate(rasters):
        names.append(f"_e{i}")
        points = raster.with_neutral(None).sample(points, names[-1])
    return points.withColumn(out, F.coalesce(*names, F.lit(0.0))).drop(*names)


def sample_clutter(
    points: DataFrame, heights: Raster | None = None, classes: Raster | None = None
) -> DataFrame:
    """Clutter height (m) and loss (dB): measured heights first, else land cover."""
    if heights is not None:
        points = heights.with_neutral(None).sample(points, "_h", method="nearest")
    else:
        points = points.withColumn("_h", F.lit(None).cast("double"))
    if classes is not None:
        points = classes.with_neutral(None).sample(points, "_cls", method="nearest")
    else:
        points = points.withColumn("_cls", F.lit(None).cast("double"))
    h = F.greatest(F.col("_h"), F.lit(0.0))
    known = F.col("_h").isNotNull()
    return (
        points.withColumn("clutter_m", F.when(known, h).otherwise(clutter_height_m("_cls")))
        .withColumn("clutter_db", F.when(known, clutter_height_db(h)).otherwise(clutter_class_db("_cls")))
        .drop("_h", "_cls")
    )
