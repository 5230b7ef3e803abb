"""Cell towers: operators, collapse of sectors, selection, best network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, bbox_area, bbox_contains, haversine_m, in_bbox
from ..functions.numeric import col, round_half_up
from .runtime import cut_lineage, spread
from .spatial_join import HALF_EARTH_M, near_pairs, nearest_pairs

# Radio generations, operator brands, bands, macro-cell defaults.
RADIO_TYPES = ("GSM", "UMTS", "LTE", "NR")
OPERATORS = {
    204: {2: "Odido", 4: "Vodafone", 8: "KPN", 10: "KPN", 12: "KPN", 16: "Odido", 20: "Odido"},
    206: {1: "Proximus", 10: "Orange", 20: "Base"},
    262: {1: "Telekom", 2: "Vodafone", 3: "O2", 4: "Vodafone", 6: "Telekom", 7: "O2", 8: "O2",
          9: "Vodafone", 11: "O2"},
    208: {1: "Orange", 2: "Orange", 10: "SFR", 13: "SFR", 15: "Free", 16: "Free", 20: "Bouygues",
          21: "Bouygues", 88: "Bouygues"},
}
CELL_BANDS = (
    ("n28-700", "5G low (n28)", 700.0), ("b20-800", "LTE B20", 800.0), ("b8-900", "900 (GSM/B8)", 900.0),
    ("b3-1800", "1800 (B3)", 1800.0), ("b1-2100", "2100 (B1)", 2100.0), ("b7-2600", "2600 (B7)", 2600.0),
    ("n78-3500", "5G mid (n78)", 3500.0),
)
DEFAULT_BAND = "b1-2100"
CELL_DEFAULTS = {"eirp_dbm": 30.0, "tx_height_m": 30.0, "rx_height_m": 1.5, "rx_sens_dbm": -110.0}
GENERATION_MHZ = {"GSM": 900.0, "UMTS": 900.0, "LTE": 800.0, "NR": 3500.0}
TYPE_WEIGHT = {"NR": 1.1, "LTE": 1.0, "GSM": 0.7, "UMTS": 0.6}
UNKNOWN_OPERATOR = "Unknown operator"


def resolve_operator(mcc, net) -> Column:
    """Brand of a network code, a numeric label for unknown ones, NULL without a code."""
    mcc, net = col(mcc), col(net)
    brands = F.create_map(
        *[F.lit(v) for m, nets in OPERATORS.items() for n, name in nets.items() for v in (f"{m}-{n}", name)]
    )
    key = F.concat_ws("-", mcc.cast("int").cast("string"), net.cast("int").cast("string"))
    label = F.concat(F.lit("MCC "), mcc.cast("string"), F.lit(" · MNC "), net.cast("string"))
    return F.when(mcc.isNotNull() & net.isNotNull(), F.coalesce(F.element_at(brands, key), label))


def cells_to_towers(cells: DataFrame, order: str = "cell_id", by=()) -> DataFrame:
    """One tower per position (4 decimals), radio and operator; the first cell wins.

    ``order`` is the input sequence. The pick is an aggregate, so sectors of a
    crowded site are combined before the shuffle.
    """
    c = cells.where(
        F.col("radio").isin(*RADIO_TYPES) & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    ).withColumn("operator", resolve_operator("mcc", "net"))
    if "range" not in c.columns:
        c = c.withColumn("range", F.lit(None).cast("double"))
    keys = [*by, round_half_up("lat", 4).alias("_la"), round_half_up("lon", 4).alias("_lo"), "radio", "operator"]
    first = F.min_by(F.struct(order, "lat", "lon", "range"), order).alias("t")
    return c.groupBy(*keys).agg(first).select(*by, "t.*", "radio", "operator")


def select_towers(
    towers: DataFrame, requests: DataFrame, max_n: int | None = None, order: str = "cell_id"
) -> DataFrame:
    """Per request: towers of its radio inside its box, nearest to its centre first.

    Requests: request_id, radio (NULL takes all), box (NULL takes all), center_lat,
    center_lng (NULL keeps the input order). Nearness is in squared degrees. ``max_n``
    keeps so many per request.
    """
    t = towers.select(
        F.col(order), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"),
        F.col("radio").alias("t_radio"), "operator",
    )
    inside = (F.col("radio").isNull() | (F.col("radio") == F.col("t_radio"))) & (
        F.col("box").isNull() | in_bbox(F.col("box"), "t_lon", "t_lat")
    )
    dx, dy = F.col("t_lon") - F.col("center_lng"), F.col("t_lat") - F.col("center_lat")
    j = _box_join(t, requests).where(inside).withColumn("d2", dx * dx + dy * dy)
    if max_n:
        w = Window.partitionBy("request_id").orderBy(F.asc_nulls_last("d2"), order)
        j = j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_n)
    return j.select("request_id", order, "t_lat", "t_lon", "t_radio", "operator", "d2")


def _box_join(points: DataFrame, requests: DataFrame, tile_deg: float = 0.5) -> DataFrame:
    """Points (t_lat, t_lon) with every request whose box touches their tile.

    Requests without a box take part in every tile that holds points.
    """
    tx, ty = F.floor(F.col("t_lon") / tile_deg), F.floor(F.col("t_lat") / tile_deg)
    p = points.withColumn("_tx", tx).withColumn("_ty", ty)

    def span(lo, hi):
        return F.explode(F.sequence(F.floor(F.col(lo) / tile_deg), F.floor(F.col(hi) / tile_deg)))

    boxed = (
        requests.where(F.col("box").isNotNull())
        .withColumn("_tx", span("box.west", "box.east"))
        .withColumn("_ty", span("box.south", "box.north"))
    )
    used = p.select("_tx", "_ty").distinct()
    everywhere = requests.where(F.col("box").isNull()).join(used, F.lit(True))
    return p.join(boxed.unionByName(everywhere), ["_tx", "_ty"]).drop("_tx", "_ty")


def _point_blocks(points: DataFrame, least: int, levels: int = 16) -> DataFrame:
    """Points with ``_b``, the number of the finest tile (halved from 45 degrees) around them that holds ``least`` points or more."""
    edge = 45.0 / 2 ** (levels - 1)
    fine = {"_fx": F.floor(F.col("lng") / edge), "_fy": F.floor(F.col("lat") / edge)}
    points = points.withColumns(fine)
    up = F.pow(F.lit(2.0), levels - 1 - F.col("_lv"))
    tiles = points.groupBy(*fine).agg(F.count(F.lit(1)).alias("_n")).withColumn("_lv", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    tiles = tiles.withColumns({"_x": F.floor(F.col("_fx") / up), "_y": F.floor(F.col("_fy") / up)})
    full = tiles.groupBy("_lv", "_x", "_y").agg(F.sum("_n").alias("_n")).where((F.col("_n") >= least) | (F.col("_lv") == 0))
    finest = F.max(F.struct("_lv", "_x", "_y")).alias("_t")
    best = tiles.drop("_n").join(full.hint("merge"), ["_lv", "_x", "_y"]).groupBy(*fine).agg(finest)
    return points.join(best.hint("merge"), [*fine]).withColumn("_b", F.xxhash64("_t")).drop("_t", *fine)


def best_network(points: DataFrame, towers: DataFrame, order: str = "cell_id", *, block: int = 32) -> DataFrame:
    """Operators ranked per point by distance over technology weight.

    The winner of an operator is among the nearest towers of each of its radio types, so one
    nearest tower per (operator, radio) is looked up for the centre of each block of some
    ``block`` points or more. With d its distance, w its weight and rho that of the block's farthest
    point, no point of the block scores worse than (d + rho) / w, which bounds how far from the
    centre a better tower can be. The operator's few towers within that meet the block's points.
    """
    name = F.coalesce(F.nullif(F.trim("operator"), F.lit("")), F.lit(UNKNOWN_OPERATOR))
    t = towers.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        F.col(order).alias("site_id"), F.col("lat").alias("site_lat"), F.col("lon").alias("site_lng"),
        name.alias("operator"), "radio",
    )
    t = cut_lineage(t)
    p = points.select("point_id", "lat", "lng").where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    p = cut_lineage(_point_blocks(p, block))

    def weight(radio: Column) -> Column:
        out = F.lit(TYPE_WEIGHT["LTE"])
        for kind, w in TYPE_WEIGHT.items():
            out = F.when(radio == kind, w).otherwise(out)
        return out

    centre = p.groupBy("_b").agg(((F.min("lat") + F.max("lat")) / 2).alias("_lat"), ((F.min("lng") + F.max("lng")) / 2).alias("_lng"))
    # a crowd on one spot is dealt out over slots
    blocks = cut_lineage(p.join(centre.hint("merge"), "_b").groupBy("_b", "_lat", "_lng").agg(
        F.max(haversine_m("_lat", "_lng", "lat", "lng")).alias("_rho"), F.ceil(F.count(F.lit(1)) / 1024).alias("_slots")
    ).withColumnsRenamed({"_lat": "lat", "_lng": "lng"}))
    groups = t.select("operator", "radio").distinct()
    # One probe per network: the networks are as many as there are brands and types.
    probes = blocks.join(groups.agg(F.collect_list(F.struct("operator", "radio")).alias("g")), F.lit(True))
    probes = probes.select("_b", "lat", "lng", "_rho", F.inline("g"))
    # blocks are no crowd: one slot, so towers are copied to tiles alone
    near = nearest_pairs(probes, t, HALF_EARTH_M, k=1, on=("operator", "radio"), levels=13, salts=1)
    near = near.groupBy("_b", "operator", "radio").agg(*[F.min(c).alias(c) for c in ("lat", "lng", "_rho", "distance_m")])
    w = weight(F.col("radio"))
    worst = F.min((F.col("distance_m") + F.col("_rho")) / w).over(Window.partitionBy("_b", "operator"))
    # of distances in metres, a millimetre is far above the rounding
    far = F.least((w * worst + F.col("_rho")) * 1.0000001 + 1e-3, F.lit(HALF_EARTH_M))
    near = cut_lineage(near.withColumn("_far", far).where(F.col("distance_m") <= F.col("_far")).drop("distance_m", "_rho"))
    usual = near.agg(F.percentile_approx("_far", 0.5).alias("m")).first().m
    # of an operator's towers of one type on one spot the lowest id wins
    spots = t.groupBy("operator", "radio", "site_lat", "site_lng").agg(F.min(F.struct("site_id")).alias("s")).select("*", "s.site_id").drop("s")
    found = near_pairs(
        spots, near, "_far", left_pos=("site_lat", "site_lng"), right_pos=("lat", "lng"), on=("operator", "radio"),
        tile_m=max(usual or 0.0, 500.0), salts=1, distance="_d",
    )
    # Equal scores keep the order in which the operators first appear.
    first = t.groupBy("operator").agg(F.min("site_id").alias("first_id"))
    lists = found.groupBy("_b", "operator").agg(F.collect_list(F.struct("site_id", "site_lat", "site_lng", "radio", w.alias("w"), F.cos(F.radians("site_lat")).alias("c"))).alias("_near"))
    slots = blocks.select("_b", "_slots")
    lists = lists.join(first, "operator").join(slots.hint("merge"), "_b")
    lists = lists.withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_slots") - 1))).drop("_slots")
    dealt = p.join(slots.hint("merge"), "_b").withColumn("_slot", F.pmod(F.xxhash64("point_id", "lat", "lng"), F.col("_slots")))
    met = spread(dealt.drop("_slots"), "_b", "_slot").join(lists.hint("merge"), ["_b", "_slot"])

    def scored(x: Column) -> Column:
        # the formula of haversine_m, with what hangs on one end alone worked out before
        up, across = F.sin(F.radians(F.col("lat") - x["site_lat"]) / 2), F.sin(F.radians(F.col("lng") - x["site_lng"]) / 2)
        h = up * up + x["c"] * F.col("_c") * (across * across)
        d = F.asin(F.least(F.lit(1.0), F.sqrt(h))) * (2 * EARTH_RADIUS_M)
        return F.struct((d / x["w"]).alias("score"), x["site_id"].alias("site_id"), x["radio"].alias("radio"), x["site_lat"].alias("lat"), x["site_lng"].alias("lng"))

    met = met.withColumn("_c", F.cos(F.radians("lat"))).withColumn("_t", F.array_min(F.transform("_near", scored)))
    met = met.withColumn("distance_m", haversine_m("_t.lat", "_t.lng", "lat", "lng"))
    b = F.struct((F.col("distance_m") / weight(F.col("_t.radio"))).alias("score"), "_t.site_id", "_t.radio", "distance_m")
    met = met.select("point_id", "operator", "first_id", b.alias("b"))
    # rows of one point come together once, for a repeated point_id and for the ranks
    best = spread(met, "point_id").groupBy("point_id", "operator").agg(F.min("b").alias("b"), F.min("first_id").alias("first_id"))
    ranks = Window.partitionBy("point_id").orderBy("b.score", "first_id")
    return best.select(
        "point_id", "operator", F.col("b.radio").alias("radio"), F.col("b.distance_m").alias("distance_m"),
        F.col("b.score").alias("score"), F.row_number().over(ranks).alias("rank"),
    )


def band_preset(key) -> Column:
    """STRUCT<key,label,freq_mhz>; unknown keys give the default band."""

    def make(row):
        return F.struct(F.lit(row[0]).alias("key"), F.lit(row[1]).alias("label"), F.lit(row[2]).alias("freq_mhz"))

    out = make(next(b for b in CELL_BANDS if b[0] == DEFAULT_BAND))
    for row in CELL_BANDS:
        out = F.when(col(key) == row[0], make(row)).otherwise(out)
    return out


def tower_counts(towers: DataFrame) -> DataFrame:
    """Towers per radio type, and in total (radio NULL)."""
    return towers.rollup("radio").agg(F.count(F.lit(1)).alias("towers"))


def select_snapshot_region(index: DataFrame, requests: DataFrame) -> DataFrame:
    """Smallest region that holds each requested box; no region gives no row.

    ``index`` is (region, file, box, ordinal); ``requests`` is (request_id, box). The
    index has one row per region file.
    """
    i = index.select("region", "file", F.col("box").alias("r_box"), "ordinal")
    hit = requests.join(i, bbox_contains(F.col("r_box"), F.col("box")))
    pick = F.min(F.struct(bbox_area(F.col("r_box")).alias("area"), "ordinal", "region", "file")).alias("p")
    return hit.groupBy("request_id").agg(pick).select("request_id", "p.region", "p.file", "p.area")


def resolve_towers(requests: DataFrame, snapshot: DataFrame, osm: DataFrame) -> DataFrame:
    """Snapshot rows of the requests a snapshot answers, else the map-data rows.

    Both carry request_id; the source is kept with its attribution.
    """
    s = snapshot.join(requests, "request_id", "left_semi").withColumn("source", F.lit("opencellid"))
    missing = requests.join(snapshot.select("request_id").distinct(), "request_id", "left_anti")
    o = osm.join(missing, "request_id", "left_semi").withColumn("source", F.lit("osm"))
    attribution = F.when(
        F.col("source") == "osm", "© OpenStreetMap contributors (ODbL) · Overpass API"
    ).otherwise("Cell data © OpenCelliD contributors (CC BY-SA 4.0)")
    return s.unionByName(o, allowMissingColumns=True).withColumn("attribution", attribution)
