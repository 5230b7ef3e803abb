"""Site recommendation: candidates, thinning, coverage matrix, greedy cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import bbox, bbox_diagonal_m, haversine_m, pad_bbox
from .coverage import score_links
from .grids import grid_cells
from .runtime import cut_lineage, spread
from .spatial_join import M_PER_DEG, lng_reach


def _with_dims(boxes: DataFrame, n: int) -> DataFrame:
    return boxes.withColumn("cols", F.lit(n)).withColumn("rows", F.lit(n))


def local_maxima(grid: DataFrame, by: str, dim: int, value: str = "elev_m") -> DataFrame:
    """Interior cells at least as high as their eight neighbours."""
    if dim <= 256:
        # a run's cells lie together once, for both windows
        grid = spread(grid, by)
    across, down = Window.partitionBy(by, "row").orderBy("col"), Window.partitionBy(by, "col").orderBy("row")

    def three(c, w):
        return F.greatest(F.lag(c).over(w), F.col(c), F.lead(c).over(w))

    g = grid.withColumn("_r", three(value, across)).withColumn("_m", three("_r", down))
    inner = F.col("row").between(1, dim - 2) & F.col("col").between(1, dim - 2)
    return g.where(inner & (F.col(value) >= F.col("_m"))).drop("_r", "_m")


def _around(rows: DataFrame, edge: str, reach: str) -> DataFrame:
    """``rows`` once for every tile within ``reach`` metres of them; ``edge`` is the tile's height in degrees."""
    lat, lng, far = F.col("lat"), F.col("lng"), F.col(reach) / M_PER_DEG * 1.000001 + 1e-9
    rows = rows.withColumn("_ty", F.explode(F.sequence(F.floor((lat - far) / F.col(edge)), F.floor((lat + far) / F.col(edge)))))
    wide = F.col(edge) / _band_cos(edge)
    span = lng_reach(lat, F.col(reach))
    return rows.withColumn("_tx", F.explode(F.sequence(F.floor((lng - span) / wide), F.floor((lng + span) / wide))))


def _band_cos(edge: str) -> Column:
    """Cosine of the latitude at which a band of tiles is widest, so that tiles of a band are about as wide as high."""
    low = F.least(F.abs(F.col("_ty") * F.col(edge)), F.abs((F.col("_ty") + 1) * F.col(edge)))
    return F.greatest(F.cos(F.radians(F.least(low, F.lit(89.0)))), F.lit(0.01))


def thin_by_distance(points: DataFrame, by: str = "run_id", height: str = "elev_m", order=("row", "col")) -> DataFrame:
    """Keep points by falling height unless one kept before is nearer than ``min_sep_m``.

    Equal heights go in ``order``. Rounds: a point with no higher undecided point in
    range is kept, its lower neighbours drop out; until all are decided. Tiles are so
    small that two points of one are in range, so only the highest undecided point of a
    tile can be kept in a round; these few are held against the tiles around them. Pairs
    are never stored, and a point meets some tens of others a round however dense they lie.
    """
    p = points.withColumn("_id", F.struct((-F.col(height)).alias("h"), *order))
    nodes = p.select(by, "_id", "lat", "lng", "min_sep_m")
    # Rows without a place or a separation have no neighbours to look for.
    least = F.greatest(F.min("min_sep_m"), F.max("min_sep_m") / 8)
    sep = nodes.groupBy(by).agg(
        F.greatest(least / M_PER_DEG / 2**0.5 * 0.999, F.lit(1e-4)).alias("_edge"), F.max("min_sep_m").alias("_reach")
    )
    tiled = nodes.join(sep.hint("merge"), by).withColumn("_ty", F.floor(F.col("lat") / F.col("_edge")))
    tiled = tiled.withColumn("_tx", F.floor(F.col("lng") / (F.col("_edge") / _band_cos("_edge"))))
    tiled = cut_lineage(tiled)
    place = F.col("_tx").isNotNull() & F.col("_ty").isNotNull()
    open_ = tiled.where(place)
    kept = cut_lineage(tiled.where(~place).select(by, "_id").distinct())
    # An id may come with several places: it is kept if all of them are free, dropped if one is hit.
    while not open_.isEmpty():
        first = open_.groupBy(by, "_ty", "_tx").agg(F.min("_id").alias("_id")).select(by, "_id").distinct()
        top = open_.join(first.hint("merge"), [by, "_id"], "left_semi").drop("_ty", "_tx")
        copies = _around(top, "_edge", "_reach").select(
            by, "_ty", "_tx", F.col("_id").alias("_lo"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), F.col("min_sep_m").alias("_sep")
        )
        blocked = (
            open_.join(copies.hint("merge"), [by, "_ty", "_tx"])
            .where((F.col("_id") < F.col("_lo")) & (haversine_m("lat", "lng", "_lat", "_lng") < F.col("_sep")))
            .select(by, F.col("_lo").alias("_id")).distinct()
        )
        wins = cut_lineage(first.join(blocked.hint("merge"), [by, "_id"], "left_anti"))
        kept = kept.unionByName(wins)
        won = _around(open_.join(wins.hint("merge"), [by, "_id"], "left_semi").drop("_ty", "_tx"), "_edge", "_reach").select(
            by, "_ty", "_tx", F.col("_id").alias("_hi"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng")
        )
        hit = (
            open_.join(won.hint("merge"), [by, "_ty", "_tx"])
            .where((F.col("_hi") < F.col("_id")) & (haversine_m("_lat", "_lng", "lat", "lng") < F.col("min_sep_m")))
            .select(by, "_id").distinct()
        )
        open_ = cut_lineage(open_.join(wins.hint("merge"), [by, "_id"], "left_anti").join(hit.hint("merge"), [by, "_id"], "left_anti"))
    return p.join(kept.hint("merge"), [by, "_id"], "left_semi").drop("_id")


def candidate_sites(runs: DataFrame, elevation=None, *, dim: int = 64, top: int | None = None, by: str = "run_id") -> DataFrame:
    """Candidate masts of each run: high ground of the padded box, and its centre.

    Runs: run_id, box, center_lat, center_lng. ``candidate`` numbers them in the order
    of preference; the centre comes last. Without terrain: a 5 x 5 grid and the centre.
    """
    padded = runs.withColumn("box", pad_bbox(F.col("box"), 0.1))
    centre = runs.select(by, F.col("center_lat").alias("lat"), F.col("center_lng").alias("lng"))
    if elevation is None:
        grid = grid_cells(_with_dims(padded, 5)).select(by, "lat", "lng", "row", "col")
        spots = grid.select(by, (F.col("row") * 5 + F.col("col")).alias("candidate"), "lat", "lng", F.lit(0.0).alias("elev_m"))
        last = centre.select(by, F.lit(25).alias("candidate"), "lat", "lng", F.lit(0.0).alias("elev_m"))
        return spots.withColumn("label", F.lit("Site")).unionByName(last.withColumn("label", F.lit("Centre")))
    grid = grid_cells(_with_dims(padded.withColumn("min_sep_m", bbox_diagonal_m(F.col("box")) / 12), dim))
    grid = elevation.sample(grid.select(by, "row", "col", "lat", "lng", "min_sep_m"), "elev_m")
    spots = thin_by_distance(local_maxima(grid, by, dim), by)
    w = Window.partitionBy(by).orderBy(F.desc("elev_m"), "row", "col")
    spots = spots.withColumn("candidate", F.row_number().over(w) - 1)
    if top:
        spots = spots.where(F.col("candidate") < top)
    spots = spots.select(by, "candidate", "lat", "lng", "elev_m", F.lit("High ground").alias("label"))
    n = spots.groupBy(by).agg(F.count(F.lit(1)).cast("int").alias("candidate"))
    last = elevation.sample(centre, "elev_m").join(n.hint("merge"), by, "left").withColumn("candidate", F.coalesce("candidate", F.lit(0)))
    return spots.unionByName(last.select(by, "candidate", "lat", "lng", "elev_m", F.lit("Centre").alias("label")))


def coverage_matrix(
    candidates: DataFrame, demand: DataFrame, link, *, by: str = "run_id", elevation=None, tx_height_m: float = 10.0,
    clutter_db: str | None = None, tile_m: float | None = None,
) -> DataFrame:
    """(run, candidate, demand_id) of every pair with a usable level (class 0..2)."""
    sites = candidates.select(by, F.col("candidate").alias("site_id"), "lat", "lng", F.lit(float(tx_height_m)).alias("tx_height_m"))
    cells = demand.withColumnRenamed("demand_id", "cell_id")
    links = score_links(cells, sites, link, elevation=elevation, clutter_db=clutter_db, on=(by,), tile_m=tile_m)
    # Class 0..2 is one comparison: class bounds fall, and all lie above the floor.
    return links.where(F.col("dbm") >= max(link.thresholds["marginal"], link.floor_dbm)).select(by, F.col("site_id").alias("candidate"), F.col("cell_id").alias("demand_id"))


def greedy_max_cover(
    matrix: DataFrame, demand: DataFrame, *, locked: DataFrame | None = None, max_sites: int = 3,
    target: float = 0.95, min_gain: float = 0.02, by: str = "run_id",
) -> DataFrame:
    """Pick, per run, the candidate that adds most demand, up to ``max_sites`` times.

    A run stops at the target share, or when the best pick adds less than ``min_gain``
    of its demand. ``locked`` (run, demand_id) is covered from the start. Ties go to
    the lower candidate. All runs advance together; each round is one aggregate and an
    anti-join, and nothing but the picks (one row per run) is kept aside. Joins are by merge:
    Spark sizes what grids, pairs and rounds make like the few rows they come from, and would
    send covered demand and candidates whole to the driver.
    """
    total = demand.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    left = matrix.select(by, "candidate", "demand_id")
    if locked is not None:
        done = locked.select(by, "demand_id").distinct()
        left = left.join(done.hint("merge"), [by, "demand_id"], "left_anti")
        base = done.join(demand.hint("merge"), [by, "demand_id"], "left_semi").groupBy(by).agg(F.count(F.lit(1)).alias("covered"))
        state = total.join(base.hint("merge"), by, "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    else:
        state = total.withColumn("covered", F.lit(0).cast("bigint"))
    left, state = cut_lineage(left), cut_lineage(state)
    picks = None
    for k in range(max_sites):
        gains = left.groupBy(by, "candidate").agg(F.count(F.lit(1)).alias("gain"))
        best = gains.groupBy(by).agg(F.max(F.struct("gain", (-F.col("candidate")).alias("neg"))).alias("b"))
        won = (
            best.join(state.hint("merge"), by)
            .where((F.col("covered") < F.col("n") * target) & (F.col("b.gain") >= F.col("n") * min_gain))
            .select(by, (-F.col("b.neg")).alias("candidate"), F.col("b.gain").alias("gain"), "n",
                    (F.col("covered") + F.col("b.gain")).alias("covered"))
        )
        won = cut_lineage(won)
        row = won.select(
            by, F.lit(k + 1).alias("pick"), "candidate", (F.col("gain") / F.col("n")).alias("newly_covered"),
            (F.col("covered") / F.col("n")).alias("cumulative_frac"),
        )
        picks = row if picks is None else picks.unionByName(row)
        if k + 1 == max_sites or won.isEmpty():
            break
        fresh = left.join(won.select(by, "candidate").hint("merge"), [by, "candidate"], "left_semi").select(by, "demand_id")
        # Runs without a pick are finished and drop out.
        left = cut_lineage(
            left.join(won.select(by).hint("merge"), by, "left_semi").join(fresh.hint("merge"), [by, "demand_id"], "left_anti")
        )
        state = won.select(by, "n", "covered")
    return picks


def combined_plan(locked: DataFrame, picked: DataFrame, runs: DataFrame, by: str = "run_id"):
    """(sites, boxes): fixed and picked masts together, and the compute box of each
    run: its own box stretched over the masts and padded by 12 percent."""
    a = locked.select(by, F.lit(0).alias("kind"), F.col("ordinal"), "lat", "lng", F.col("name"))
    b = picked.select(by, F.lit(1).alias("kind"), F.col("pick").alias("ordinal"), "lat", "lng", F.lit(None).cast("string").alias("name"))
    w = Window.partitionBy(by).orderBy("kind", "ordinal")
    label = F.when(F.col("kind") == 1, F.concat(F.lit("Mast "), F.col("ordinal"))).otherwise(
        F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("Locked "), F.col("ordinal")))
    )
    sites = a.unionByName(b).select(by, (F.row_number().over(w) - 1).alias("site_id"), "lat", "lng", label.alias("name"))
    reach = sites.groupBy(by).agg(
        F.min("lng").alias("w"), F.min("lat").alias("s"), F.max("lng").alias("e"), F.max("lat").alias("n")
    )
    box = F.col("box")
    west, south = F.least(box["west"], "w"), F.least(box["south"], "s")
    east, north = F.greatest(box["east"], "e"), F.greatest(box["north"], "n")
    px = F.when(east > west, (east - west) * 0.12).otherwise(0.01)
    py = F.when(north > south, (north - south) * 0.12).otherwise(0.01)
    boxes = runs.join(reach.hint("merge"), by, "left").select(by, bbox(west - px, south - py, east + px, north + py).alias("box"))
    return sites, boxes
