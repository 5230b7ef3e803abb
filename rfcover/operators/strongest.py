"""The strongest sites of every cell where sites differ in power and frequency.

Distance alone does not rank such sites, so nearest-site searches do not serve. Cells and sites
are put into cubes of the unit sphere's surroundings, halved level by level. Groups of cells are
held against groups of sites, both known by their bounds: how strong the group's sites are, how
near and how far two groups can be. A pair of groups that cannot hold one of the ``k`` strongest
sites of any cell is dropped before either group is split (branch and bound). What is left at the
finest level is joined to the cells. The work per cell does not grow with the number of sites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import link as L
from ..functions.geo import EARTH_RADIUS_M, haversine_m
from ..functions.link import LinkParams
from ..functions.numeric import dbl
from .runtime import cut_lineage, spread

_AXES = ("x", "y", "z")
_LEVELS = (4, 7, 9, 11, 12, 13)  # cubes of 2 / 2^level earth radii: 800 km down to 1.6 km, in small steps where cubes are many
_SLACK_DB = 1e-6  # far above the rounding of bounds, far below any level that matters


def _place(df: DataFrame, lat: str, lng: str) -> DataFrame:
    c = F.cos(F.radians(lat))
    parts = (c * F.cos(F.radians(lng)), c * F.sin(F.radians(lng)), F.sin(F.radians(lat)))
    return df.withColumns({a: v for a, v in zip(_AXES, parts)})


def _cube(level: int) -> list[Column]:
    """The cube of a place: whole numbers along the three axes."""
    n = 1 << level
    return [F.least(F.floor((F.col(a) + 1) * (n / 2)), F.lit(n - 1)).cast("int").alias(f"{a}k") for a in _AXES]


def _boxes(rows: DataFrame, on, level: int, extra) -> DataFrame:
    """Groups of a level: their cube, the bounds of their places, and further aggregates."""
    bounds = [f(a).alias(f"{a}{t}") for a in _AXES for f, t in ((F.min, "0"), (F.max, "1"))]
    return rows.groupBy(*on, *_cube(level)).agg(*bounds, *extra)


def _loss(chord2: Column) -> Column:
    """Decibels lost over a distance given by its squared chord on the unit sphere, at least 1 m."""
    half = F.least(F.sqrt(F.greatest(chord2, F.lit(0.0))) / 2, F.lit(1.0))
    return F.log10(F.greatest(F.asin(half) * (2 * EARTH_RADIUS_M), F.lit(1.0))) * 20


def _gap2(q: str, s: str) -> Column:
    """Least squared chord between two boxes."""
    out = F.lit(0.0)
    for a in _AXES:
        gap = F.greatest(F.col(f"{s}{a}0") - F.col(f"{q}{a}1"), F.col(f"{q}{a}0") - F.col(f"{s}{a}1"), F.lit(0.0))
        out = out + gap * gap
    return out


def _span2(q: str, s: str) -> Column:
    """Largest squared chord between two boxes."""
    out = F.lit(0.0)
    for a in _AXES:
        span = F.greatest(F.col(f"{s}{a}1") - F.col(f"{q}{a}0"), F.col(f"{q}{a}1") - F.col(f"{s}{a}0"))
        out = out + span * span
    return F.least(out, F.lit(4.0))


def site_strength(link: LinkParams) -> Column:
    """Level at which a site would be received without any distance: all but the 20 log d term."""
    return dbl(link.eirp_dbm) + float(link.rx_gain_dbi) - F.log10(dbl(link.freq_mhz) * 1e6) * 20 - F.lit(L._FSPL_CONST)


def _pruned(pairs: DataFrame, on: list, k: int | None) -> DataFrame:
    """Drop pairs of groups that cannot matter to any cell of their group."""
    upper = F.col("_max") - _loss(_gap2("q", "s"))
    pairs = pairs.withColumn("_upper", upper).where(F.col("_upper") >= F.col("_least") - _SLACK_DB)
    if not k:
        return pairs
    sure = F.transform("_tops", lambda a: a - _loss(_span2("q", "s")))
    group = [*on, *[f"q{a}k" for a in _AXES]]
    held = [x for x in pairs.columns if x not in group and x not in ("_tops",)]
    rows = pairs.groupBy(*group).agg(F.collect_list(F.struct(*held, "_tops")).alias("_all"), F.flatten(F.collect_list(sure)).alias("_sure"))
    kth = F.get(F.sort_array("_sure", asc=False), F.lit(k - 1))
    rows = rows.withColumn("_kth", F.coalesce(kth, F.lit(-1e9)))
    kept = rows.select(*group, "_kth", F.inline(F.filter("_all", lambda p: p["_upper"] >= rows["_kth"] - _SLACK_DB)))
    return kept.withColumn("_least", F.greatest("_least", "_kth")).drop("_kth")


def strongest_links(
    cells: DataFrame, sites: DataFrame, link: LinkParams, *, k: int | None = 2, on=(), least: str | None = None, alike: int | None = None, same=(), slots: int = 4,
) -> DataFrame:
    """(cell, site) pairs with ``distance_m`` that hold the ``k`` strongest sites of each cell in free space, ties included.

    ``cells`` have lat, lng; ``sites`` site_lat, site_lng and the columns that ``link`` names; ``on``
    names group columns that must be equal. Pairs below the link's floor are left out. ``least``
    names a cell column with a level that a pair must reach, NULL for none; with
    ``k=None`` all pairs that reach it are found. Of sites on one spot that are equally strong and
    agree in the columns ``same``, the ``alike`` lowest site_ids stand for all (``k`` of them if not
    given): ties go to the lower id. Cells of one cube are joined in ``slots`` groups.
    """
    alike = alike or k
    on = list(on)
    keys = [f"{a}k" for a in _AXES]
    floor = float(link.floor_dbm) - _SLACK_DB
    s = _place(sites.withColumn("_a", site_strength(link)).where(F.col("_a").isNotNull() & F.col("site_lat").isNotNull() & F.col("site_lng").isNotNull()), "site_lat", "site_lng")
    if alike:
        spot = Window.partitionBy(*on, "site_lat", "site_lng", "_a", *same).orderBy("site_id")
        s = s.withColumn("_r", F.row_number().over(spot)).where(F.col("_r") <= alike).drop("_r")
    s = cut_lineage(s)
    points = s.select(*on, *_AXES, "_a")
    c = _place(cells.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()), "lat", "lng")
    lowest = F.coalesce(F.col(least), F.lit(floor)) if least else F.lit(floor)
    spots = c.select(*on, *_AXES, lowest.alias("_least"))

    def side(df: DataFrame, tag: str) -> DataFrame:
        names = {x: f"{tag}{x}" for x in [*keys, *[f"{a}{t}" for a in _AXES for t in "01"]]}
        return df.withColumnsRenamed(names)

    top = F.slice(F.sort_array(F.collect_list("_a"), asc=False), 1, k or 1).alias("_tops")
    finest = _boxes(points, on, _LEVELS[-1], [F.max("_a").alias("_max")])
    if k:
        # the k strongest of a cube are cut before they are collected
        w = Window.partitionBy(*on, *keys).orderBy(F.desc("_a"))
        ranked = points.select(*on, *_cube(_LEVELS[-1]), "_a").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
        finest = finest.join(ranked.groupBy(*on, *keys).agg(top), [*on, *keys])
    finest = cut_lineage(finest)
    near = cut_lineage(_boxes(spots, on, _LEVELS[-1], [F.min("_least").alias("_least")]))

    def coarser(df: DataFrame, level: int, extra) -> DataFrame:
        """Groups of a level made of the finest ones."""
        shift = _LEVELS[-1] - level
        up = [F.shiftright(x, shift).alias(x) for x in keys]
        bounds = [f(f"{a}{t}").alias(f"{a}{t}") for a in _AXES for f, t in ((F.min, "0"), (F.max, "1"))]
        return df.groupBy(*on, *up).agg(*bounds, *extra)

    sums = [F.max("_max").alias("_max")]
    if k:
        sums.append(F.slice(F.sort_array(F.flatten(F.collect_list("_tops")), asc=False), 1, k).alias("_tops"))
    pairs = None
    for n, level in enumerate(_LEVELS):
        q = side(coarser(near, level, [F.min("_least").alias("_least")]), "q")
        t = side(coarser(finest, level, sums), "s")
        if pairs is None:
            # bounded by the sphere: some 1,200 cubes of the coarsest level touch it
            both = q.join(t, on) if on else q.crossJoin(t)
        else:
            up = level - _LEVELS[n - 1]
            above = pairs.select(*on, *[F.col(f"q{x}").alias(f"pq{x}") for x in keys], *[F.col(f"s{x}").alias(f"ps{x}") for x in keys])
            q = q.withColumns({f"pq{x}": F.shiftright(f"q{x}", up) for x in keys})
            t = t.withColumns({f"ps{x}": F.shiftright(f"s{x}", up) for x in keys})
            # few bytes that become many pairs: dealt out before they do
            split = spread(above.join(q, [*on, *[f"pq{x}" for x in keys]]), *on, *[f"ps{x}" for x in keys])
            both = split.join(t, [*on, *[f"ps{x}" for x in keys]])
            both = both.drop(*[f"p{z}{x}" for z in "qs" for x in keys])
        pairs = cut_lineage(_pruned(both, on, k))

    found = pairs.select(*on, *[F.col(f"q{x}").alias(f"_q{x}") for x in keys], *[f"s{x}" for x in keys], "_least", *[f"q{a}{t}" for a in _AXES for t in "01"])
    placed = s.select("*", *[v.alias(f"s{a}k") for a, v in zip(_AXES, _cube(_LEVELS[-1]))])
    placed = placed.withColumns({f"s{a}{t}": F.col(a) for a in _AXES for t in "01"}).drop(*_AXES)
    wide = found.join(placed, [*on, *[f"s{x}" for x in keys]])
    upper = F.col("_a") - _loss(_gap2("q", "s"))
    wide = wide.where(upper >= F.col("_least") - _SLACK_DB)
    if k:
        # once more with single sites: what the k-th of them is sure to give in the whole cube of cells
        sure = F.col("_a") - _loss(_span2("q", "s"))
        w = Window.partitionBy(*on, *[f"_q{x}" for x in keys]).orderBy(F.desc("_sure")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        wide = wide.withColumn("_upper", upper).withColumn("_sure", sure).withColumn("_kth", F.nth_value("_sure", k).over(w))
        wide = wide.where(F.col("_upper") >= F.coalesce("_kth", F.lit(-1e9)) - _SLACK_DB).drop("_upper", "_sure", "_kth")
    wide = wide.drop("_least", *[f"{p}{a}{t}" for p in "qs" for a in _AXES for t in "01"], *[f"s{x}" for x in keys])
    wide = wide.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    lhs = c.withColumns({f"_q{a}k": v for a, v in zip(_AXES, _cube(_LEVELS[-1]))}).drop(*_AXES)
    if least:
        lhs = lhs.withColumn("_want", F.col(least))
    lhs = lhs.withColumn("_slot", F.pmod(F.xxhash64(*cells.columns), F.lit(slots)).cast("int"))
    by = [*on, *[f"_q{x}" for x in keys], "_slot"]
    out = spread(lhs, *by).join(wide, by).withColumn("distance_m", haversine_m("site_lat", "site_lng", "lat", "lng"))
    level = F.col("_a") - F.log10(F.greatest("distance_m", F.lit(1.0))) * 20
    out = out.where(level >= floor)
    if least:
        out = out.where(F.col("_want").isNull() | (level >= F.col("_want") - _SLACK_DB)).drop("_want")
    return out.drop("_a", *by[len(on):])
