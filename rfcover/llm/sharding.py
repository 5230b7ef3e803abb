"""Shards of feature records with near-equal bytes, by sampled splitters."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parallel_tasks, stage

OVERHEAD = 16
SAMPLE_PER_RANGE = 64
HEAVY_PARTS = 200


def _splitters(rows: DataFrame, ranges: int, seed: int) -> list[tuple]:
    """Quantiles of a key sample in which a row's chance follows its size.

    The sample has about ``SAMPLE_PER_RANGE`` keys per range, whatever the number of rows.
    """
    total = rows.agg(F.sum("size").alias("t")).first()["t"] or 0
    if not total:
        return []
    rate = ranges * SAMPLE_PER_RANGE / total
    drawn = F.pmod(F.xxhash64("key", "feature_id", "tie", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    keys = rows.where(drawn < F.col("size") * rate).select("key", "feature_id", "tie").collect()
    keys = sorted((k.key, k.feature_id is not None, k.feature_id or 0, k.tie) for k in keys)
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def _range_of(splits: list[tuple]) -> Column:
    """How many splitters lie at or below a row's key."""
    if not splits:
        return F.lit(0)
    own = F.struct(F.col("key").alias("a"), F.col("feature_id").isNotNull().alias("b"), F.coalesce("feature_id", F.lit(0)).alias("c"), F.col("tie").alias("d"))
    rows = ", ".join(f"named_struct('a', {a}L, 'b', {str(b).lower()}, 'c', {c}L, 'd', {d}L)" for a, b, c, d in splits).replace("-9223372036854775808L", "bigint('-9223372036854775808')")
    return F.size(F.filter(F.expr(f"array({rows})"), lambda x: x <= own))


def _deal(heavy: list[tuple[int, int]], total: int, shards: int) -> tuple[list[tuple[int, int]], list[float]]:
    """Deal heavy records, largest first, to the emptiest shard; then, in order of the shards, up
    to where the bytes of all light records fill each of them."""
    loads, dealt, heap = [0] * shards, [], [(0, s) for s in range(shards)]
    for size, tie in sorted(heavy, reverse=True):
        load, s = heapq.heappop(heap)
        dealt.append((tie, s))
        loads[s] = load + size
        heapq.heappush(heap, (load + size, s))
    left, level, order = total - sum(loads), 0.0, sorted(loads)
    for i in range(1, shards + 1):  # the level to which the light bytes raise the i emptiest shards
        level = (left + sum(order[:i])) / i
        if i == shards or level <= order[i]:
            break
    ends, at = [], 0.0
    for load in loads:
        at += max(0.0, level - load)
        ends.append(at)
    return dealt, ends


def shard_features(features: DataFrame, shards: int = 40, ranges: int | None = None) -> DataFrame:
    """Deal feature records into shards of near-equal bytes.

    ``features`` has ``feature_id`` and ``description``; other columns are not read. A record's
    size is its description's UTF-8 bytes plus 16. Records are ordered by a hash of the
    description, then ``feature_id``, so equal texts lie together. Keys are sampled with a
    chance that follows the record's size; quantiles of the sample are the splitters of
    ranges, and a range that still holds over twice its share is subdivided by splitters
    sampled within it. Each range is sorted in one task; running sums over the ranges' exact
    totals give each record its place in all bytes, and the shard is the one that holds the
    record's middle. Records above a 200th of a shard, of which there are at most 200 per
    shard, are dealt first, largest to the emptiest shard, and the others fill the shards to
    one level. So shards differ by about a 200th, unless single records are larger, also when
    one text makes up a third of all rows: then its copies span several shards.

    Result, a row per record: ``feature_id``, ``size``, ``text_crc32``, ``shard``, ``slot`` (0, 1, ... in
    each shard), ``law`` (``bytes``). Null descriptions have 16 bytes and the crc of no text; a null
    feature_id sorts first; equal rows each get a slot; an empty table gives no rows.
    """
    spark = features.sparkSession
    text = F.coalesce(F.col("description").cast("string"), F.lit(""))
    rows = features.select(
        F.col("feature_id").cast("bigint"), (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("tie"),
    )
    rows = stage(rows, "shard-rows")
    ranges = ranges or parallel_tasks(spark)
    total = rows.agg(F.sum("size").alias("t")).first()["t"] or 0
    heavy = F.col("size") * shards * HEAVY_PARTS > total
    dealt, ends = _deal([(r.size, r.tie) for r in rows.where(heavy).select("size", "tie").collect()], total, shards)
    heavies = spark.createDataFrame(dealt, "tie bigint, shard int")
    large = rows.where(heavy).join(F.broadcast(heavies), "tie").withColumn("range", F.lit(-1))  # at most shards * HEAVY_PARTS
    rows = rows.where(~heavy)
    splits = _splitters(rows, ranges, 1)
    sizes = rows.groupBy(_range_of(splits).alias("range")).agg(F.sum("size").alias("n")).collect()  # a row per range
    light = sum(r.n for r in sizes)
    more: list[tuple] = []
    for r in sizes:
        if r.n > 2 * light / ranges and ranges > 1:
            inside = rows.where(_range_of(splits) == r.range)
            more += _splitters(inside, -(-r.n * ranges // light), 2)
    splits = sorted({*splits, *more})
    ranged = rows.withColumn("range", _range_of(splits))
    ranged = stage(ranged.repartition(max(1, len(splits) + 1), "range"), "shard-ranges")
    totals = ranged.groupBy("range").agg(F.sum("size").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("range").orderBy("key", "feature_id", "tie")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("upto", upto).join(F.broadcast(starts), "range")  # a row per range
    middle = 2 * (F.col("start") + F.col("upto")) - F.col("size")
    bounds = F.array(*[F.lit(2.0 * e) for e in ends[:-1]])
    shard = F.size(F.filter(bounds, lambda b: b <= middle)).cast("int")
    columns = ["feature_id", "size", "text_crc32", "key", "tie", "range", "shard"]
    placed = stage(placed.withColumn("shard", shard).select(columns).unionByName(large.select(columns)), "shard-places")
    # slots: the first place of each (shard, range) follows from counts of those pairs alone
    counts = placed.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "range").orderBy("key", "feature_id", "tie"))
    return (
        placed.withColumn("within", within)
        .join(F.broadcast(first), ["shard", "range"])  # at most shards + ranges rows
        .select("feature_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("within") - 1).cast("bigint").alias("slot"))
    )
