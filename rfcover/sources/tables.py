"""Delimited files: field measurements and cell-tower exports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import bbox_of
from ..functions.numeric import round_half_up
from ..operators.towers import RADIO_TYPES

# Accepted header names, without spaces, dashes and underscores.
HEADER_ALIASES = {
    "lat": "lat", "latitude": "lat",
    "lon": "lon", "lng": "lon", "long": "lon", "longitude": "lon",
    "dbm": "dbm", "rssi": "dbm", "signaldbm": "dbm", "rssidbm": "dbm", "signal": "dbm",
    "radioid": "radio_id", "radio": "radio_id", "radioname": "radio_id",
}
HEADER_ERROR = "Columns for latitude, longitude and level are needed; see HEADER_ALIASES for the names that are understood."


def measurements_from_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) from text columns under any accepted header, in any order.

    Good rows: lat, lon, dbm, radio_id (NULL when blank). An empty number is not a
    number here, so it is rejected.
    """
    found: dict[str, str] = {}
    for name in rows.columns:
        key = HEADER_ALIASES.get(re.sub(r"[\s_-]", "", name.strip().lower()))
        if key and key not in found:
            found[key] = name
    if not {"lat", "lon", "dbm"} <= set(found):
        raise ValueError(HEADER_ERROR)

    def text(key):
        return F.trim(F.col(f"`{found[key]}`").cast("string"))

    num = {k: text(k).try_cast("double") for k in ("lat", "lon", "dbm")}
    ok = num["lat"].between(-90, 90) & num["lon"].between(-180, 180) & num["dbm"].between(-160, 0)
    ok = F.coalesce(ok, F.lit(False))
    radio = F.nullif(text("radio_id"), F.lit("")) if "radio_id" in found else F.lit(None).cast("string")
    good = rows.where(ok).select(*[v.alias(k) for k, v in num.items()], radio.alias("radio_id"))
    return good, rows.where(~ok)


def read_measurements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Measurement CSV files, each with a header row of its own.

    Files are grouped by their header line and every group is read under its own header, so
    files may name or order their columns differently. Files without a line are skipped.
    Rejected rows keep the text columns of their file.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("no"),
    )
    first = lines.where("at = 0").groupBy("file").agg(F.min_by("value", "no").alias("header"))
    file = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    # A list of file names, such as the driver holds for any scan.
    groups = first.groupBy(F.rtrim("header").alias("header")).agg(F.collect_list(file).alias("files")).orderBy("header").collect()
    if not groups:
        raise ValueError(HEADER_ERROR)
    good = bad = None
    for g in groups:
        rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(g.files)
        ok, rejected = measurements_from_rows(rows)
        good = ok if good is None else good.unionByName(ok)
        bad = rejected if bad is None else bad.unionByName(rejected, allowMissingColumns=True)
    return good, bad


def cells_from_rows(rows: DataFrame, *, bbox=None, mcc=None, max_n: int | None = None, order: str | None = None) -> DataFrame:
    """Cells of the four radio types with finite coordinates; zero codes become NULL.

    ``bbox`` is (west, south, east, north); ``mcc`` a list of country codes. ``max_n``
    keeps the first rows by ``order``.
    """
    def num(name):
        v = F.col(name).cast("string").try_cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)

    def code(name, kind):
        c = num(name) if name in rows.columns else F.lit(None).cast("double")
        return F.nullif(c, F.lit(0.0)).cast(kind).alias(name)

    out = rows.where(F.col("radio").isin(*RADIO_TYPES) & num("lat").isNotNull() & num("lon").isNotNull())
    if bbox:
        w, s, e, n = bbox
        out = out.where(num("lon").between(w, e) & num("lat").between(s, n))
    if mcc:
        out = out.where(num("mcc").isin(*[float(m) for m in mcc]))
    if max_n:
        out = out.orderBy(order).limit(max_n)
    return out.select(
        *([order] if order else []), round_half_up(num("lat"), 5).alias("lat"), round_half_up(num("lon"), 5).alias("lon"), "radio",
        code("mcc", "int"), code("net", "int"), code("range", "double"), code("samples", "bigint"),
    )


def read_cell_export(spark: SparkSession, path: str, **kw) -> DataFrame:
    return cells_from_rows(spark.read.option("header", True).csv(path), **kw)


def snapshot_index(cells: DataFrame, generated: str | None = None) -> DataFrame:
    """(region, file, box, generated, count): one row per region."""
    stamp = F.lit(generated) if generated else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return cells.groupBy("region").agg(
        bbox_of("lon", "lat").alias("box"), F.count(F.lit(1)).alias("count")
    ).select("region", F.concat(F.lower("region"), F.lit(".json")).alias("file"), "box", stamp.alias("generated"), "count")


def upsert_index(index: DataFrame, entries: DataFrame) -> DataFrame:
    """New entries replace those of the same file; the others stay."""
    return index.join(entries.select("file"), "file", "left_anti").unionByName(entries)


def write_cell_snapshot(cells: DataFrame, path: str, index_path: str, generated: str | None = None) -> None:
    """Write the cells by region (only the given regions are replaced) and bring the
    index up to date. The index goes to a new folder per call, the newest one counts; its
    ``file`` is the region's folder below ``path``. :func:`read_snapshot_cells` reads both."""
    spark = cells.sparkSession
    cells.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("region").json(path)
    entries = snapshot_index(cells, generated).withColumn("file", F.concat(F.lit("region="), F.col("region")))
    old = read_snapshot_index(spark, index_path)
    merged = entries.withColumn("version", F.lit(1)) if old is None else upsert_index(
        old.drop("version"), entries
    ).join(old.agg((F.max("version") + 1).alias("version")), F.lit(True))
    merged.write.mode("append").partitionBy("version").json(index_path)


def read_snapshot_cells(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """Cells as :func:`write_cell_snapshot` wrote them, with the time of their region's snapshot."""
    schema = "lat double, lon double, radio string, mcc int, net int, range double, samples bigint, region string"
    cells = spark.read.schema(schema).json(path)
    index = read_snapshot_index(spark, index_path)
    return cells.join(index.select("region", "generated"), "region")


def read_snapshot_index(spark: SparkSession, index_path: str) -> DataFrame | None:
    """Newest version of the index, or None when there is none yet."""
    schema = (
        "region string, file string, box struct<west:double,south:double,east:double,north:double>, "
        "generated string, count bigint, version int"
    )
    try:
        df = spark.read.schema(schema).json(index_path)
    except Exception as e:  # the path does not exist before the first write
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return df.join(df.agg(F.max("version").alias("version")), "version")
