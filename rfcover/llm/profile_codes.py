"""Terrain profiles as short codes: product quantisation in exact integers, assigned by LAESA pivots."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

LIMIT = 1 << 25  # largest integer component; squared distances and sums stay within 64 bits
SLOTS = 8  # a site's rows are joined to its total in so many groups


def _whole_numbers(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All components as floor(scale * x), where each row begins, and which rows are usable."""
    lists = batch.column(2)
    gone = np.asarray(lists.is_null())
    ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0)), dtype=np.int64)
    first = np.concatenate([[0], ends])
    flat = lists.flatten()
    x = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")), np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(x * scale)
        bad = ~(np.abs(x) <= LIMIT)
    run = np.concatenate([[0], np.cumsum(bad)])
    usable = ~gone & (run[first[1:]] == run[first[:-1]])
    return np.where(bad, 0, x).astype(np.int32), first, usable


def _matrix(column, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width) if width else np.zeros((len(column), 0), np.int64)


def pivots_of(codebook: np.ndarray, n: int) -> np.ndarray:
    """Entries far from one another: each next one is the farthest from those taken (ties: lowest index)."""
    taken = [0]
    near = ((codebook - codebook[0]) ** 2).sum(1)
    while len(taken) < min(n, len(codebook)):
        taken.append(int(near.argmax()))
        near = np.minimum(near, ((codebook - codebook[taken[-1]]) ** 2).sum(1))
    return codebook[taken]


def pivot_distances(values: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row to each pivot."""
    out = np.empty((len(values), len(pivots)))
    for j, p in enumerate(pivots):
        d = values - p
        out[:, j] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def nearest_entries(values: np.ndarray, far: np.ndarray, codebook: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each row (ties: lower index), its squared distance, and how many distances were computed.

    ``far`` are the rows' distances to the pivots. By the triangle inequality an entry is no
    nearer than the largest difference of pivot distances; entries are looked at in the order of
    that bound, in growing steps, until the bound of the next one exceeds the best distance.
    Distances are exact in 64-bit integers; the bounds get a margin beyond their rounding.
    """
    n, entries = len(values), len(codebook)
    apart = pivot_distances(codebook, pivots)
    bound = np.abs(far[:, :1] - apart[:, 0])
    for j in range(1, far.shape[1]):
        np.maximum(bound, np.abs(far[:, j : j + 1] - apart[:, j]), out=bound)
    order = np.argsort(bound, axis=1)
    best, where = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    rows, at, width, computed = np.arange(n), 0, 4, 0
    while at < entries and len(rows):
        some = np.sort(order[rows, at : at + width], axis=1)
        d = codebook[some] - values[rows, None, :]
        d = np.einsum("ijk,ijk->ij", d, d)
        computed += d.size
        pick = d.argmin(axis=1)
        least, index = d[np.arange(len(rows)), pick], some[np.arange(len(rows)), pick]
        better = (least < best[rows]) | ((least == best[rows]) & (index < where[rows]))
        best[rows[better]], where[rows[better]] = least[better], index[better]
        at += width
        width *= 2
        if at < entries:
            rows = rows[bound[rows, order[rows, at]] <= np.sqrt(best[rows].astype(np.float64)) * (1 + 1e-9) + 1e-3]
    return where, best, computed


def _assigned(batch: pa.RecordBatch, books: np.ndarray, pivots: list[np.ndarray]):
    """Per part: its values, the nearest entries and their squared distances."""
    parts, _, width = books.shape
    values = _matrix(batch.column("units"), parts * width).astype(np.int64)
    far = _matrix(batch.column("to_pivots"), sum(len(p) for p in pivots))
    at = 0
    for k in range(parts):
        own = values[:, k * width : (k + 1) * width]
        where, best, _ = nearest_entries(own, far[:, at : at + len(pivots[k])], books[k], pivots[k])
        at += len(pivots[k])
        yield own, where, best


def _slices(batches, rows: int = 4096):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _sums(rows: DataFrame, books: np.ndarray, pivots: list[np.ndarray]) -> np.ndarray:
    """Per part and entry: how many parts it got, and their componentwise sums; added up in each task first."""
    parts, entries, width = books.shape

    def run(batches):
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in _slices(batches):
            for k, (own, where, _) in enumerate(_assigned(batch, books, pivots)):
                order = np.argsort(where, kind="stable")
                heads = np.flatnonzero(np.diff(where[order], prepend=-1))
                if len(heads):
                    at = where[order][heads]
                    total[k, at, 0] += np.diff(heads, append=len(order))
                    total[k, at, 1:] += np.add.reduceat(own[order], heads, axis=0)
        k, e = np.nonzero(total[:, :, 0])
        sums = pa.ListArray.from_arrays(np.arange(len(k) + 1, dtype=np.int32) * (width + 1), pa.array(total[k, e].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(e, pa.int32()), sums], ["part", "entry", "sums"])

    found = rows.select("units", "to_pivots").mapInArrow(run, "part int, entry int, sums array<bigint>")
    added = found.select("part", "entry", F.posexplode("sums").alias("at", "v")).groupBy("part", "entry", "at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((parts, entries, width + 1), np.int64)  # as many numbers as the codebooks have, at any input
    out[added["part"].to_numpy(), added["entry"].to_numpy(), added["at"].to_numpy()] = added["v"].to_numpy()
    return out


def compress_profiles(profiles: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, pivots: int = 6, scale: int = 1024) -> DataFrame:
    """Codes of terrain profiles, and how far the coded profiles are from the given ones.

    ``profiles`` has ``link_id``, ``heights`` (array of numbers, the ground along a link at equal
    steps) and ``site_id``; other columns are not read. Heights become integers floor(scale * x),
    each profile is cut into ``parts`` equal consecutive parts, and each part position has a
    codebook that starts with that part of the ``entries`` smallest link_ids. Each round assigns
    every part to the nearest entry (squared distance, ties to the lower index) and replaces
    entries by the floor of their parts' mean; unused ones stay. A last assignment gives the code.

    LAESA: distances of all parts to a few fixed pivots, entries of the first codebook that are
    far apart, are computed once and stored. In each round the distances between pivots and
    entries give lower bounds, by which entries are ordered and dropped; what is left is
    compared in exact integers. Only codebooks, of fixed size, go to tasks and back.

    Result, a row per profile used: ``link_id``, ``code`` (two hex digits for each part),
    ``error`` (squared distances summed), ``site_error`` (error summed over the site, null sites together; at most the
    largest 64-bit number), ``codebooks_sha256``. Dropped: null profiles, those with null, NaN or infinite heights
    or with integers beyond ``LIMIT``, and those that do not have the most frequent length (of
    equally frequent ones the longest) that ``parts`` divides. An empty profile has a distance of 0. A null link_id is kept and comes
    last among the smallest; equal link_ids go by their heights; repeated rows are each coded; fewer rows than
    ``entries`` give smaller codebooks; an empty table gives no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's number must fit two hex digits")
    rows = profiles.select("link_id", "site_id", F.col("heights").cast("array<double>").alias("heights"))
    ids = f"link_id {rows.schema['link_id'].dataType.simpleString()}, site_id {rows.schema['site_id'].dataType.simpleString()}"

    def whole(batches):
        for batch in batches:
            flat, first, usable = _whole_numbers(batch, scale)
            lists = pa.ListArray.from_arrays(first.astype(np.int32), pa.array(flat))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["link_id", "site_id", "units"])
            yield out.filter(pa.array(usable))

    units = stage(rows.mapInArrow(whole, f"{ids}, units array<int>"), "profile-units")
    length = F.size("units")
    usual = units.where(length % parts == 0).groupBy(length.alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    size = usual.n if usual else 0
    units = units.where(length == size)
    start = units.orderBy(F.asc_nulls_last("link_id"), "units").limit(entries).select("units").collect()  # one codebook
    if not start:
        return units.select("link_id", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("site_error"), F.lit("").alias("codebooks_sha256"))
    width = size // parts
    books = np.array([r.units for r in start], np.int64).reshape(len(start), parts, width).transpose(1, 0, 2)
    fixed = [pivots_of(book, pivots) for book in books]
    per_row = sum(len(p) for p in fixed)

    def measured(batches):
        for batch in _slices(batches):
            values = _matrix(batch.column("units"), size).astype(np.int64)
            far = np.concatenate([pivot_distances(values[:, k * width : (k + 1) * width], p) for k, p in enumerate(fixed)], axis=1)
            lists = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * per_row, pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), lists], ["link_id", "site_id", "units", "to_pivots"])

    units = stage(units.mapInArrow(measured, f"{ids}, units array<int>, to_pivots array<double>"), "profile-pivots")
    for _ in range(rounds):
        sums = _sums(units, books, fixed)
        count = sums[:, :, :1]
        books = np.where(count > 0, sums[:, :, 1:] // np.maximum(count, 1), books)

    def coded(batches):
        for batch in _slices(batches):
            found = list(_assigned(batch, books, fixed))
            codes = np.stack([where for _, where, _ in found], axis=1).astype(np.uint8)
            error = sum(best for _, _, best in found)
            text = pa.array([bytes(c).hex() for c in codes], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text, pa.array(error, pa.int64())], ["link_id", "site_id", "code", "error"])

    out = stage(units.mapInArrow(coded, f"{ids}, code string, error bigint"), "profile-codes")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    site = F.coalesce(F.concat(F.lit("="), F.col("site_id").cast("string")), F.lit("")).alias("site")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("bigint")
    sites = out.groupBy(site).agg(total.alias("site_error")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    rows = out.select("link_id", "code", "error", site, F.pmod(F.xxhash64("link_id", "code"), F.lit(SLOTS)).cast("int").alias("slot"))
    return rows.join(sites, ["site", "slot"]).select("link_id", "code", "error", "site_error", F.lit(digest).alias("codebooks_sha256"))
