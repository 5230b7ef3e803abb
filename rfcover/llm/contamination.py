"""Descriptions that repeat reference texts: prefix-filtered containment of word windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LETTER_OR_DIGIT, LOWER, Words, bitmap, chunks, stage

WINDOW = 13
SHINGLE = 4
FILTER_BITS = 1 << 24
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(text):
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _shingle_hash(words: list[str]) -> int:
    """The hash that documents give to these words, as a signed 64-bit number."""
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    w = Words(data, np.array([0, len(data)]), LETTER_OR_DIGIT)
    return int(w.grams(len(words))[0].astype(np.int64)[0])


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id, words): each run of ``window`` words of an item, or all of a shorter one."""
    words = items.select("item_id", F.regexp_extract_all(_lower(F.col("description")), F.lit(_WORD), F.lit(0)).alias("w"))
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))
    return (
        words.where(n > 0)
        .select("item_id", "w", F.explode(starts).alias("s"))
        .select("item_id", F.slice("w", F.col("s"), F.lit(window)).alias("words"))
        .distinct()
    )


def _with_shingles(windows: DataFrame) -> DataFrame:
    """(words, at, token) for each shingle of each distinct window; shorter windows are one shingle."""

    def run(batches):
        for batch in batches:
            out = []
            for words in batch.column(0).to_pylist():
                k = min(SHINGLE, len(words))
                out += [(words, i, _shingle_hash(words[i : i + k]), k) for i in range(len(words) - k + 1)]
            if out:
                a, b, c, k = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.list_(pa.string())), pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(k, pa.int32())],
                    ["words", "at", "token", "k"],
                )

    return windows.select("words").distinct().mapInArrow(run, "words array<string>, at int, token bigint, k int")


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens.view(np.uint64) >> np.uint64(40)).astype(np.int64)


def _bitmap(tokens: DataFrame) -> np.ndarray:
    return bitmap(tokens.select(F.shiftrightunsigned("token", 40).alias("cell")), FILTER_BITS)


def _document_rows(features: DataFrame, bits, ks, window: int, context: bool) -> DataFrame:
    """Rows of the documents' shingles that the filter lets through.

    With ``context``, (token, pos, words around it) and one row of each document with its
    number of words; without, counts per token within each batch.
    """
    fields = (
        "row_key bigint, feature_id bigint, n_words bigint, token bigint, pos bigint, first bigint, around array<string>"
        if context
        else "token bigint, n bigint"
    )

    def run(batches):
        filter_bits = bits.value
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in chunks(batch, "description"):
                data = LOWER[data]
                w = Words(data, offsets, LETTER_OR_DIGIT)
                found = []
                for k in ks:
                    tokens, inside = w.grams(k)
                    tokens = tokens.view(np.int64)
                    at = np.flatnonzero(inside & filter_bits[_cells(tokens)]) if len(tokens) else np.zeros(0, np.int64)
                    found.append((at, tokens[at]))
                at, tokens = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
                if not context:
                    kinds, n = np.unique(tokens, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n)], ["token", "n"])
                    continue
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2).slice(a, b - a), ids.slice(a, b - a), pa.array(w.counts), *(pa.nulls(b - a, t) for t in (pa.int64(),) * 3), pa.nulls(b - a, pa.list_(pa.string()))],
                    [x.split()[0] for x in fields.split(", ")],
                )
                raw = data.tobytes()
                owner = np.searchsorted(w.first, at, side="right") - 1
                keys = batch.column(2).slice(a, b - a).to_numpy()
                for lo in range(0, len(at), 20_000):
                    some = slice(lo, lo + 20_000)
                    doc, p = owner[some], at[some]
                    first = np.maximum(w.first[doc], p - window + 1)
                    stop = np.minimum(w.first[doc + 1], p + window)
                    around = [[raw[s:e].decode() for s, e in zip(w.start[x:y], w.end[x:y])] for x, y in zip(first, stop)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys[doc]), pa.nulls(len(p), pa.int64()), pa.nulls(len(p), pa.int64()), pa.array(tokens[some]),
                            pa.array(p - w.first[doc]), pa.array(first - w.first[doc]), pa.array(around, pa.list_(pa.string())),
                        ],
                        [x.split()[0] for x in fields.split(", ")],
                    )

    return features.mapInArrow(run, fields)


def contained_windows(features: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """How much of each feature description repeats windows of reference texts.

    ``features`` has ``feature_id`` and ``description``, ``items`` has ``item_id`` and
    ``description`` (entries of the reference catalog); other columns are not read. Words are
    runs of letters, digits and non-ASCII characters after lower-casing A-Z. An item's windows
    are its runs of ``window`` words, or all its words if it has fewer.

    A prefix-filtered set join: a window is the set of its four-word shingles at their places,
    all of which must occur. Shingles are ordered by how often they occur in all descriptions,
    so one, the rarest, is the necessary prefix of a window. Descriptions' shingles pass a
    bitmap of two megabytes (the only thing that is broadcast; it loses no match), are joined
    to the windows on the prefix shingle, bounded by length and position, and then the words
    themselves are compared. Copies and frequent passages only add rows to the join's large
    side, which Spark may split.

    Result, a row per input row: ``feature_id``, ``n_words``, ``n_hit`` (words inside any
    occurrence), ``n_items``, ``item_ids`` (those whose windows occur, sorted as strings),
    ``contaminated`` (n_hit > 0 and share * n_hit >= n_words). Null or empty texts have no
    words and no hits; a null feature_id is kept; null item_ids are not listed; an item without words has no window; repeated
    rows are each reported; empty tables give no rows or no hits.
    """
    spark = features.sparkSession
    rows = features.select(
        F.col("feature_id").cast("bigint"), F.col("description").cast("string"), F.monotonically_increasing_id().alias("row_key")
    )
    items = items.select(F.col("item_id"), F.col("description").cast("string")).where(F.col("item_id").isNotNull())
    links = stage(item_windows(items, window), "item-windows")
    shingles = stage(_with_shingles(links), "item-shingles")
    ks = sorted(r.k for r in shingles.select("k").distinct().collect())  # at most four lengths

    bits = spark.sparkContext.broadcast(_bitmap(shingles))
    counts = _document_rows(rows, bits, ks, window, context=False).groupBy("token").agg(F.sum("n").alias("n"))
    rarity = stage(counts, "shingle-counts")
    # the rarest shingle of each window; one that no description has decides that it occurs nowhere
    order = Window.partitionBy("words").orderBy("n", "token", "at")
    prefix = shingles.join(rarity, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    prefix = prefix.withColumn("r", F.row_number().over(order)).where("r = 1 AND n > 0")
    prefix = stage(prefix.select("token", "words", "at", F.size("words").alias("len")), "window-prefixes")

    bits = spark.sparkContext.broadcast(_bitmap(prefix))
    seen = stage(_document_rows(rows, bits, ks, window, context=True), "document-shingles")
    found = (
        seen.where("token IS NOT NULL")
        .join(prefix, "token")
        .withColumn("begin", F.col("pos") - F.col("at"))
        .where("begin >= first AND begin - first + len <= size(around)")
        .where(F.expr("slice(around, cast(begin - first as int) + 1, len) = words"))
        .select("row_key", "begin", (F.col("begin") + F.col("len")).alias("stop"), "words")
    )
    found = stage(found, "window-hits")
    # words covered: in order of begin, what each window adds behind the furthest stop so far
    spans = found.groupBy("row_key", "begin").agg(F.max("stop").alias("stop"))
    earlier = Window.partitionBy("row_key").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("stop").over(earlier), F.lit(0))
    hit = spans.select("row_key", F.greatest(F.lit(0), F.col("stop") - F.greatest("begin", reach)).alias("n")).groupBy("row_key").agg(F.sum("n").alias("n_hit"))
    owners = found.select("row_key", "words").distinct().join(links, "words").groupBy("row_key").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    both = hit.join(owners, "row_key", "left")
    return (
        seen.where("token IS NULL")
        .select("row_key", "feature_id", "n_words")
        .join(both, "row_key", "left")
        .select(
            "feature_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("bigint").alias("n_items"),
            F.coalesce(F.array_sort("ids"), F.array().cast("array<string>")).alias("item_ids"),
            F.coalesce((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")), F.lit(False)).alias("contaminated"),
        )
    )
