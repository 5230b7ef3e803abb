"""Near-duplicate descriptions: rare-first prefix join of n-gram sets, and their classes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_WHITE, Words, bitmap, chunks, mix, parallel_tasks, stage

SHINGLE = 5
SKETCH_BITS = 22
SKETCH_BLOCK = 1 << 15
SIGNATURE = 8  # 64-bit words of a set's bitmap
SIGNS = [f"s{i}" for i in range(SIGNATURE)]
NODE_CELLS = 1 << 24
PARTS = 16  # of the suffix filter


# ---- classes of linked nodes --------------------------------------------------------


def linked_classes(edges: DataFrame) -> DataFrame:
    """(node, class): the smallest node that each node of ``edges`` (a, b) reaches.

    Every round takes the smallest class of the neighbours and then the class's own class, so
    the rounds grow with the logarithm of a chain's length. Each round is written.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("class")), "classes")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "class"), "b").groupBy("a").agg(F.min("class").alias("m"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.least("class", "m").alias("next"), "class")
        up = step.select(F.col("node").alias("next"), F.col("next").alias("up"))
        step = stage(step.join(up, "next").select("node", F.least("next", "up").alias("next"), "class"), "classes")
        labels = step.select("node", F.col("next").alias("class"))
        if step.where("next <> class").isEmpty():
            return labels


# ---- sets of n-grams ----------------------------------------------------------------


def _sets(data, offsets, k):
    """Of each text its distinct k-word grams (all its words if it has fewer): grams sorted by
    (text, gram), and where each text's grams begin."""
    w = Words(LOWER[data], offsets, NOT_WHITE)
    grams, inside = w.grams(k)
    owner = w.text_of()
    at = np.flatnonzero(inside)
    who, what = owner[at], grams[at]
    few = np.flatnonzero((w.counts > 0) & (w.counts < k))
    for n in np.unique(w.counts[few]):
        some = few[w.counts[few] == n]
        g, _ = w.grams(int(n))
        who, what = np.concatenate([who, some]), np.concatenate([what, g[w.first[some]]])
    order = np.lexsort((what, who))
    who, what = who[order], what[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (what[1:] != what[:-1])
    who, what = who[new], what[new]
    return who, what, np.searchsorted(who, np.arange(len(w.counts) + 1))


def _cell(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _keep_distinct(features: DataFrame, k: int) -> DataFrame:
    """(row_key, feature_id, n_shingles, set_key): a key of each description's set of grams."""

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in chunks(batch, "description"):
                who, what, first = _sets(data, offsets, k)
                n = np.diff(first)
                key = []
                for salt in (np.uint64(0), np.uint64(0x5851F42D4C957F2D)):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(what ^ salt), dtype=np.uint64)])
                    key.append(mix((total[first[1:]] - total[first[:-1]]) ^ n.astype(np.uint64)).view(np.int64))
                bits = np.zeros((len(n), 64 * SIGNATURE), bool)
                bits[who, (what % np.uint64(64 * SIGNATURE)).astype(np.int64)] = True
                words = np.packbits(bits, axis=1, bitorder="little").view("<i8")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2).slice(a, b - a), batch.column(0).slice(a, b - a), pa.array(n), pa.array(key[0]), pa.array(key[1]), *(pa.array(words[:, i]) for i in range(SIGNATURE))],
                    ["row_key", "feature_id", "n_shingles", "key1", "key2", *SIGNS],
                )

    return features.mapInArrow(run, "row_key bigint, feature_id bigint, n_shingles bigint, key1 bigint, key2 bigint, " + ", ".join(f"{c} bigint" for c in SIGNS))


def _frequencies(texts: DataFrame, k: int) -> np.ndarray:
    """How many sets have a gram in each of four million cells: 16 MB at any size of the input."""

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch, "description"):
                total += np.bincount(_cell(_sets(data, offsets, k)[1]), minlength=1 << SKETCH_BITS)
        total = total.astype("<u4")
        blocks = [i for i in range(0, len(total), SKETCH_BLOCK) if total[i : i + SKETCH_BLOCK].any()]
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([total[i : i + SKETCH_BLOCK].tobytes() for i in blocks])], ["at", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[at] = sums.get(at, 0) + np.frombuffer(counts, "<u4").astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int64()), pa.array([np.minimum(x, (1 << 32) - 1).astype("<u4").tobytes() for x in sums.values()])], ["at", "counts"]
            )

    rows = texts.mapInArrow(count, "at bigint, counts binary")
    got = rows.repartition(parallel_tasks(texts.sparkSession), "at").mapInArrow(add, "at bigint, counts binary").toArrow()
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for at, counts in zip(got["at"].to_pylist(), got["counts"].to_pylist()):
        out[at : at + SKETCH_BLOCK] = np.frombuffer(counts, "<u4")
    return out


def _prefix_lengths(n: np.ndarray, percent: int) -> np.ndarray:
    """Rarest grams needed so that two sets that link share at least one of them."""
    return n - -(-percent * n // 100) + 1


POSTING = np.dtype([("gram", "<u8"), ("node", "<i8"), ("n", "<u4"), ("pos", "<u4")])


def _postings(texts: DataFrame, sent, k: int, percent: int, parts: int) -> DataFrame:
    """Prefix grams that at least two sets have: (gram, node, n, pos).

    Tasks send packed postings by ranges of the gram's hash; the receiving task sorts its range
    and drops grams with one posting. Of a gram that a chunk of texts has often, all but two
    postings go straight to a row of their own, spread over all parts.
    """

    def run(batches):
        counts = sent.value
        for batch in batches:
            held = []
            for a, b, data, offsets in chunks(batch, "description"):
                who, what, first = _sets(data, offsets, k)
                n = np.diff(first)
                order = np.lexsort((what, counts[_cell(what)], who))
                who, what = who[order], what[order]
                pos = np.arange(len(who)) - first[who]
                keep = pos < _prefix_lengths(n, percent)[who]
                out = np.zeros(int(keep.sum()), POSTING)
                out["gram"], out["n"], out["pos"] = what[keep], n[who[keep]], pos[keep]
                out["node"] = batch.column(0).slice(a, b - a).to_numpy()[who[keep]]
                held.append(out)
            if not held:
                continue
            out = np.concatenate(held)
            out = out[np.argsort(out["gram"], kind="stable")]
            begin = np.flatnonzero(np.concatenate(([True], out["gram"][1:] != out["gram"][:-1])))
            size = np.diff(np.append(begin, len(out)))
            rank = np.arange(len(out)) - np.repeat(begin, size)
            known = (rank >= 2) & (np.repeat(size, size) >= 16)
            part = (out["gram"] % np.uint64(parts)).astype(np.int64)
            rows = []
            for is_known, some, where in ((False, out[~known], part[~known]), (True, out[known], (mix(out["node"][known].astype(np.uint64)) % np.uint64(parts)).astype(np.int64))):
                order = np.argsort(where, kind="stable")
                some, where = some[order], where[order]
                cuts = np.searchsorted(where, np.arange(parts + 1))
                rows += [(p, is_known, some[cuts[p] : cuts[p + 1]].tobytes()) for p in range(parts) if cuts[p] < cuts[p + 1]]
            if rows:
                p, is_known, packed = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(is_known), pa.array(packed, pa.binary())], ["part", "known", "packed"])

    def merge(batches):
        def out(rows):
            for at in range(0, len(rows), 100_000):
                x = rows[at : at + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x["gram"].view(np.int64) if x["gram"].flags.c_contiguous else x["gram"].astype(np.int64)), pa.array(x["node"].copy()), pa.array(x["n"].astype(np.int32)), pa.array(x["pos"].astype(np.int32))],
                    ["gram", "node", "n", "pos"],
                )

        held = []
        for batch in batches:
            for known, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                x = np.frombuffer(packed, POSTING)
                if known:
                    yield from out(x)
                else:
                    held.append(x)
        if held:
            x = np.concatenate(held)
            held.clear()
            grams, n = np.sort(x["gram"]), None
            twice = np.unique(grams[1:][grams[1:] == grams[:-1]])
            if len(twice):
                i = np.minimum(np.searchsorted(twice, x["gram"]), len(twice) - 1)
                yield from out(x[twice[i] == x["gram"]])

    rows = texts.mapInArrow(run, "part int, known boolean, packed binary")
    return rows.repartition(parts, "part").mapInArrow(merge, "gram bigint, node bigint, n int, pos int")


def _verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int, together: int = 500) -> DataFrame:
    """Those of the pairs (a, b) whose sets link; each pair is looked at once.

    Texts that no pair needs are dropped where they are read, by a bitmap of two megabytes that
    lets some others through. Texts go to their pairs' tasks once per ``a``: the text of ``a`` comes first, those of its
    partners follow one by one. An ``a`` with more than ``together`` partners is dealt
    out to several tasks.
    """
    slots = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / together).alias("slots"))
    pairs = pairs.join(slots, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("slots")).cast("int").alias("salt"))
    heads = pairs.select("a", "salt").distinct().select("a", "salt", F.col("a").alias("node"))
    wanted = heads.withColumn("head", F.lit(True)).unionByName(pairs.select("a", "salt", F.col("b").alias("node"), F.lit(False).alias("head")))
    cell = F.pmod(F.xxhash64("node"), F.lit(NODE_CELLS)).alias("cell")
    needed = texts.sparkSession.sparkContext.broadcast(bitmap(wanted.select(cell), NODE_CELLS))

    def narrow(batches):
        bits = needed.value
        for batch in batches:
            keep = bits[batch.column(2).to_numpy()]
            if keep.any():
                yield batch.filter(pa.array(keep)).select([0, 1])

    some = texts.select("node", "description", cell).mapInArrow(narrow, "node bigint, description string")
    rows = wanted.join(some.hint("shuffle_merge"), "node")

    def run(batches):
        key, own, counts = None, None, None
        for batch in batches:
            salts, heads, nodes = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keys = batch.column(0).to_pylist()
            found = []
            for lo, hi, data, offsets in chunks(batch, "description"):
                _, what, first = _sets(data, offsets, k)
                for i in range(lo, hi):
                    other = what[first[i - lo] : first[i - lo + 1]]
                    if heads[i]:
                        key, own = (keys[i], salts[i]), other
                        counts = np.bincount((own >> np.uint64(60)).astype(np.int64), minlength=PARTS)
                        continue
                    if (keys[i], salts[i]) != key:
                        raise RuntimeError("a pair came without its first text")
                    # suffix filter: the sets differ at least by how their parts differ in size
                    both = len(own) + len(other)
                    apart = np.abs(counts - np.bincount((other >> np.uint64(60)).astype(np.int64), minlength=PARTS)).sum()
                    if (100 + percent) * (both - apart) < 2 * percent * both:
                        continue
                    common = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * common >= percent * (both - common):
                        found.append((keys[i], nodes[i]))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = rows.select("a", "salt", "head", "node", "description").repartition("a", "salt").sortWithinPartitions("a", "salt", F.desc("head"))
    return rows.mapInArrow(run, "a bigint, b bigint")


def similar_descriptions(features: DataFrame, k: int = SHINGLE, percent: int = 75, row_key: str | None = None) -> DataFrame:
    """Classes of feature descriptions whose sets of word n-grams have a Jaccard similarity of ``percent`` or more.

    ``features`` has ``feature_id`` and ``description``; other columns are not read. Rows are told apart by
    ``row_key``, a column of different whole numbers that are the same in every scan; without one rows are numbered and
    staged once, since numbers given while scanning would change with the cuts of the input. Words are
    runs of non-white-space after lower-casing A-Z; a set holds the distinct ``k``-word runs, or
    all the words as one if there are fewer. Rows with equal sets are one node.

    A prefix join: grams are ordered rarest first (counts over all sets, in four million
    hashed cells, so ties and collisions only change the order), the necessary prefix of each
    set is dealt out by gram, and grams that one set has are dropped. Of a gram's sets, each is
    first compared with one of them, drawn anew for each gram; the links found give classes. Then
    every pair of sets of different classes that shares a prefix gram, and whose lengths,
    positions and bitmaps of 512 bits allow a link, passes a suffix filter and is verified, once. Pairs within a class cannot
    change it, so large groups of copies give no more pairs than members times grams.

    Result, a row per input row: ``feature_id``, ``n_shingles``, ``component_id`` (the smallest
    feature_id reachable by links, itself included). A null, empty or white text has no
    shingles and its own id; a null feature_id keeps null unless its class has others, whose
    smallest it gets; repeated rows are each reported; an empty table gives no rows.
    """
    spark = features.sparkSession
    key = F.monotonically_increasing_id() if row_key is None else F.col(row_key)
    rows = features.select(F.col("feature_id").cast("bigint"), F.col("description").cast("string"), key.alias("row_key"))
    if row_key is None:
        rows = stage(rows, "set-rows")
    keyed = stage(_keep_distinct(rows, k), "set-keys")
    nodes = keyed.where("n_shingles > 0").groupBy("key1", "key2").agg(F.min("row_key").alias("node"), F.min("feature_id").alias("smallest"), *[F.first(c).alias(c) for c in SIGNS])
    nodes = stage(nodes, "set-nodes")
    texts = rows.select(F.col("row_key").alias("node"), "description")

    sent = spark.sparkContext.broadcast(_frequencies(texts, k))
    parts = max(parallel_tasks(spark), 16)
    posts = _postings(texts, sent, k, percent, parts).join(nodes.select("node"), "node", "left_semi")
    posts = stage(posts.select("gram", "node", "n", "pos"), "postings")

    # stars: a gram in eight links its sets to one of them: the one whose own prefix is shared
    # most, which lies in the middle of its copies, or for some grams the first in a random order
    shared = posts.groupBy("node").agg((F.count(F.lit(1)) / F.max("n")).alias("share"))
    some = posts.where("pmod(gram, 8) = 0").join(shared, "node")
    rank = F.expr("if(pmod(shiftright(gram, 8), 4) = 0, 0.0, share)")
    hub = some.groupBy("gram").agg(F.max_by(F.struct("node", "n"), F.struct(rank, F.xxhash64("node"))).alias("hub"))
    fits = F.least("n", "hub.n") * 100 >= percent * F.greatest("n", "hub.n")
    stars = some.join(hub, "gram").where(fits & (F.col("node") != F.col("hub.node")))
    stars = stars.select(F.greatest("node", "hub.node").alias("b"), F.least("node", "hub.node").alias("a")).distinct()
    links = stage(_verify(stage(stars, "star-pairs"), texts, k, percent), "star-links")
    classes = linked_classes(links)

    # what is left: pairs across classes
    own = F.coalesce("class", "node")
    p = posts.join(classes, "node", "left").select("gram", "node", "n", "pos", own.alias("class"))
    p = stage(p, "class-postings")
    mixed = p.groupBy("gram").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("gram")
    p = p.join(mixed, "gram").join(nodes.select("node", *SIGNS), "node")
    x, y = p.alias("x"), p.alias("y")
    need = F.ceil(F.lit(percent) * (F.col("x.n") + F.col("y.n")) / (100 + percent))
    at_most = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) + F.least("x.pos", "y.pos")
    apart = [sum(F.bit_count(F.col(f"{u}.{c}").bitwiseAND(F.bitwise_not(F.col(f"{v}.{c}")))) for c in SIGNS) for u, v in ("xy", "yx")]
    cross = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.class") != F.col("y.class")))
    cross = cross.where(F.least("x.n", "y.n") * 100 >= percent * F.greatest("x.n", "y.n"))  # length
    cross = cross.where((F.col("x.pos") <= F.col("x.n") - need) & (F.col("y.pos") <= F.col("y.n") - need) & (at_most >= need))  # position
    cross = cross.where((F.col("x.n") - apart[0] >= need) & (F.col("y.n") - apart[1] >= need))  # grams that the other bitmap lacks
    cross = stage(cross.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "cross-pairs")
    more = stage(_verify(cross, texts, k, percent), "cross-links")
    classes = linked_classes(links.unionByName(more))

    named = nodes.join(classes, "node", "left").select("key1", "key2", "smallest", F.coalesce("class", "node").alias("class"))
    least = named.groupBy("class").agg(F.min("smallest").alias("component_id"))
    named = named.join(least, "class").select("key1", "key2", "component_id")
    return keyed.join(named, ["key1", "key2"], "left").select(
        "feature_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("feature_id")).alias("component_id")
    )
