"""A Merkle manifest of feature layers, kept as postorder append logs."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parallel_tasks, stage

BLOCK_LEVELS = 12  # a builder appends an aligned range of 2^12 leaves
STEP = "struct<side:tinyint,sibling:string>"
LOG = "tree string, block bigint, position bigint, level int, node_index bigint, digest string, leaves bigint, top int, feature_id bigint, claimed string"
PROVED = f"tree string, node_index bigint, leaf string, subroot string, root string, proof array<{STEP}>, feature_id bigint, claimed string"
_STEP_TYPE = pa.struct([("side", pa.int8()), ("sibling", pa.string())])


def record_digest(*fields) -> Column:
    """Digest of a record: of each field its byte count, a colon and its text; a dash where it is null."""
    def one(c):
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(one, fields)), 256)


def fold_proof(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and a proof lead to."""
    def step(acc, s):
        return F.sha2(F.when(s.side < 0, F.concat(s.sibling, acc)).when(s.side > 0, F.concat(acc, s.sibling)).otherwise(acc), 256)

    return F.aggregate(proof, leaf, step)


def height(leaves: int) -> int:
    """Levels above the leaves until one node is left."""
    return max(0, leaves - 1).bit_length()


def postorder(level, index, leaves):
    """Place of a node in the log of a tree over ``leaves`` leaves, counted from 0.

    A full subtree of 2^l leaves has 2^(l+1) - 1 nodes, so the log holds 2m - popcount(m) nodes when m
    leaves and all the full nodes above them are written. A full node is the last of its
    own subtree; nodes short of leaves exist once a level, above the lowest set bit of
    ``leaves``, and are written last, from low to high.
    """
    level, index = np.asarray(level, np.int64), np.asarray(index, np.int64)
    begin = index << level
    lowest = (leaves & -leaves).bit_length() - 1
    short = 2 * leaves - leaves.bit_count() + level - lowest - 1
    full = 2 * begin - np.bitwise_count(begin) + (np.int64(2) << level) - 2
    return np.where(begin + (np.int64(1) << level) <= leaves, full, short)


def _join(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def completed(leaves: list[str], top: int):
    """(level, index, digest) of all nodes of a range, each when it is complete."""
    waiting: dict[int, str] = {}
    for i, digest in enumerate(leaves):
        level = 0
        yield level, i, digest
        while level in waiting:
            digest = _join(waiting.pop(level), digest)
            level += 1
            yield level, i >> level, digest
        waiting[level] = digest
    carry = None
    for level in range(top):
        left = waiting.pop(level, None)
        if left is None and carry is None:
            continue
        carry = _join(*(x for x in (left, carry) if x is not None))
        yield level + 1, (len(leaves) - 1) >> (level + 1), carry


def _ranked(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int, int]:
    """Rows with their ``rank`` in the tree and the tree's ``leaves``; the largest tree; how many trees.

    Rows are dealt out by ranges of (tree, order) and staged in that order. A row's rank is
    its number in its range and tree, plus the rows of the ranges before; only one number per
    range and tree is added up.
    """
    parts = parallel_tasks(rows.sparkSession)
    rows = stage(rows.withColumn("tie", F.monotonically_increasing_id()), f"{name}-leaves")
    placed = rows.repartitionByRange(parts, "tree", *[F.asc_nulls_first(c) for c in order], "tie").sortWithinPartitions("tree", *[F.asc_nulls_first(c) for c in order], "tie")
    placed = stage(placed.drop("tie").withColumn("number", F.monotonically_increasing_id()), f"{name}-order")
    part = F.shiftright("number", 33).alias("part")
    runs = placed.groupBy("tree", part).agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("tree").orderBy("part")
    runs = runs.select(
        "tree", "part", (F.sum("n").over(before) - F.col("n") - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy("tree")).alias("leaves")
    )
    runs = stage(runs, f"{name}-runs")
    most = runs.agg(F.max("leaves").alias("most"), F.count_distinct("tree").alias("trees")).first()
    out = placed.withColumn("part", part).join(runs, ["tree", "part"]).withColumn("rank", F.col("number") + F.col("shift"))
    return out.drop("part", "number", "shift"), most.most or 0, most.trees


def _append(rows: DataFrame, levels: int, name: str) -> DataFrame:
    """The logs of all aligned blocks of leaves; rows have tree, rank, leaves, digest, feature_id, claimed."""

    def run(batches):
        held, at = [], None

        def out():
            (tree, block), leaves = at, held[0][3]
            own = [r[4] for r in held]
            top = levels if leaves > 1 << levels else height(leaves)
            nodes = list(completed(own, top))
            first = block * ((2 << levels) - 1)
            n, ids, claims = len(nodes), [], []
            for level, i, _ in nodes:
                ids.append(held[i][5] if level == 0 else None)
                claims.append(held[i][6] if level == 0 else None)
            columns = [
                pa.array([tree] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()),
                pa.array([x[0] for x in nodes], pa.int32()), pa.array([x[1] + (block << (levels - x[0])) for x in nodes], pa.int64()), pa.array([x[2] for x in nodes], pa.string()),
                pa.array([len(own)] * n, pa.int64()), pa.array([top] * n, pa.int32()), pa.array(ids, pa.int64()), pa.array(claims, pa.string()),
            ]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in LOG.split(", ")])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:2] != at:
                    yield out()
                    held = []
                at = row[:2]
                held.append(row)
        if held:
            yield out()

    block = F.shiftright("rank", levels).alias("block")
    dealt = rows.select("tree", block, "rank", "leaves", "digest", "feature_id", "claimed").repartition("tree", "block").sortWithinPartitions("tree", "block", "rank")
    return stage(dealt.mapInArrow(run, LOG), name)


def append_logs(rows: DataFrame, most: int, levels: int, name: str) -> list[DataFrame]:
    """Logs of the trees over ranked leaves, tier by tier: the roots of a tier's blocks are the leaves of the next."""
    logs = []
    while True:
        logs.append(_append(rows, levels, f"{name}-log-{len(logs)}"))
        if most <= 1 << levels:
            return logs
        most = -(-most >> levels)
        whole = F.expr(f"((leaves - 1) >> {levels}) + 1")
        sizes = rows.select("tree", whole.alias("leaves")).where("leaves > 1").distinct()
        roots = logs[-1].where((F.col("level") == F.col("top")) & (F.col("top") == levels)).select("tree", F.col("node_index").alias("rank"), "digest", "feature_id", "claimed")
        rows = roots.join(sizes, "tree")


def _proved(log: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """Proofs of a tier's leaves: siblings in their block, at places known from the sizes, then what lies above the block.

    ``above``: tree, block, subroot, root, proof; one row a block.
    """
    head = above.select("tree", "block", F.lit(-1).cast("bigint").alias("position"), F.struct("subroot", "root", "proof").alias("above"))
    nodes = log.select("tree", "block", "position", "level", "node_index", "digest", "leaves", "top", "feature_id", "claimed")
    both = nodes.unionByName(head, allowMissingColumns=True)

    def run(batches):
        held, at, top_row = [], None, None

        def out():
            tree, block = at
            leaves, top = held[0][6], held[0][7]
            digest = [r[5] for r in held]  # by position, from the block's first
            r = np.arange(leaves)
            sides, places = np.zeros((leaves, top), np.int8), np.zeros((leaves, top), np.int64)
            for level in range(top):
                i = r >> level
                other = i ^ 1
                there = (other << level) < leaves
                sides[:, level] = np.where(there, np.where(other < i, -1, 1), 0)
                places[:, level] = postorder(level, np.where(there, other, i), leaves)
            own = [held[p] for p in postorder(0, r, leaves)]
            rest = top_row["proof"]
            side, sibling = [], []
            for s, p in zip(sides.tolist(), places.tolist()):
                side += s
                sibling += [digest[x] if y else None for x, y in zip(p, s)]
                side += [x["side"] for x in rest]
                sibling += [x["sibling"] for x in rest]
            steps = pa.StructArray.from_arrays([pa.array(side, pa.int8()), pa.array(sibling, pa.string())], fields=list(_STEP_TYPE))
            proofs = pa.ListArray.from_arrays(np.arange(leaves + 1, dtype=np.int32) * (top + len(rest)), steps)
            columns = [
                pa.array([tree] * leaves, pa.string()), pa.array([x[4] for x in own], pa.int64()), pa.array([x[5] for x in own], pa.string()),
                pa.array([top_row["subroot"]] * leaves, pa.string()), pa.array([top_row["root"]] * leaves, pa.string()), proofs,
                pa.array([x[8] for x in own], pa.int64()), pa.array([x[9] for x in own], pa.string()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["tree", "node_index", "leaf", "subroot", "root", "proof", "feature_id", "claimed"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != at:
                    if held:
                        yield out()
                    held, at, top_row = [], row[:2], row[10]
                else:
                    held.append(row)
        if held:
            yield out()

    dealt = both.repartition("tree", "block").sortWithinPartitions("tree", "block", "position")
    return dealt.mapInArrow(run, PROVED)


def _prove(logs: list[DataFrame], roots: DataFrame, levels: int, name: str) -> DataFrame:
    """Proofs of the leaves of all trees, from the top tier down; ``roots``: tree, subroot, root, proof above the tree."""
    proofs = None
    for k in reversed(range(len(logs))):
        # trees of one block in this tier take what lies above the whole tree; the blocks of others are leaves of the next tier
        alone = logs[k].where("position = 0").select("tree", F.lit(0).cast("bigint").alias("block")).join(roots, "tree").select("tree", "block", "subroot", "root", "proof")
        if proofs is not None:
            higher = proofs.select("tree", F.col("node_index").alias("block"), "subroot", "root", "proof")
            alone = alone.join(proofs.select("tree").distinct(), "tree", "left_anti").unionByName(higher)
        proofs = _proved(logs[k], alone, levels)
        if k:
            proofs = stage(proofs, f"{name}-proofs-{k}")
    return proofs


def feature_manifest(features: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Merkle tree over layers of features: every record's digest, its layer's root, the root, and the proof between.

    ``features`` has ``feature_id``, ``layer`` and ``digest`` (see ``record_digest``), and may have ``claimed``, a
    digest that a holder of the record states, which is carried along for ``fold_proof``; other
    columns are not read. In a layer, records ascend by feature_id; while more than one node
    remains, every two consecutive ones, or the last alone, become the digest of their digests'
    hex texts. What remains is the layer's subroot; subroots, ordered by layer, null first,
    likewise give the root.

    Aligned builders each take 2^``block_levels`` consecutive leaves of a layer and append nodes
    to their log in the order of completion (postorder). The place of any node follows from
    subtree sizes, so proofs are read from a block's log by place, without a search or a join
    per level. Roots of blocks are the leaves of the next tier of logs, and layers those of the
    last. Layers of any size are spread over tasks by block.

    Result, a row per input row: ``feature_id``, ``layer``, ``leaf``, ``subroot``, ``root``, ``proof`` (array of
    (side, sibling) per level: side -1 before, 1 behind, 0 where a node is alone, without
    sibling), ``claimed``. A null layer is a layer; null feature_ids come first in theirs; equal
    feature_ids go by digest, and repeated rows are leaves of their own; an empty table gives no rows.
    """
    claimed = F.col("claimed").cast("string") if "claimed" in features.columns else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit("="), F.col("layer").cast("string")), F.lit(""))
    rows = features.select(tree.alias("tree"), F.col("feature_id").cast("bigint"), F.col("digest").cast("string"), claimed.alias("claimed"))
    ranked, most, _ = _ranked(rows, ["feature_id", "digest"], "manifest")
    logs = append_logs(ranked, most, block_levels, "manifest")

    tops = None
    for log in reversed(logs):  # a tree's last node is in the highest tier that it reaches
        own = log.where((F.col("block") == 0) & (F.col("level") == F.col("top"))).select("tree", "digest")
        tops = own if tops is None else tops.unionByName(own.join(tops, "tree", "left_anti"))
    tops = stage(tops, "manifest-subroots")
    layers = tops.select(F.lit("").alias("tree"), F.col("tree").alias("layer_tree"), "digest", F.lit(None).cast("bigint").alias("feature_id"), F.lit(None).cast("string").alias("claimed"))
    placed, trees, _ = _ranked(layers, ["layer_tree"], "layers")
    upper = append_logs(placed.drop("layer_tree"), trees, block_levels, "layers")
    root = upper[-1].where((F.col("block") == 0) & (F.col("level") == F.col("top"))).select("tree", F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.array().cast(f"array<{STEP}>").alias("proof"))
    above = _prove(upper, root, block_levels, "layers")
    names = placed.select(F.col("rank").alias("node_index"), F.col("layer_tree").alias("tree"))
    above = stage(above.drop("tree").join(names, "node_index").select("tree", F.col("leaf").alias("subroot"), "root", "proof"), "layer-proofs")

    out = _prove(logs, above, block_levels, "manifest")
    return out.select("feature_id", F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).alias("layer"), "leaf", "subroot", "root", "proof", "claimed")
