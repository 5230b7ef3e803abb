"""Token ids of feature descriptions in grammar-compressed shard files."""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import open_input, open_output, parallel_tasks, scratch_folder, stage
from .tokens import encoder

MAGIC = b"RFTOK1\0\0"
SHARD_IDS = 1 << 20
ROUNDS = 4
MIN_PAIRS = 16
SAMPLE = 64


def learn_pairs(ids: np.ndarray, first_free: int, end_id: int, rounds: int = ROUNDS, least: int = MIN_PAIRS):
    """Re-Pair in rounds: the rules (left, right) and the ids with frequent pairs replaced.

    Each round counts every adjacent pair, gives each pair found ``least`` times or more a
    nonterminal, and replaces its occurrences; of overlapping occurrences every other one. Nonterminals number from ``first_free`` up to 65,535. No rule reaches
    past an end id, so documents keep their own symbols.
    """
    rules, seq = [], ids.astype(np.uint32)
    closed = np.zeros(1 << 16, bool)  # symbols that end a document
    closed[end_id] = True
    for _ in range(rounds):
        room = (1 << 16) - first_free - len(rules)
        if len(seq) < 2 or room <= 0:
            break
        a, b = seq[:-1], seq[1:]
        code = (a.astype(np.uint64) << np.uint64(16)) | b
        # pairs are counted in hashed cells; a cell counts one pair, others wait for the next round
        cell = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        held = np.zeros(1 << 20, np.uint64)
        held[cell] = code
        own = held[cell] == code
        own &= ~closed[a]
        counts = np.bincount(cell[own], minlength=1 << 20)
        chosen = np.flatnonzero(counts >= least)
        chosen = chosen[np.argsort(-counts[chosen], kind="stable")[:room]]
        if not len(chosen):
            break
        number = np.zeros(1 << 20, np.uint32)
        number[chosen] = np.arange(first_free + len(rules), first_free + len(rules) + len(chosen))
        at = np.flatnonzero(own & (number[cell] > 0))
        symbol, kinds = number[cell[at]], held[chosen]
        # occurrences next to each other overlap: take the 1st, 3rd, ... of each run
        fresh = np.concatenate(([True], np.diff(at) > 1))
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - begin) % 2 == 0
        at, symbol = at[take], symbol[take]
        pairs = np.stack([kinds >> np.uint64(16), kinds & np.uint64(0xFFFF)], 1).astype(np.uint16)
        closed[first_free + len(rules) : first_free + len(rules) + len(chosen)] = closed[pairs[:, 1]]
        rules.extend(pairs)
        seq = seq.copy()
        seq[at] = symbol
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
    return np.array(rules, np.uint16).reshape(-1, 2), seq.astype(np.uint16)


def expansions(rules: np.ndarray, first_free: int) -> list[bytes]:
    """What each symbol stands for, as little-endian 32-bit ids."""
    out = [struct.pack("<I", i) for i in range(first_free)]
    for left, right in rules.tolist():
        out.append(out[left] + out[right])
    return out


def shard_bytes(keys: list, lengths: list[int], ids: np.ndarray, first_free: int, end_id: int) -> bytes:
    """One shard: rules, expansion lengths, symbols, and where each document's symbols begin."""
    rules, seq = learn_pairs(ids, first_free, end_id)
    width = np.ones(first_free + len(rules), np.uint32)
    for n, (left, right) in enumerate(rules.tolist()):
        width[first_free + n] = width[left] + width[right]
    ends = np.cumsum(width[seq], dtype=np.uint64)
    stops = np.cumsum(np.array(lengths, np.uint64))
    symbols = np.searchsorted(ends, stops).astype(np.uint64) + np.uint64(1)
    null = np.array([k is None for k in keys], np.uint8)
    body = [
        np.array([k or 0 for k in keys], "<i8"), null, np.array(lengths, "<u4"), symbols.astype("<u4"),
        rules.astype("<u2"), width[first_free:].astype("<u4"), ends[::SAMPLE].astype("<u4"), seq.astype("<u2"),
    ]
    parts = [x.tobytes() for x in body]
    head = MAGIC + struct.pack("<IIIII", first_free, len(keys), len(rules), len(seq), len(ids))
    return b"".join([head, *parts])


HEAD = len(MAGIC) + 20


class Shard:
    """A shard read back; ``ids(i)`` decodes the i-th document alone."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        self.first_free, docs, rules, symbols, self.total = struct.unpack("<IIIII", data[len(MAGIC) : HEAD])
        at = HEAD

        def read(kind, n):
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        keys, null = read("<i8", docs), read("u1", docs)
        self.keys = [None if z else int(k) for k, z in zip(keys, null)]
        self.lengths, self.stops = read("<u4", docs), read("<u4", docs)
        self.rules = read("<u2", 2 * rules).reshape(-1, 2)
        self.widths, self.marks = read("<u4", rules), read("<u4", -(-symbols // SAMPLE))
        self.symbols = read("<u2", symbols)
        self.table = expansions(self.rules, self.first_free)

    def ids(self, i: int) -> bytes:
        begin = int(self.stops[i - 1]) if i else 0
        return b"".join(map(self.table.__getitem__, self.symbols[begin : int(self.stops[i])].tolist()))


INDEX = "task int, shard int, shard_file string, rows bigint, ids bigint"
IDS = "feature_id bigint, start bigint, n_tokens bigint, token_ids binary"


def write_token_files(features: DataFrame, tokenizer_file: str, end_id: int = 2, vocabulary: int = 49_408) -> DataFrame:
    """Write the ids of all descriptions, in ascending ``feature_id`` order, as Re-Pair shards.

    ``features`` has ``feature_id`` and ``description``. Rows are dealt out by ranges of
    ``feature_id``; a task sorts its range, encodes it without special tokens, puts ``end_id``
    behind each description and writes files of about a million ids (a longer description is
    one file) below ``spark.checkpoint.dir``. Each file holds a grammar learned on its ids:
    frequent pairs become nonterminals in rounds; rules, expansion lengths and sampled
    positions allow any document to be decoded alone. A file's name is new in each attempt of
    a task, and only files that a finished task lists are read.

    Result: a row per file, in order of ``task`` and ``shard``: ``shard_file``, ``rows``,
    ``ids``. Null or empty descriptions are an end id; null keys come first; repeated rows
    stay, ordered by their text. An empty table gives no file. ``vocabulary`` is the number of
    ids of the tokenizer (at most 65,536 less the rules wanted).
    """
    folder = scratch_folder(features.sparkSession, "token-files")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = encoder(tokenizer_file).encode
        task, done = TaskContext.get().partitionId(), []
        keys, parts, held = [], [], 0

        def close():
            nonlocal keys, parts, held
            if keys:
                uri = f"{folder}/{task:08d}-{len(done):06d}-{uuid.uuid4().hex}.rftok"
                ids = np.frombuffer(b"".join(parts), "<u4")
                with open_output(uri) as f:
                    f.write(shard_bytes(keys, [len(p) // 4 for p in parts], ids, vocabulary, end_id))
                done.append((task, len(done), uri, len(keys), len(ids)))
            keys, parts, held = [], [], 0

        for batch in batches:
            for at in range(0, batch.num_rows, 1200):
                some = batch.slice(at, 1200)
                for key, ids in zip(some.column(0).to_pylist(), encode([t or "" for t in some.column(1).to_pylist()])):
                    keys.append(key)
                    parts.append(ids + end)
                    held += len(ids) // 4 + 1
                    if held >= SHARD_IDS:
                        close()
        close()
        if done:
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], [x.split()[0] for x in INDEX.split(", ")])

    rows = features.select(F.col("feature_id").cast("bigint"), F.col("description").cast("string"))
    ordered = rows.repartitionByRange("feature_id").sortWithinPartitions("feature_id", "description")
    return stage(ordered.mapInArrow(run, INDEX), "token-index")


def read_token_files(files: DataFrame) -> DataFrame:
    """Decode shards: per document ``feature_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``token_ids``.

    ``files`` is the result of ``write_token_files``. Shards are dealt out over all tasks; a
    task decodes one at a time. The starts come from running sums over the file rows (about one
    for a million ids) and within each file.
    """

    def run(batches):
        for batch in batches:
            for uri, file_start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open_input(uri) as f:
                    shard = Shard(f.read())
                starts = file_start + np.cumsum(shard.lengths, dtype=np.int64) - shard.lengths
                n = len(shard.keys)
                for at in range(0, n, 1000):
                    some = range(at, min(n, at + 1000))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([shard.keys[i] for i in some], pa.int64()), pa.array(starts[at : at + 1000]),
                            pa.array(shard.lengths[at : at + 1000].astype(np.int64)), pa.array([shard.ids(i) for i in some], pa.binary()),
                        ],
                        [x.split()[0] for x in IDS.split(", ")],
                    )

    before = Window.orderBy("task", "shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("shard_file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("file_start"))
    return starts.repartition(parallel_tasks(files.sparkSession)).mapInArrow(run, IDS)
