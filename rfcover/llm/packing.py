"""Pack token ids of feature descriptions into training sequences of several lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

TIERS = (256, 512, 1024, 2048)
HOLD_TOKENS = 4 << 20

PIECES = (
    "feature_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, tier int, step_group bigint, token_ids binary"
)


class Rest:
    """Pieces that wait for a place, by length; the longest that fits is found by a bit mask."""

    def __init__(self, longest: int):
        self.stacks: list[list[tuple[int, int]]] = [[] for _ in range(longest + 1)]
        self.mask = 0

    def put(self, length: int, doc: int, start: int) -> None:
        self.stacks[length].append((doc, start))
        self.mask |= 1 << length

    def take(self, most: int, least: int = 1) -> tuple[int, int, int] | None:
        """The longest piece of at most ``most`` and at least ``least`` ids."""
        length = (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1
        if length < least:
            return None
        doc, start = self.stacks[length].pop()
        if not self.stacks[length]:
            self.mask &= ~(1 << length)
        return length, doc, start


def pack(rest: Rest, tiers: tuple[int, ...], last: bool) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Windows of waiting pieces, longest tier first: window length, then (doc, start, length).

    A piece is routed to the shortest tier that holds it. The gap behind it goes to the longest
    pieces of shorter tiers that fit; what is then left is filled by the front of a longer
    piece, whose tail waits again. Without ``last``, pieces that cannot fill a window stay. With
    it, they are cut at powers of two, so that nothing is padded.
    """
    for tier, below in zip(reversed(tiers), [*reversed(tiers[:-1]), 0]):
        while (head := rest.take(tier, below + 1)) is not None:
            length, doc, start = head
            window, room = [(doc, start, length)], tier - length
            while room:
                more = rest.take(min(room, below) if below else room) or rest.take(room)
                if more is None:
                    longer = rest.take(len(rest.stacks) - 1)
                    if longer is None:
                        break
                    n, d, s = longer
                    rest.put(n - room, d, s + room)
                    more = (room, d, s)
                window.append((more[1], more[2], more[0]))
                room -= more[0]
            if not room:
                yield tier, window
                continue
            if not last:  # nothing else waits: keep these pieces for the next round
                for d, s, n in window:
                    rest.put(n, d, s)
                return
            size = 1 << ((tier - room).bit_length() - 1)
            part, left = [], size
            for d, s, n in window:
                if cut := min(n, left):
                    part.append((d, s, cut))
                    left -= cut
                if n > cut:
                    rest.put(n - cut, d, s + cut)
            yield size, part
            yield from pack(rest, tiers, last)
            return


def pack_descriptions(
    features: DataFrame, tokenizer_file: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_tokens: int = 65_536
) -> DataFrame:
    """Hierarchical packing of feature descriptions into sequences of several context sizes.

    ``features`` has ``feature_id`` and ``description``; other columns are not read. Each
    description is encoded with the tokenizer file, without special tokens, and ends with
    ``end_id``. Ids beyond the largest of ``tiers`` (powers of two) fill whole windows; the rest
    of a description is routed to the shortest tier that holds it. Tiers are packed from the
    longest down, gaps of long windows are filled from shorter tiers, and a last gap by the
    front of a longer piece. Each task packs the rows that it reads, about four million ids at a
    time, and hands what does not fill a window to its next round; nothing is shuffled, so copies
    and hot sources change nothing. Sequences follow each other in step groups of
    ``step_tokens`` ids: lengths are powers of two, so groups are equal but for a task's last.

    Result, a row per piece: ``feature_id``, ``start`` and ``length`` in the description's ids,
    ``doc_tokens`` (all its ids), ``sequence_id``, ``offset`` in the sequence, ``tier`` (the
    sequence's length), ``step_group``, ``token_ids`` (little-endian 32-bit). No sequence is
    padded. A null or empty description is one piece that holds the end id; a null feature_id is kept;
    repeated rows are packed once each; an empty table gives no rows.
    """
    longest, end = tiers[-1], np.array([end_id], "<u4").tobytes()
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(tiers):
        raise ValueError("tiers must be rising powers of two")

    def run(batches):
        encode = encoder(tokenizer_file).encode
        rest, docs, out = Rest(longest), {}, []
        state = {"next": 0, "held": 0, "sequence": TaskContext.get().partitionId() << 40, "sum": 0}
        task = TaskContext.get().partitionId() << 40

        def add(tier, window):
            offset = 0
            for d, s, n in window:
                key, ids = docs[d]
                out.append((key, s, n, len(ids) // 4, state["sequence"], offset, tier, task + state["sum"] // step_tokens, ids[4 * s : 4 * (s + n)]))
                offset += n
            state["sequence"] += 1
            state["sum"] += tier

        def flush(last):
            # descriptions that still wait keep their ids for the next round
            for tier, window in pack(rest, tiers, last):
                add(tier, window)
            waiting = {d for stack in rest.stacks for d, _ in stack}
            for d in [d for d in docs if d not in waiting]:
                del docs[d]
            state["held"] = 0
            for at in range(0, len(out), 20_000):
                cols = zip(*out[at : at + 20_000])
                kinds = [pa.int64()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
                names = [x.split()[0] for x in PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
            out.clear()

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(keys):
                to, size = at, 0
                while to < len(keys) and size < 4 << 20:
                    size += len(texts[to].as_py() or "")
                    to += 1
                for key, ids in zip(keys[at:to], encode([t or "" for t in texts.slice(at, to - at).to_pylist()])):
                    ids += end
                    d, n = state["next"], len(ids) // 4
                    state["next"] += 1
                    docs[d] = (key, ids)
                    whole = n // longest * longest
                    for s in range(0, whole, longest):
                        add(longest, [(d, s, longest)])
                    if n > whole:
                        rest.put(n - whole, d, whole)
                    state["held"] += n
                at = to
                if state["held"] >= HOLD_TOKENS:
                    yield from flush(False)
        yield from flush(True)

    rows = features.select(F.col("feature_id").cast("bigint"), F.col("description").cast("string"))
    return rows.mapInArrow(run, PIECES)
