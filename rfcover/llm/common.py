"""Helpers shared by the corpus operators: staged tables, files of tasks, words as arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, removed when the session ends.

    A local session without that setting (tests) gets a temporary folder; on a cluster the
    setting is required, because executors must share the folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='rfcover-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return fs.makeQualified(where).toString()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and go on from the files, so that it is computed once."""
    path = f"{scratch_folder(df.sparkSession, name)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bitmap(cells: DataFrame, bits: int) -> np.ndarray:
    """Which of ``bits`` cells occur in the column ``cell``: a fixed size at any number of rows."""
    words = cells.groupBy(F.expr("cast(cell div 64 as int) AS w")).agg(F.expr("bit_or(shiftleft(1L, cast(cell % 64 as int)))").alias("b"))
    got = words.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def parallel_tasks(spark: SparkSession) -> int:
    """How many tasks to deal small rows with heavy work out to."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ---- files that tasks write and read ------------------------------------------------


def open_output(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_output_stream(path, compression=None)


def open_input(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


# ---- texts as byte arrays -----------------------------------------------------------

WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
NOT_WHITE = ~WHITE
LETTER_OR_DIGIT = np.ones(256, bool)
LETTER_OR_DIGIT[0x00:0x30] = False
LETTER_OR_DIGIT[0x3A:0x61] = False
LETTER_OR_DIGIT[0x7B:0x80] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# One random odd or even 64-bit value per byte, fixed by the seed.
_BYTE = np.random.Generator(np.random.PCG64(20240611)).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


_CACHE: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_CACHE.get("power", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        _CACHE["power"] = _powers(size, _BASE)
        _CACHE["inverse"] = _powers(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))
    return _CACHE["power"], _CACHE["inverse"]


class Words:
    """All words of some texts: per word its first byte, the byte after it, its text and a hash.

    ``data`` holds the UTF-8 bytes of the texts one after the other, ``offsets`` where each text
    begins (one more entry for the end). A word is a longest run of bytes that ``table`` marks.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, hashes: bool = True):
        self.data, self.offsets = data, offsets
        inside = np.zeros(len(data) + 1, bool)
        if len(data):
            np.take(table, data, out=inside[: len(data)])
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        first[heads] = inside[heads]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        tails = offsets[1:]
        tails = tails[tails > 0] - 1
        last[tails] = inside[tails]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        # where the words of each text begin
        self.first = np.searchsorted(self.start, offsets).astype(np.int64)
        self.counts = np.diff(self.first)
        self.hash = self._hash() if hashes else None

    def _hash(self) -> np.ndarray:
        n = len(self.data)
        power, inverse = _tables(n + 1)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * power[:n], out=run[1:])
        out = run[self.end]
        out -= run[self.start]
        out *= inverse[self.start]
        out ^= (self.end - self.start).astype(np.uint64) * _M1
        return mix(out)

    def text_of(self) -> np.ndarray:
        """The number of the text that each word is in."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words, and which of them lie within one text."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            out *= _BASE
            out += self.hash[j : n - k + 1 + j]
        out = mix(out ^ np.uint64(k))
        owner = self.text_of()
        return out, owner[: n - k + 1] == owner[k - 1 :]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into row ranges of about ``limit`` text bytes: first row, row after, bytes, offsets.

    A row without text counts as empty. A text longer than the limit is a range of its own.
    """
    col = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        kind = np.int32
    else:
        kind = np.int64
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    n = len(col)
    if not n:
        return
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        to = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        to = min(n, max(to, row + 1))
        yield row, to, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to
