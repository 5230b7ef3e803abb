"""WARC archives of documents found on the web, written and read by an index."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import open_input, open_output, parallel_tasks, scratch_folder, stage

FILE_BYTES = 64 << 20
READ_BYTES = 8 << 20
GAP_BYTES = 64 << 10
DATE = "2024-01-01T00:00:00Z"

INDEX = "archive string, offset bigint, length bigint, feature_id bigint, uri string, digest string"
RECORD = "feature_id bigint, uri string, record_type string, refers_to bigint, payload_digest string, full_bytes bigint, payload binary"


def _id(key) -> str:
    return f"<urn:feature:{'none' if key is None else key}>"


def _record(key, uri: str, digest: str, payload: bytes, refers_to) -> bytes:
    revisit = refers_to is not None
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(key)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub('[\\s]', lambda m: f'%{ord(m[0]):02X}', uri)}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(refers_to)}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    packed = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packed.compress(raw) + packed.flush()


def parse_record(member: bytes) -> dict:
    """One gzip member as a record: its headers, and of a response the checked payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda x: None if x is None or x == "<urn:feature:none>" else int(x[len("<urn:feature:") : -1])
    if named["WARC-Type"] == "response" and (len(payload) != full or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("payload and digest differ")
    return {
        "feature_id": number(named["WARC-Record-ID"]), "uri": named["WARC-Target-URI"], "record_type": named["WARC-Type"],
        "refers_to": number(named.get("WARC-Refers-To")), "payload_digest": digest, "full_bytes": full, "payload": payload,
    }


def write_archives(features: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write a WARC record per document; the result is the index of the archives.

    ``features`` has ``feature_id``, ``uri`` and ``document`` (the source text that a feature was
    imported from); other columns are not read. Of documents with equal payloads of at least
    ``least_bytes`` bytes, the one with the largest feature_id is the response and the others
    are revisits that name it. The winners are found on digests alone, added up before the
    shuffle; only digests that occur twice are joined to the documents, and Spark may split
    that join. Each task writes gzip members to files of about 64 MB below
    ``spark.checkpoint.dir``, under names that are new in each attempt, and lists them; only
    what finished tasks list is read.

    Result, a row per record: ``archive``, ``offset``, ``length``, ``feature_id``, ``uri``,
    ``digest``. Null documents are empty, null uris are empty; a document with a null feature_id is
    a response unless its payload has another key; rows that repeat the response's key are
    responses; an empty table writes nothing.
    """
    folder = scratch_folder(features.sparkSession, "archives")
    payload = F.coalesce(F.col("document").cast("string"), F.lit("")).cast("binary")
    rows = features.select(F.col("feature_id").cast("bigint"), F.coalesce(F.col("uri").cast("string"), F.lit("")).alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    same = rows.where(F.length("payload") >= least_bytes).groupBy("sha1").agg(F.count(F.lit(1)).alias("n"), F.max("feature_id").alias("winner"))
    same = stage(same.where("n > 1").select("sha1", "winner"), "equal-payloads")
    marked = rows.join(same, "sha1", "left").select(
        "feature_id", "uri", "payload", "sha1",
        F.when((F.length("payload") >= least_bytes) & ~F.col("feature_id").eqNullSafe(F.col("winner")), F.col("winner")).alias("refers_to"),
    )

    def run(batches):
        task, number, out, offset, rows = TaskContext.get().partitionId(), 0, None, 0, []
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in INDEX.split(", ")]
        for batch in batches:
            for key, uri, payload, sha1, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if out is None:
                    name = f"{folder}/{task:06d}-{number:04d}-{uuid.uuid4().hex}.warc.gz"
                    out, offset, number = open_output(name), 0, number + 1
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                member = _record(key, uri, digest, payload, refers_to)
                out.write(member)
                rows.append((name, offset, len(member), key, uri, digest))
                offset += len(member)
                if offset >= FILE_BYTES:
                    out.close()
                    out = None
            if rows and out is None or len(rows) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                rows = []
        if out is not None:
            out.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return stage(marked.mapInArrow(run, INDEX), "archive-index")


def read_archives(index: DataFrame) -> DataFrame:
    """Read the records that an index lists: their headers, and the payload of responses.

    Rows are dealt out by ranges of (archive, offset) and sorted, and each task reads byte ranges
    that join neighbours less than 64 KB apart, up to 8 MB at a time. Payloads are held
    against their digests. An empty index gives no rows.
    """

    def run(batches):
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        held, name, source = [], None, None

        def read():
            nonlocal held
            begin = held[0][0]
            source.seek(begin)
            data = source.read(held[-1][0] + held[-1][1] - begin)
            found = [parse_record(data[o - begin : o - begin + n]) for o, n in held]
            held = []
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], k) for c, k in zip(names, kinds)], names)

        for batch in batches:
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and (archive != name or offset - sum(held[-1]) > GAP_BYTES or offset + length - held[0][0] > READ_BYTES):
                    yield read()
                if archive != name:
                    if source is not None:
                        source.close()
                    name, source = archive, open_input(archive)
                held.append((offset, length))
        if held:
            yield read()
        if source is not None:
            source.close()

    wanted = index.select("archive", "offset", "length").repartitionByRange(parallel_tasks(index.sparkSession), "archive", "offset")
    return wanted.sortWithinPartitions("archive", "offset").mapInArrow(run, RECORD)
