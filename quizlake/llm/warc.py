"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle is a row of frames with a
seek table in a skippable frame at its end (the public seekable format), so one record needs
its frame alone: the index maps a record to bundle, frame, offset and length in the frame.
Of records with equal payloads of at least `least` bytes, one is the response and the others
are revisits that name it and hold no payload.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake.llm.common import put_file

# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LEAST_BYTES = 1000
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
DATE = "1970-01-01T00:00:00Z"


def record_types(pages: DataFrame, least: int = LEAST_BYTES, key: str = "page_id", html: str = "html") -> DataFrame:
    """`key`, url, html with payload_bytes, payload_digest, refers_to (null for a response).

    The digests of repeated payloads are grouped with partial counts, so a payload that
    fills a third of the table is one short row per task; the join back may split it.
    Null html is the empty payload. A row without a key takes part but is never referred to.
    Rows that repeat a key are records of their own; with the payload of the referred page,
    they are responses too. An empty table gives no rows; other columns play no part.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(key).alias("_key"),
        F.col("url"),
        payload.alias("_payload"),
        F.octet_length(payload).cast("bigint").alias("payload_bytes"),
        F.sha1(payload).alias("payload_digest"),
    )
    same = ["payload_digest", "payload_bytes"]
    firsts = (
        rows.filter(F.col("payload_bytes") >= least)
        .groupBy(*same)
        .agg(F.max("_key").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > 1)
        .drop("_rows")
    )
    other = F.col("_first").isNotNull() & ~F.col("_key").eqNullSafe(F.col("_first"))
    return rows.join(firsts, same, "left").select(
        F.col("_key").alias(key),
        "url",
        F.col("_payload").alias("html"),
        *reversed(same),
        F.when(other, F.col("_first")).alias("refers_to"),
    )


def record_id(key: int | None, digest: str) -> str:
    """Id of a record; pages that repeat a key or have none differ by their payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}:{digest}')}>"


def record_bytes(key, url, payload: bytes, digest: str, size: int, refers_to, date: str = DATE) -> bytes:
    """One WARC record."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(key, digest)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%/:?#[]@!$&()*+,;=~-._')}")
    if key is not None:
        head.append(f"X-Page-Id: {key}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}", f"WARC-Profile: {PROFILE}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(frame: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and block of every record of a decompressed frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        lines = frame[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("a record does not begin where it should")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        yield at, headers, frame[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame for frames of (compressed, decompressed) bytes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """Place, compressed and decompressed bytes of every frame, from the end of the bundle."""
    frames, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    width = 12 if flags & 0x80 else 8
    start, at, found = len(bundle) - 9 - frames * width, 0, []
    for i in range(frames):
        packed, plain = struct.unpack_from("<II", bundle, start + i * width)
        found.append((at, packed, plain))
        at += packed
    return found


def read_frame(bundle: bytes, place: int, packed: int, plain: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(bundle[place : place + packed], max_output_size=plain)


def fetch(bundle: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record by its index entry: only its frame is decompressed."""
    return read_frame(bundle, *read_seek_table(bundle)[frame])[offset : offset + length]


def write_bundles(
    records: DataFrame,
    path: str,
    key: str = "page_id",
    frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES,
    level: int = 3,
) -> DataFrame:
    """Write the rows of `record_types` as bundles in `path`; returns the index rows
    (`key`, bundle, frame, offset, length), which are made as the files are: store them.
    No records leave an empty folder."""
    put_file(f"{path}/_bundles", b"")
    key_type = records.schema[key].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        squeeze = zstandard.ZstdCompressor(level=level)
        frame, held = bytearray(), bytearray()
        frames: list[tuple[int, int]] = []
        index: list[tuple] = []
        name = f"part-{part:08d}-{number:06d}.warc.zst"

        def close_frame() -> None:
            packed = squeeze.compress(bytes(frame))
            frames.append((len(packed), len(frame)))
            held.extend(packed)
            frame.clear()

        def close_bundle() -> pa.RecordBatch:
            nonlocal number, name, index
            put_file(f"{path}/{name}", bytes(held) + seek_table(frames))
            columns = [pa.array(c) for c in zip(*index, strict=True)]
            columns[0] = columns[0].cast(schema.field(0).type)
            rows = pa.RecordBatch.from_arrays(columns, schema=schema)
            held.clear()
            frames.clear()
            number, index = number + 1, []
            name = f"part-{part:08d}-{number:06d}.warc.zst"
            return rows

        schema = None
        for batch in batches:
            if schema is None:
                schema = pa.schema(
                    [(key, batch.schema.field(0).type), ("bundle", pa.string()), ("frame", pa.int64()),
                     ("offset", pa.int64()), ("length", pa.int64())]
                )
            for page, url, payload, size, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record = record_bytes(page, url, payload.encode(), digest, size, refers)
                index.append((page, name, len(frames), len(frame), len(record)))
                frame.extend(record)
                if len(frame) >= frame_bytes:
                    close_frame()
                    if len(held) >= bundle_bytes:
                        yield close_bundle()
        if frame:
            close_frame()
        if frames:
            yield close_bundle()

    columns = [key, "url", "html", "payload_bytes", "payload_digest", "refers_to"]
    made = f"`{key}` {key_type}, bundle string, frame bigint, offset bigint, length bigint"
    return records.select(*columns).mapInArrow(write, made)


def read_bundles(spark: SparkSession, path: str, key: str = "page_id") -> DataFrame:
    """All records of the bundles in `path`: `key`, url, html (null for a revisit),
    payload_bytes, payload_digest, record_type, refers_to. A response whose payload does not
    fit its digest raises."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                bundle = content.as_py()
                for place in read_seek_table(bundle):
                    rows = []
                    for _, headers, block in parse_records(read_frame(bundle, *place)):
                        kind, size = headers["WARC-Type"], int(headers["X-Payload-Length"])
                        digest, payload = headers["WARC-Payload-Digest"].removeprefix("sha1:"), None
                        if kind == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError("a payload does not fit its digest")
                        page, refers = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page")
                        rows.append((page and int(page), headers.get("WARC-Target-URI"), None if payload is None else payload.decode(),
                                     size, digest, kind, refers and int(refers)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
                    )

    names = [key, "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    bundles = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("content")
    schema = f"`{key}` bigint, url string, html string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return bundles.mapInArrow(read, schema)
