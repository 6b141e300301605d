"""Token ids in byte-aligned variable-length files with separate control bytes.

Ids are replaced by their frequency rank (the most frequent id is 0), so that most take one
byte. A file holds its documents' keys and id counts, then one control byte per four ids
(two bits each: bytes less one) and then the data bytes. Decoding is a table lookup: a
control byte gives the four sizes, a running sum the places, and the bytes are gathered.

    magic "QLT1", documents u32, ids u64, data bytes u64,
    keys i64 (and one byte each: 1 if the key is null), id counts u64, control bytes, data bytes
    (integers little-endian)

`rank.table` beside the files holds the ids by rank as u32.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quizlake.llm.common import paused_gc, put_file, scratch, stored
from quizlake.llm.word_ids import word_ids

MAGIC = b"QLT1"
HEAD = struct.Struct("<4sIQQ")
FILE_IDS = 4_000_000
#: Sizes of the four ids that a control byte stands for.
SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1


def id_type(vocabulary_size: int) -> type:
    """Type of stored ids."""
    return np.uint16 if vocabulary_size <= 1 << 16 else np.uint32


def token_ids(docs: DataFrame, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and `ids` (little-endian u16 if the whole vocabulary fits, else u32) of every
    whole text, the end id last. Null text counts as empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = word_ids(vocabulary), np.array([end_id], np.int32)
        kind = id_type(encoder.library.get_vocab_size())
        for batch in batches:
            with paused_gc():
                rows = [np.concatenate([r, tail]).astype(kind).tobytes() for r in encoder.encode_all(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=[key, "ids"])

    key_type = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(encode, f"`{key}` {key_type}, ids binary")


def frequency_ranked(ids: DataFrame, kind: type) -> np.ndarray:
    """All ids that occur, most frequent first, ties by id: at most one row per vocabulary
    entry reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for row in batch.column(0):
                if len(found := np.frombuffer(row.as_py(), kind)):
                    some = np.bincount(found)
                    if len(some) > len(total):
                        total = np.pad(total, (0, len(some) - len(total)))
                    total[: len(some)] += some
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    counts = ids.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return np.array([r.id for r in counts.orderBy(F.desc("n"), "id").collect()], np.uint32)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit integers."""
    n = len(ranks)
    v = ranks.astype(np.uint32)
    size = 1 + (v > 0xFF).astype(np.int64) + (v > 0xFFFF) + (v > 0xFFFFFF)
    four = np.zeros((n + 3) // 4 * 4, np.uint8)
    four[:n] = size - 1
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    end = np.cumsum(size)
    start = end - size
    data = np.zeros(int(end[-1]) if n else 0, np.uint8)
    for byte in range(4):
        has = size > byte
        if has.any():
            data[start[has] + byte] = (v[has] >> (8 * byte)).astype(np.uint8)
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The integers that `pack` was given."""
    size = SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    end = np.cumsum(size)
    start = end - size
    source = np.frombuffer(data, np.uint8)
    out = source[start].astype(np.uint32)
    for byte in range(1, 4):
        has = np.flatnonzero(size > byte)
        if len(has):
            out[has] |= source[start[has] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return out


def file_bytes(keys: list[int | None], rows: list[np.ndarray]) -> bytes:
    """One file from the keys and ranked ids of its documents."""
    control, data = pack(np.concatenate(rows) if rows else np.zeros(0, np.uint32))
    counts = np.array([len(r) for r in rows], np.uint64)
    return b"".join(
        [
            HEAD.pack(MAGIC, len(rows), int(counts.sum()), len(data)),
            np.array([k or 0 for k in keys], np.int64).tobytes(),
            np.array([k is None for k in keys], np.uint8).tobytes(),
            counts.tobytes(),
            control,
            data,
        ]
    )


def read_file(content: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """Keys and ranked ids of the documents of a file."""
    magic, docs, n, size = HEAD.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEAD.size
    keys = np.frombuffer(content, np.int64, docs, at)
    none = np.frombuffer(content, np.uint8, docs, at + 8 * docs)
    counts = np.frombuffer(content, np.uint64, docs, at + 9 * docs).astype(np.int64)
    at += 17 * docs
    controls = (n + 3) // 4
    ids = unpack(content[at : at + controls], content[at + controls : at + controls + size], n)
    ends = np.cumsum(counts)
    rows = [ids[e - c : e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
    return [None if x else k for k, x in zip(keys.tolist(), none, strict=True)], rows


def write_files(
    ids: DataFrame, path: str, vocabulary_size: int, key: str = "doc_id", file_ids: int = FILE_IDS
) -> DataFrame:
    """Write `ids` (`key`, ids) as token files in ascending order of `key` (null first; rows of
    one key by a hash of their ids, then the ids) and return the stored manifest: file, documents, ids, base (ids in the files before it).
    `ids` is read more than once: hand in a stored table."""
    kind = id_type(vocabulary_size)
    table = frequency_ranked(ids, kind)
    put_file(f"{path}/rank.table", table.tobytes())
    put_file(f"{path}/files/_made", b"")  # the folder is there without documents, too
    rank = np.zeros(int(table.max()) + 1 if len(table) else 1, np.uint32)
    rank[table] = np.arange(len(table), dtype=np.uint32)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        rows: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, keys, rows, held
            name = f"ids-{part:08d}-{number:06d}.qlt"
            put_file(f"{path}/files/{name}", file_bytes(keys, rows))
            made = {"file": [name], "documents": [len(keys)], "ids": [held]}
            number, keys, rows, held = number + 1, [], [], 0
            return pa.RecordBatch.from_pydict(made, schema=pa.schema(
                [("file", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))

        for batch in batches:
            for k, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.frombuffer(row.as_py(), kind)
                if rows and held + len(found) > file_ids:
                    yield flush()
                keys.append(k)
                rows.append(rank[found])
                held += len(found)
        if rows:
            yield flush()

    # The hash also parts a key that very many rows repeat.
    ordered = ids.select(key, "ids", F.xxhash64("ids").alias("_hash")).repartitionByRange(key, "_hash")
    ordered = ordered.sortWithinPartitions(key, "_hash", "ids").select(key, "ids")
    manifest = stored(ordered.mapInArrow(write, "file string, documents bigint, ids bigint"), "token-manifest")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_files(spark: SparkSession, path: str, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents of all files: `key`, start (ids of all documents before it), ids."""
    table = spark.read.format("binaryFile").load(f"{path}/rank.table").select("content").first()
    id_of = np.frombuffer(bytes(table[0]) if table else b"", np.uint32)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, rows = read_file(content.as_py())
                sizes = np.array([len(r) for r in rows], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()),
                        pa.array(base + np.cumsum(sizes) - sizes),
                        pa.array([id_of[r].tobytes() for r in rows], pa.binary()),
                    ],
                    names=[key, "start", "ids"],
                )

    files = spark.read.format("binaryFile").load(f"{path}/files").select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "content"
    )
    # The manifest has one short row per file; where it is small enough, Spark broadcasts it.
    held = files.join(manifest.select("file", "base"), "file").select("base", "content")
    return held.mapInArrow(read, f"`{key}` bigint, start bigint, ids binary")
