"""Blocks of vectors: the unit that the search and the near-duplicate operators work on."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlake.llm.common import get_file, put_file

BLOCK = "block bigint, n bigint, width bigint, keys binary, counts binary, values binary"


def finite(vector: str) -> Column:
    """Whether a vector is there, not empty, and holds only finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as doubles; shorter rows end in zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """`vectors` (key bigint, count bigint, values array<double>) as blocks of at most `rows`.
    The rows are dealt evenly over as many tasks as blocks are needed. Store the result:
    block numbers are given as it is made."""
    tasks = max(1, -(-vectors.count() // rows))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            nonlocal number, held
            part = pa.Table.from_batches(held).combine_chunks()
            held = []
            values = matrix(part.column(2).combine_chunks())
            number += 1
            return pa.RecordBatch.from_pydict(
                {
                    "block": [number - 1],
                    "n": [len(part)],
                    "width": [values.shape[1]],
                    "keys": [part.column(0).to_numpy().tobytes()],
                    "counts": [part.column(1).to_numpy().tobytes()],
                    "values": [values.tobytes()],
                },
                schema=pa.schema([("block", pa.int64()), ("n", pa.int64()), ("width", pa.int64()),
                                  ("keys", pa.binary()), ("counts", pa.binary()), ("values", pa.binary())]),
            )

        for batch in batches:
            at = 0
            while at < len(batch):
                room = rows - sum(map(len, held))
                held.append(batch.slice(at, room))
                at += room
                if sum(map(len, held)) >= rows:
                    yield close()
        if held:
            yield close()

    return vectors.select("key", "count", "values").repartition(tasks).mapInArrow(cut, BLOCK)


def padded(values: bytes, n: int, width: int, to: int) -> np.ndarray:
    return widened(np.frombuffer(values, np.float64).reshape(n, width), to)


def filed(vectors: DataFrame, rows: int, folder: str) -> list[tuple[str, int, int]]:
    """`blocks` as files on the shared store, for tasks that read many of them one by one: path, rows and width
    of each. A task that repeats writes files of other names, so those given here belong together."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                path = f"{folder}/{uuid.uuid4().hex}"
                put_file(path, pa.compress(r["keys"] + r["values"], codec="zstd", asbytes=True))
                yield pa.RecordBatch.from_pydict({"path": [path], "n": [r["n"]], "width": [r["width"]]})

    made = blocks(vectors, rows).mapInArrow(put, "path string, n bigint, width bigint").collect()
    return sorted((r.path, r.n, r.width) for r in made)


def read_block(path: str, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of a block that `filed` has written."""
    data = pa.decompress(get_file(path), n * 8 * (1 + width), codec="zstd", asbytes=True)
    return np.frombuffer(data, np.int64, n), np.frombuffer(data, np.float64, n * width, n * 8).reshape(n, width)


def widened(values: np.ndarray, to: int) -> np.ndarray:
    return values if values.shape[1] == to else np.pad(values, ((0, 0), (0, to - values.shape[1])))
