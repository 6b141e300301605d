"""Best-fit packing of token pieces into sequences of a fixed capacity.

Only lengths decide a packing and there are at most `capacity` of them, so the packing is
planned on the histogram of lengths: one row per length, whatever the corpus holds. A plan
row says that the pieces with ranks [first, first + bins * each) of a length go, `each` per
sequence, to `bins` sequences in a row. Pieces get their rank per length on the cluster and
look their place up in the plan.

Planning: pieces above a third of the capacity come first, from the longest, each sequence
taking at most two of them (the second is the longest that still fits); then smaller pieces,
from the longest, go to the smallest gap that holds them, or to a new sequence.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.llm.common import paused_gc
from quizlake.llm.word_ids import word_ids
from quizlake.operators.ranking import ordinal

CAPACITY = 1024
ID_BUCKET = 4096


def pieces(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    capacity: int = CAPACITY,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Ids of every whole text and the end id, in pieces of at most `capacity`: `key`, piece,
    start, length, ids (little-endian unsigned 32-bit). Of a longer text the first piece is
    the one that may be shorter. Null text counts as empty: one piece with the end id."""
    key_type = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(vocabulary)
        tail = np.array([end_id], np.int32)
        for batch in batches:
            with paused_gc():
                doc, piece, start, length, ids = [], [], [], [], []
                for i, row in enumerate(encoder.encode_all(batch.column(1))):
                    row = np.concatenate([row, tail])
                    short = len(row) % capacity
                    ends = list(range(short or capacity, len(row) + 1, capacity))
                    starts = [0, *ends[:-1]]
                    doc.extend([i] * len(ends))
                    piece.extend(range(len(ends)))
                    start.extend(starts)
                    length.extend(b - a for a, b in zip(starts, ends, strict=True))
                    ids.extend(row[a:b].tobytes() for a, b in zip(starts, ends, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(doc, pa.int32())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=[key, "piece", "start", "length", "ids"],
            )

    schema = f"`{key}` {key_type}, piece int, start bigint, length bigint, ids binary"
    return docs.select(key, text).mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Plan rows (length, first, bins, each, sequence, offset) for a histogram of lengths."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("a length lies outside 1 to capacity")
    used = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[int] = []  # sorted sizes of open gaps
    runs: dict[int, list[tuple[int, int]]] = {}  # gap: runs (first sequence, sequences)
    total = 0

    def put(length: int, bins: int, each: int, sequence: int, offset: int) -> None:
        rows.append((length, used[length], bins, each, sequence, offset))
        used[length] += bins * each
        left[length] -= bins * each
        if not left[length]:
            del left[length]

    def leave(gap: int, sequence: int, bins: int) -> None:
        if gap and bins:
            if gap not in runs:
                bisect.insort(gaps, gap)
            runs.setdefault(gap, []).append((sequence, bins))

    for size in sorted((n for n in left if 3 * n > capacity), reverse=True):
        while size in left:
            partners = [n for n in left if 3 * n > capacity and n + size <= capacity and (n != size or left[n] > 1)]
            mate = max(partners, default=0)
            bins = left[size] if not mate else left[size] // 2 if mate == size else min(left[size], left[mate])
            put(size, bins, 1, total, 0)
            if mate:
                put(mate, bins, 1, total, size)
            leave(capacity - size - mate, total, bins)
            total += bins
    for size in sorted(left, reverse=True):
        while size in left:
            at = bisect.bisect_left(gaps, size)
            if at == len(gaps):
                each = min(capacity // size, left[size])
                bins = left[size] // each
                put(size, bins, each, total, 0)
                leave(capacity - each * size, total, bins)
                total += bins
                continue
            gap = gaps[at]
            sequence, open_ = runs[gap].pop()
            if not runs[gap]:
                del runs[gap]
                gaps.pop(at)
            each = min(gap // size, left[size])
            bins = min(open_, left[size] // each)
            put(size, bins, each, sequence, capacity - gap)
            leave(gap, sequence + bins, open_ - bins)
            leave(gap - each * size, sequence, bins)
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def placed(cut: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """`cut` (columns `key`, piece, length and any others) with sequence_id and offset. The
    input is read twice: hand in a stored table. Rows without a key are placed too."""
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    rows = plan(counts, capacity)
    bucket = F.coalesce(F.floor(F.col(key) / ID_BUCKET), F.lit(-(2**62)))
    ranked = ordinal(cut, ["length"], [F.col(key), F.col("piece")], bucket, name="_rank", start=0)
    span = np.array([0, *(counts.get(n, 0) for n in range(1, capacity + 1))], np.int64)
    offset = np.concatenate([[0], np.cumsum(span)])
    # Ranks of all lengths on one line, so that one sorted search finds the plan row.
    line = offset[rows[:, 0]] + rows[:, 1]

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        row = rows[np.searchsorted(line, offset[n] + r, "right") - 1]
        nth, inside = np.divmod(r - row[:, 1], row[:, 3])
        return pa.StructArray.from_arrays(
            [pa.array(row[:, 4] + nth), pa.array(row[:, 5] + inside * n)], names=["sequence_id", "offset"]
        )

    ranked = ranked.withColumn("_place", place("length", "_rank"))
    return ranked.select(
        *cut.columns, F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids. A sequence holds at most
    `capacity` pieces, so the group is bounded."""

    ordered = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    glued = F.unhex(F.array_join(F.transform("_rows", lambda r: r["ids"]), ""))
    return packed.groupBy("sequence_id").agg(ordered.alias("_rows")).select("sequence_id", glued.alias("ids"))
