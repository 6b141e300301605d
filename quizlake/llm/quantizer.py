"""Codes for vectors: a codebook of up to 256 entries per part of a vector, by Lloyd's rounds
over whole numbers, so that every distance and every mean is exact.

*Active entries.* A block of vectors keeps, per part, the entry it was assigned and the exact
squared distance to it. After a round the entries that moved are known. A part whose own entry
stayed where it was compares that distance with the moved entries only: among the others its
entry is still the nearest, and still the first of the nearest. A part whose entry moved
compares all entries anew. So later rounds, where few entries move, cost little.

Blocks are rewritten each round with their new codes (the values are read for the distances
anyway) and with the sums and counts of their parts per entry. Only those sums, added up by
Spark, reach the driver: one row per number of the codebooks, whatever the number of vectors.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.llm.common import discard, stored
from quizlake.llm.vectors import matrix

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024.0
ROWS = 8192
#: Below this all sums of products are exact in doubles; beyond it Python integers are used.
EXACT = 2.0**53
LARGE = 2**63


def whole(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * values) as 64-bit integers."""
    scaled = np.floor(values * scale)
    if (np.abs(scaled) >= LARGE).any():
        raise OverflowError("a component times the scale does not fit 64 bits")
    return scaled.astype(np.int64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of `x` the first of the nearest entries, and the exact squared distance."""
    code, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    if not len(x):
        return code, far
    most = float(np.abs(x).max(initial=0)) + float(np.abs(entries).max(initial=0))
    exact = x.shape[1] * most * most < EXACT
    kind = np.float64 if exact else object
    e = entries.astype(kind)
    norms = (e * e).sum(1)
    step = max(1, (1 << 22) // max(1, len(e) if exact else e.size))
    for at in range(0, len(x), step):
        some = x[at : at + step].astype(kind)
        d = (some * some).sum(1)[:, None] - 2 * (some @ e.T) + norms
        best = d.argmin(1)
        least = d[np.arange(len(some)), best]
        if not exact and (least >= LARGE).any():
            raise OverflowError("a squared distance does not fit 64 bits")
        code[at : at + step], far[at : at + step] = best, least.astype(np.int64)
    return code, far


def reassign(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`nearest` again after the entries `moved`, from what it was before."""
    code, far = code.copy(), far.copy()
    lost = moved[code]
    active = np.flatnonzero(moved)
    if not len(active):
        return code, far
    stay = np.flatnonzero(~lost)
    best, least = nearest(x[stay], entries[active])
    best = active[best]
    better = (least < far[stay]) | ((least == far[stay]) & (best < code[stay]))
    code[stay[better]], far[stay[better]] = best[better], least[better]
    code[lost], far[lost] = nearest(x[lost], entries)
    return code, far


def _sums(x: np.ndarray, code: np.ndarray, entries: int) -> np.ndarray:
    """Componentwise sums of the rows of each entry, as Python integers where 64 bits may not do."""
    order = np.argsort(code, kind="stable")
    used, first = np.unique(code[order], return_index=True)
    rows = x[order]
    if float(np.abs(x).max(initial=0)) * len(x) >= LARGE:
        rows = rows.astype(object)
    sums = np.zeros((entries, x.shape[1]), object)
    if len(used):
        sums[used] = np.add.reduceat(rows, first, axis=0)
    return sums


class Codes:
    """Fitted codebooks (part, entry, component) and the stored blocks with the codes."""

    def __init__(self, codebooks: np.ndarray, blocks: DataFrame, key: str, label: str):
        self.codebooks, self.blocks, self.key, self.label = codebooks, blocks, key, label

    def text(self) -> str:
        """All integers of the codebooks, by part, entry and place, joined by commas."""
        return ",".join(str(v) for v in self.codebooks.ravel().tolist())

    def rows(self) -> DataFrame:
        """key, label, code (hexadecimal, two digits a part) and error of every kept vector."""
        key, label = self.key, self.label
        kinds = {f.name: f.dataType.elementType.simpleString() for f in self.blocks.schema if f.name in ("keys", "labels")}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    keys, labels = batch.column(0)[i].values, batch.column(1)[i].values
                    codes = batch.column(2)[i].as_py().hex()
                    far = np.frombuffer(batch.column(3)[i].as_py(), np.int64).reshape(len(keys), -1)
                    wide = len(codes) // max(1, len(keys))
                    error = far.astype(object).sum(1) if far.max(initial=0) >= LARGE // 64 else far.sum(1)
                    yield pa.RecordBatch.from_arrays(
                        [keys, labels, pa.array([codes[j * wide : (j + 1) * wide] for j in range(len(keys))], pa.string()),
                         pa.array(error, pa.int64())],
                        names=[key, label, "code", "error"])

        schema = f"`{key}` {kinds['keys']}, `{label}` {kinds['labels']}, code string, error bigint"
        return self.blocks.select("keys", "labels", "codes", "far").mapInArrow(run, schema)

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """The integer vectors that rows of codes (n, parts) stand for."""
        return np.concatenate([book[codes[:, p]] for p, book in enumerate(self.codebooks)], axis=1)


def _cut(kept: DataFrame, scale: float, rows: int) -> DataFrame:
    """Kept vectors (key, label, vector) as blocks of at most `rows`, values as integers."""
    types = {f.name: f.dataType.simpleString() for f in kept.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            part = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ints = whole(matrix(part.column(2).combine_chunks()), scale)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(c).combine_chunks()) for c in (0, 1)]
            return pa.RecordBatch.from_arrays(
                [*lists, pa.array([ints.shape[1]]), pa.array([ints.tobytes()], pa.binary())],
                names=["keys", "labels", "width", "ints"])

        for batch in batches:
            at = 0
            while at < len(batch):
                held.append(batch.slice(at, rows - sum(map(len, held))))
                at += len(held[-1])
                if sum(map(len, held)) == rows:
                    yield close()
        if held:
            yield close()

    schema = f"keys array<{types['_key']}>, labels array<{types['_label']}>, width bigint, ints binary"
    return kept.mapInArrow(run, schema)


def _assigned(blocks: DataFrame, books: np.ndarray, moved: np.ndarray | None, width: int) -> DataFrame:
    """Blocks with the codes and distances for these codebooks, and their sums per entry."""
    parts, entries, size = books.shape
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                n = len(row.column("keys")[0].values)
                x = np.frombuffer(row.column("ints")[0].as_py(), np.int64).reshape(n, -1)
                x = np.pad(x, ((0, 0), (0, width - x.shape[1]))).reshape(n, parts, size)
                codes, far = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.int64)
                if moved is not None:
                    old = np.frombuffer(row.column("codes")[0].as_py(), np.uint8).reshape(n, parts)
                    before = np.frombuffer(row.column("far")[0].as_py(), np.int64).reshape(n, parts)
                sums, counts = [], []
                for p in range(parts):
                    if moved is None:
                        code, d = nearest(x[:, p], books[p])
                    else:
                        code, d = reassign(x[:, p], books[p], moved[p], old[:, p].astype(np.int64), before[:, p])
                    codes[:, p], far[:, p] = code, d
                    sums.append(_sums(x[:, p], code, entries).ravel())
                    counts.append(np.bincount(code, minlength=entries))
                # Without an exponent: quantize would round, a plain Decimal of an integer is exact.
                sums = [decimal.Decimal(v) for v in np.concatenate(sums).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [row.column("keys"), row.column("labels"), row.column("width"), row.column("ints"),
                     pa.array([codes.tobytes()], pa.binary()), pa.array([far.tobytes()], pa.binary()),
                     pa.array([sums], pa.list_(pa.decimal128(38, 0))),
                     pa.array([np.concatenate(counts).tolist()], pa.list_(pa.int64()))],
                    names=["keys", "labels", "width", "ints", "codes", "far", "sums", "counts"])

    same = ", ".join(f"{c} {kinds[c]}" for c in ("keys", "labels", "width", "ints"))
    schema = f"{same}, codes binary, far binary, sums array<decimal(38,0)>, counts array<bigint>"
    return blocks.mapInArrow(run, schema)


def _totals(blocks: DataFrame, column: str, size: int) -> np.ndarray:
    """Sums of an array column place by place: as many rows as a codebook has numbers."""
    out = np.zeros(size, object)
    for place, value in blocks.select(F.posexplode(column).alias("at", "v")).groupBy("at").agg(F.sum("v")).collect():
        out[place] = int(value)
    return out


def fit(
    vectors: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE, block_rows: int = ROWS,
) -> Codes:
    """Codebooks and codes of all vectors; those that are null, or hold null or non-finite
    components, are left out.

    The codebooks start from the vectors with the `entries` smallest keys (null keys last, equal
    keys by their components). Shorter vectors (also empty ones) end in zeros, and so do all if
    the parts would not be equal. Repeated rows count each on its own. No vectors give empty codebooks. Numbers
    that do not fit 64 bits raise an error: nothing is rounded or dropped.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry is one byte: 1 to 256 entries")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    kept = vectors.filter(F.col(vector).isNotNull() & ~bad).select(F.col(key).alias("_key"), F.col(label).alias("_label"), F.col(vector).alias("_vector"))
    blocks = stored(_cut(kept, scale, block_rows), "codes-blocks")
    width = -(-(blocks.agg(F.max("width")).first()[0] or 0) // parts) * parts
    first = kept.select("_key", "_vector").orderBy(F.asc_nulls_last("_key"), "_vector").limit(entries).collect()
    start = np.zeros((len(first), width))
    for i, row in enumerate(first):
        start[i, : len(row._vector)] = row._vector
    books = whole(start, scale).reshape(len(first), parts, width // parts).transpose(1, 0, 2)
    moved = None
    for turn in range(rounds + 1):
        done = stored(_assigned(blocks, books, moved, width), "codes-blocks")
        discard(blocks)
        blocks = done
        if turn == rounds or not len(first):
            break
        counts = _totals(blocks, "counts", parts * len(first)).reshape(parts, -1, 1)
        sums = _totals(blocks, "sums", books.size).reshape(books.shape)
        new = np.where(counts > 0, sums // np.maximum(counts, 1), books).astype(np.int64)
        moved, books = (new != books).any(2), new
    return Codes(books, blocks, key, label)


def label_errors(rows: DataFrame, label: str, salts: int = 32) -> DataFrame:
    """`rows` with `label_error`, the sum of error over equal labels (nulls together). A label
    is added up in `salts` shares, and its total goes back to each share, so that rows of one
    very common label stay spread out."""
    by = ["_label", "_none", "_salt"]
    rows = rows.withColumn("_none", F.col(label).isNull()).withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    rows = rows.withColumn("_label", F.coalesce(F.col(label).cast("string"), F.lit("")))
    shares = rows.groupBy(*by).agg(F.sum("error").alias("_sum"))
    totals = shares.groupBy(*by[:2]).agg(F.sum("_sum").alias("label_error"))
    totals = shares.select(*by).join(totals, by[:2])
    return rows.join(totals, by).drop(*by)
