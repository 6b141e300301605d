"""Removal of long repeated passages by a logarithmic family of sparse suffix arrays.

Goal: the bytes covered by a `least`-byte string (400 here) that also starts anywhere else.

*Places.* Suffixes are indexed at places that the text itself chooses: a place is where the
hash of the next 16 bytes is no greater than at any of the next 48 places. That is decided by
the 64 bytes that follow, so equal strings hold equal places.
*Index.* Per place the longest match with any other place is wanted. In sorted order it is the
match with a neighbour. New batches of documents are sorted by what follows their places, then
merge-scanned with each existing level; two levels of equal size are merged into one of twice
the size, so an index of n batches has at most log n levels. Before that, places whose next 160
bytes occur once in the corpus are left out, and equal contexts are one entry with a count. An
entry holds what follows its first 160 bytes; their hash stands for those.
*Edges.* The end of the longest match never falls as one goes right in a text. So what lies
between two places is settled by them, except where matches begin and end: only the windows
there, and windows without a place, are hashed and counted, each on its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.llm.common import discard, scratch, stored

LEAST, GRAM, SPREAD = 400, 16, 48
PREFIX = GRAM + SPREAD
#: A place is looked up by the hash of so many bytes. Windows whose first place is too near
#: their end to hold them (under one in a hundred) are compared each on its own.
KEY = 160
CONTEXT = LEAST + 2 * SPREAD
BATCHES = 4

_rng = np.random.default_rng(16)
BYTE_HASH = _rng.integers(1, 2**63, 256, dtype=np.uint64)
STEP = _rng.integers(1, 2**62, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def places(data: np.ndarray) -> np.ndarray:
    """Places of a text's bytes."""
    if len(data) < PREFIX:
        return np.zeros(0, np.int64)
    h = BYTE_HASH[data]
    for i in range(4):
        w = 1 << i
        h = h[:-w] * STEP[i] + h[w:]
    h ^= h >> np.uint64(31)
    h = ((h * STEP[4]) >> np.uint64(32)).astype(np.uint32)
    low = h
    for w in (1, 2, 4, 8, 16):  # least of 32 in a row
        low = np.minimum(low[:-w], low[w:])
    n = len(h) - SPREAD
    ahead = np.minimum(low[1 : n + 1], low[17 : n + 17])
    return np.flatnonzero(h[:n] <= ahead)


def _hash(data: memoryview) -> int:
    return xxhash.xxh3_64_intdigest(data) - 2**63


def _hashes(view: memoryview, starts: list[int], stops: list[int]) -> np.ndarray:
    """`_hash` of many stretches of a text."""
    digest = xxhash.xxh3_64_intdigest
    found = np.array([digest(view[a:b]) for a, b in zip(starts, stops, strict=True)], np.uint64)
    return (found ^ np.uint64(1 << 63)).view(np.int64)


def _bytes_of(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t.encode() for t in column.to_pylist()]


def _lists(column: pa.Array) -> list[np.ndarray]:
    """Rows of a list column as arrays; a null list is empty."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    if column.null_count:  # flattening skips what null rows may hold
        sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
        ends = np.concatenate([[0], np.cumsum(sizes)])
    return np.split(flat, (ends - ends[0])[1:-1])


class _Out:
    """Columns made piece by piece."""

    def __init__(self, width: int):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(width)]
        self.rows = 0

    def add(self, *columns) -> None:
        n = next(len(c) for c in columns if isinstance(c, np.ndarray))
        for part, c in zip(self.parts, columns, strict=True):
            part.append(c if isinstance(c, np.ndarray) else np.full(n, c))
        self.rows += n

    def columns(self) -> list[np.ndarray]:
        return [np.concatenate(p) if p else np.zeros(0, np.int64) for p in self.parts]


def _map(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow whose function yields tuples of columns per batch."""
    import pyspark.sql.types as T

    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(),
             "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    types = [kinds[f.dataType.simpleString()] for f in T.StructType.fromDDL(schema).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in function(batch):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
                )

    return df.mapInArrow(run, schema)


def _found_places(batch: pa.RecordBatch):
    out = _Out(3)
    for d, data in zip(batch.column(0).to_pylist(), _bytes_of(batch.column(1)), strict=True):
        if len(data) < LEAST:
            continue
        at = places(np.frombuffer(data, np.uint8))
        at = at[at + KEY <= len(data)]
        out.add(d, at, _hashes(memoryview(data), at.tolist(), (at + KEY).tolist()))
        if out.rows > 500_000:
            yield out.columns()
            out = _Out(3)
    yield out.columns()


def _contexts(batch: pa.RecordBatch):
    """Context hashes of listed places."""
    out = _Out(5)
    for d, data, at in zip(batch.column(0).to_pylist(), _bytes_of(batch.column(1)), _lists(batch.column(2)), strict=True):
        view, stops = memoryview(data), np.minimum(at + CONTEXT, len(data))
        starts = at.tolist()
        out.add(d, at, _hashes(view, starts, (at + KEY).tolist()), _hashes(view, starts, stops.tolist()), stops - at)
    yield out.columns()


def _context_bytes(batch: pa.RecordBatch):
    out = ([], [], [], [])
    for d, text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
        data = text.encode()
        for p in at:
            row = (d, p, _hash(memoryview(data)[p : p + KEY]), data[p + KEY : p + CONTEXT])
            for column, value in zip(out, row, strict=True):
                column.append(value)
    yield out


def _common(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Length of the common prefix of each two."""
    if not a:
        return np.zeros(0, np.int64)
    sizes = np.minimum([len(x) for x in a], [len(x) for x in b])
    width = CONTEXT - KEY
    x, y = (np.frombuffer(b"".join(s.ljust(width, b"\0") for s in side), np.uint8).reshape(-1, width) for side in (a, b))
    differ = x != y
    first = np.where(differ.any(1), differ.argmax(1), width)
    return np.minimum(first, sizes)


class SuffixFamily:
    """Levels of sorted suffixes; level r holds 2^r batches. Every scan is kept as a stored
    table (key, context, doc, pos, common: the longest prefix shared with a neighbour)."""

    def __init__(self) -> None:
        self.levels: dict[int, DataFrame] = {}
        self.matches: list[DataFrame] = []
        self.tables: list[DataFrame] = []

    def _scan(self, rows: DataFrame) -> DataFrame:
        """Sort and scan. Partitions are ranges, so that a prefix that very many suffixes share
        is split; the two end rows of each partition meet their neighbours afterwards."""

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, last, first = TaskContext.get().partitionId(), None, True
            for batch in batches:
                for at in range(0, len(batch), 4096):
                    some = batch.slice(at, 4096).to_pydict()
                    context = some["context"]
                    if last is not None:
                        ahead = shared(last["key"], last["context"], some["key"][0], context[0])
                        yield emit(last, part, first, False, ahead)
                        first = False
                    else:
                        ahead = 0
                    keys = np.array(some["key"])
                    near = np.where(keys[1:] == keys[:-1], _common(context[:-1], context[1:]) + KEY, 0)
                    common = np.maximum(np.concatenate([[ahead], near]), np.concatenate([near, [0]]))
                    n = len(context) - 1
                    if n:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(some["key"][:n], pa.int64()), pa.array(context[:n], pa.binary()),
                             pa.array(some["doc"][:n], pa.int64()), pa.array(some["pos"][:n], pa.int32()),
                             pa.array(common[:n], pa.int64()), pa.array([part] * n, pa.int32()),
                             pa.array([first] + [False] * (n - 1)), pa.array([False] * n)], names=names)
                        first = False
                    last = {k: some[k][n] for k in ("key", "context", "doc", "pos")} | {"ahead": int(common[n])}
            if last is not None:
                yield emit(last, part, first, True, 0)

        def shared(key_a: int, a: bytes, key_b: int, b: bytes) -> int:
            return KEY + int(_common([a], [b])[0]) if key_a == key_b else 0

        def emit(row: dict, part: int, first: bool, end: bool, after: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([row["key"]], pa.int64()), pa.array([row["context"]], pa.binary()),
                 pa.array([row["doc"]], pa.int64()), pa.array([row["pos"]], pa.int32()),
                 pa.array([max(row["ahead"], after)], pa.int64()), pa.array([part], pa.int32()),
                 pa.array([first]), pa.array([end])], names=names)

        names = ["key", "context", "doc", "pos", "common", "part", "is_first", "is_last"]
        schema = ("key bigint, context binary, doc bigint, pos int, common bigint, part int, "
                  "is_first boolean, is_last boolean")
        ordered = rows.repartitionByRange("key", "context").sortWithinPartitions("key", "context", "doc", "pos")
        level = stored(ordered.select("key", "context", "doc", "pos").mapInArrow(scan, schema), "suffix-level")
        self.tables.append(level)
        self.matches.append(level.select("doc", "pos", "common"))
        ends = level.filter("is_first or is_last").select("part", "is_first", "is_last", "key", "context", "doc", "pos")
        ends = sorted(ends.collect(), key=lambda r: (r["part"], not r["is_first"]))  # two rows a partition
        edge = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            if a["part"] != b["part"]:
                common = shared(a["key"], bytes(a["context"]), b["key"], bytes(b["context"]))
                edge += [(r["doc"], r["pos"], common) for r in (a, b)]
        if edge:
            self.matches.append(rows.sparkSession.createDataFrame(edge, "doc bigint, pos int, common bigint"))
        return level.select("key", "context", "doc", "pos")

    def add(self, batch: DataFrame) -> None:
        """Put a batch (key, context, doc, pos) in: it is scanned with every level, and merged
        with levels of its size."""
        rank, own = 0, batch
        for r in sorted(self.levels):
            merged = self._scan(own.unionByName(self.levels[r]))
            if r == rank:
                del self.levels[r]
                own, rank = merged, rank + 1
        if rank == 0 and not self.levels:
            own = self._scan(own)
        self.levels[rank] = own

    def longest(self) -> DataFrame:
        """doc, pos, common: the longest match of each indexed suffix with any other."""
        rows = self.matches[0]
        for more in self.matches[1:]:
            rows = rows.unionByName(more)
        return rows.groupBy("doc", "pos").agg(F.max("common").alias("common"))


def _gaps(size: int, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of window starts that may repeat in a text of `size` bytes with places `at`:
    start, stop, the place they lead to (-1 if the windows hold none), and whether one is open,
    that is, not settled by the longest matches `length` (0: none) at the places around: a
    window is known to repeat if it ends within a match that began at an earlier place, or if
    it begins at a place whose match is long enough."""
    last = size - LEAST
    start = np.concatenate([[0], at + 1])
    lower = np.maximum.accumulate(np.concatenate([[0], np.where(length > 0, at + length, 0)]))
    stop = np.append(np.minimum(at, last), last)
    # Windows that hold no place, before each place and behind the last one.
    bare = np.append(np.minimum(stop[:-1], at - LEAST + KEY - 1), last)
    some = bare >= start
    # No window right of `upper` - LEAST repeats: matches shorter than KEY are not known.
    upper = np.where(length >= CONTEXT, size, np.maximum(at + length, at + KEY - 1))
    first, final = np.maximum(start[:-1], bare[:-1] + 1), np.minimum(stop[:-1], upper - LEAST)
    rest = first <= final
    is_open = np.maximum(first, lower[:-1] - LEAST + 1) <= np.minimum(final, at - 1)
    return (
        np.concatenate([start[some], first[rest]]),
        np.concatenate([bare[some], final[rest]]),
        np.concatenate([np.full(int(some.sum()), -1), at[rest]]),
        np.concatenate([bare[some] + LEAST > lower[some], is_open[rest]]),
    )


def _open_gaps(batch: pa.RecordBatch):
    """Stretches with windows that may repeat: doc, start, stop, key of the place they lead to
    (0: no place), hash of all their bytes, whether a window of them is open."""
    out = _Out(6)
    rows = zip(batch.column(0).to_pylist(), _bytes_of(batch.column(1)), _lists(batch.column(2)), _lists(batch.column(3)), strict=True)
    for d, data, at, size in rows:
        if len(data) < LEAST:
            continue
        found = places(np.frombuffer(data, np.uint8))
        length = np.zeros(len(found), np.int64)
        length[np.searchsorted(found, at)] = size
        start, stop, place, is_open = _gaps(len(data), found, length)
        view = memoryview(data)
        key = np.zeros(len(place), np.int64)
        led = place >= 0
        key[led] = _hashes(view, place[led].tolist(), (place[led] + KEY).tolist())
        out.add(d, start, stop, key, _hashes(view, start.tolist(), (stop + LEAST).tolist()), is_open)
        if out.rows > 500_000:
            yield out.columns()
            out = _Out(6)
    yield out.columns()


def _windows(batch: pa.RecordBatch):
    """Hashes of the windows of listed stretches: hash, doc, pos, copies."""
    out = _Out(4)
    rows = zip(batch.column(0).to_pylist(), _bytes_of(batch.column(1)), *map(_lists, batch.columns[2:5]), strict=True)
    for d, data, starts, stops, copies in rows:
        sizes = stops.astype(np.int64) - starts + 1
        ends = np.cumsum(sizes)
        at = np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        out.add(_hashes(memoryview(data), at.tolist(), (at + LEAST).tolist()), d, at, np.repeat(copies, sizes))
        if out.rows > 300_000:
            yield out.columns()
            out = _Out(4)
    yield out.columns()


def _with_lists(held: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Documents with the rows that name them, as arrays (bounded by a document's length)."""
    lists = [F.collect_list(c).alias(c) for c in columns]
    return held.join(rows.groupBy("doc").agg(*lists), "doc")


def repeated(docs: DataFrame, batches: int = BATCHES, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents (doc, text; bucketed by doc) and the start and end of all byte spans
    (doc, start, stop; they may overlap) that a string of `LEAST` bytes covers which also
    starts elsewhere in `docs`, the same document included.

    Null text is empty and matches nothing; rows without a key are left out. Rows that repeat
    a key must be copies of one row; they count as one document.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"suffix_docs_{uuid.uuid4().hex}"
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartition(parts, "doc").dropDuplicates(["doc"])
    # A bucketed table is only known by name; its files are ours, so the name can go at once.
    files = rows.write.option("compression", "zstd").option("path", scratch(spark, "suffix-docs"))
    files.bucketBy(parts, "doc").sortBy("doc").saveAsTable(name)
    held = spark.table(name)
    spark.sql(f"DROP TABLE {name}")

    found = stored(_map(held.select("doc", "text"), _found_places, "doc bigint, pos int, key bigint"), "suffix-places")
    often = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    listed = _with_lists(held, found.join(often, "key", "left_semi"), ["pos"])
    hashed = stored(_map(listed, _contexts, "doc bigint, pos int, key bigint, context bigint, length int"), "suffix-contexts")

    discard(found)
    same = hashed.groupBy("key", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "pos")).alias("one"))
    same = stored(same, "suffix-same")
    contested = same.groupBy("key").agg(F.count(F.lit(1)).alias("d")).filter("d > 1").select("key")
    entries = same.join(contested, "key", "left_semi").select("one.doc", "one.pos")
    indexed = stored(_map(_with_lists(held, entries, ["pos"]), _context_bytes, "doc bigint, pos int, key bigint, context binary"), "suffix-entries")
    family = SuffixFamily()
    for b in range(batches):
        family.add(indexed.filter(F.pmod(F.xxhash64("doc"), F.lit(batches)) == b).select("key", "context", "doc", "pos"))
    copied = hashed.join(same.filter("n > 1").select("key", "context"), ["key", "context"], "left_semi")
    length = copied.select("doc", "pos", F.col("length").alias("common")).unionByName(
        family.longest().select("doc", "pos", F.col("common").cast("int").alias("common")).filter(F.col("common") >= KEY))
    length = stored(length.groupBy("doc", "pos").agg(F.max("common").alias("common")), "suffix-longest")

    for done in (hashed, same, indexed, *family.tables):
        discard(done)
    lists = length.groupBy("doc").agg(F.collect_list("pos").alias("pos"), F.collect_list("common").alias("common"))
    gaps = stored(_map(
        held.join(lists, "doc", "left").select("doc", "text", "pos", "common"), _open_gaps,
        "doc bigint, start int, stop int, key bigint, whole bigint, is_open boolean"), "suffix-gaps")
    # A stretch that repeats as a whole is settled, and one copy of it stands for all.
    wanted = gaps.filter("is_open").select("key").distinct()
    groups = gaps.join(wanted, "key", "left_semi").groupBy("whole").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc", "start", "stop")).alias("one"))
    groups = stored(groups, "suffix-groups")
    whole = gaps.filter("is_open").join(groups.filter("copies > 1").select("whole"), "whole", "left_semi")
    ones = groups.select("one.*", F.least("copies", F.lit(2)).cast("int").alias("copies"))
    windows = stored(_map(_with_lists(held, ones, ["start", "stop", "copies"]), _windows, "hash bigint, doc bigint, pos int, copies int"), "suffix-windows")
    twice = windows.groupBy("hash").agg(F.sum("copies").alias("n")).filter("n > 1").select("hash")
    spans = (
        length.filter(F.col("common") >= LEAST).select("doc", F.col("pos").alias("start"), (F.col("pos") + F.col("common")).alias("stop"))
        .unionByName(whole.select("doc", "start", (F.col("stop") + LEAST).alias("stop")))
        .unionByName(windows.join(twice, "hash", "left_semi").select("doc", F.col("pos").alias("start"), (F.col("pos") + LEAST).alias("stop")))
    )
    return held, spans


def _merged(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Spans that overlap or touch as one: rows of start and stop."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    gap = starts[1:] > stops[:-1]
    return np.column_stack([starts[np.append(True, gap)], stops[np.append(gap, True)]])


def deduplicated(docs: DataFrame, batches: int = BATCHES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: `key`, n_bytes, spans (removed runs, start and stop), kept (the remaining
    bytes in a row; cut inside a character they need not be valid UTF-8) and kept_text (the
    same without the broken characters at cuts)."""
    held, spans = repeated(docs, batches, key, text)
    lists = spans.groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))

    def remove(batch: pa.RecordBatch):
        out = ([], [], [], [], [])
        rows = zip(batch.column(0).to_pylist(), _bytes_of(batch.column(1)), _lists(batch.column(2)), _lists(batch.column(3)), strict=True)
        for d, data, starts, stops in rows:
            flat = _merged(starts, stops).ravel().tolist()
            edges = [0, *flat, len(data)]
            rest = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            for column, value in zip(out, (d, len(data), flat, rest, rest.decode("utf-8", "ignore")), strict=True):
                column.append(value)
        yield out

    made = _map(held.join(lists, "doc", "left").select("doc", "text", "starts", "stops"), remove,
                "doc bigint, n_bytes bigint, spans array<int>, kept binary, kept_text string")
    return made.withColumnRenamed("doc", key)
