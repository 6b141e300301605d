"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import gc
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quizlake.session import get_file, put_file, scratch  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet on the shared store and read again: later jobs, and tasks
    that repeat after a lost executor, start from these files."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a `stored` table that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a text column; null counts as the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


BLOCK_BYTES = 8 << 20


def text_blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[pa.Array]:
    """Slices of a text column (null becomes empty) of about `size` bytes, so that what is
    built from a slice stays small; one longer text is a slice of its own."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
        yield column.slice(at, stop - at)
        at = stop


class WordRows:
    """Texts of a block as rows of words, each distinct word once: `words` are the distinct
    ones, `at` their numbers in text order, `ends` the end of each text in `at`."""

    def __init__(self, lists: pa.Array):
        coded = lists.flatten().dictionary_encode()
        self.words: list[str] = coded.dictionary.to_pylist()
        self.at = coded.indices.to_numpy()
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        self.ends = np.cumsum(lengths, dtype=np.int64)
        self.lengths = lengths

    def replace_first(self, make: Callable[[str], bytes], rows: list[bytes]) -> None:
        """Give the first word of each text a row of ids of its own."""
        full = self.lengths > 0
        places = (self.ends - self.lengths)[full]
        heads, number = np.unique(self.at[places], return_inverse=True)
        self.at = self.at.copy()
        self.at[places] = len(rows) + number
        rows.extend(make(self.words[h]) for h in heads)

    def ids(self, rows: list[bytes]) -> list[np.ndarray]:
        """Ids of every text, from the ids of its words."""
        sizes = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(rows), np.int32)
        size = sizes[self.at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(starts[self.at] - (ends - size), size) + np.arange(total)
        values = flat[take]
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], self.ends])]
        return [values[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def int_lists(rows: list) -> pa.Array:
    """An Arrow array<int> column from rows that hold 32-bit integers."""
    ends = np.cumsum([0, *map(len, rows)])
    if ends[-1] > np.iinfo(np.int32).max:
        raise ValueError("a batch holds more than 2^31 ids: lower spark.sql.execution.arrow.maxBytesPerBatch")
    values = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


@contextlib.contextmanager
def paused_gc():
    """Without cyclic garbage collection: building many small lists would start it again and
    again over the word caches."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


class WordCache(dict):
    """Remembers `make(word)` for recent words in bounded memory: two generations of at most
    `limit` words; a word of more than `longest` characters is made anew each time."""

    def __init__(self, make: Callable[[str], Any], limit: int = 250_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest
        self.old: dict[str, Any] = {}

    def __missing__(self, word: str) -> Any:
        if len(word) > self.longest:
            return self.make(word)
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value
