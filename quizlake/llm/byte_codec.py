"""Byte-level BPE encoding in overlapping chunks, and decoding.

*Pre-tokens.* A pattern cuts a text into pre-tokens, each starting where the one before ends,
and what it finds at a place depends on the text from there on alone. So a text is cut into
chunks that overlap, and all chunks are cut into pre-tokens in parallel, each as if it began
with one. Where a boundary of a chunk is also one of the next chunk, both go on alike: there
they are stitched, and what either holds on the wrong side of the seam is dropped. The last
boundaries of a chunk, which the text behind it might change, do not count. A text in which
some neighbours share no boundary (a run longer than the overlap) is cut as one chunk.

*Pieces.* Pre-tokens are encoded on their own, each distinct one once per block: all new ones
of a block go through the merges together, one merge per pre-token and turn, in numpy.

*Decoding.* The raw bytes of the ids, one after another.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from quizlake.llm.common import paused_gc, stored, text_blocks

#: Characters of a chunk, and what it shares with the next one.
CHUNK, OVERLAP = 16_384, 1_024
#: What the pattern finds is decided by the match and so many characters behind it.
LOOK_AHEAD = 3
KEPT, LONG = 120_000, 64
BLOCK_BYTES = 1 << 20


@lru_cache(2)
def newer_letters(pattern: str) -> dict[str, str]:
    """Letters (L) and numbers (N) of Python's `regex` that the library's older Unicode does not
    have, as ranges of a character set. It is asked about those alone that Python's own
    tables do not have either: is such a character kept together with one of its class?"""
    everything = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    found = {}
    for kind, first in (("L", "a"), ("N", "1")):
        new = [c for c in regex.findall(rf"\p{{{kind}}}", everything) if unicodedata.category(c) == "Cn"]
        ranks = {bytes([b]): b for b in range(256)} | {(first + c).encode(): 256 + i for i, c in enumerate(new)}
        library = tiktoken.Encoding("pairs", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        spans: list[list[int]] = []
        for c in new:
            if len(library.encode_ordinary(first + c)) > 1:
                if spans and spans[-1][1] == ord(c) - 1:
                    spans[-1][1] = ord(c)
                else:
                    spans.append([ord(c), ord(c)])
        found[kind] = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)
    return found


class Splitter:
    """Pre-tokens of texts as the library cuts them."""

    def __init__(self, pattern: str, newer: dict[str, str]):
        # The library's idea of white space is Unicode's; Python adds some control characters.
        pattern = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.find = self.exact = regex.compile(pattern).findall
        self.newer = np.zeros(sys.maxunicode + 1, bool)
        for kind, spans in newer.items():
            if spans:
                pattern = pattern.replace(rf"\p{{{kind}}}", rf"[\p{{{kind}}}--[{spans}]]")
                for a, b in regex.findall(r"U(\w{8})-\\U(\w{8})", spans):
                    self.newer[int(a, 16) : int(b, 16) + 1] = True
        if self.newer.any():
            self.exact = regex.compile(pattern, regex.V1).findall

    def __call__(self, text: str) -> list[str]:
        if not text.isascii():
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            if self.newer[codes].any():
                return self.exact(text)
        return self.find(text)


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of ranks: lines of base64 bytes and rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    return {base64.b64decode(token): int(r) for token, r in pairs}


def token_bytes(rank: dict[bytes, int]) -> list[bytes]:
    """The bytes of every id."""
    out = [b""] * (max(rank.values()) + 1)
    for token, r in rank.items():
        out[r] = token
    return out


class ByteDecoder:
    """The raw bytes of ids, one after another, by a table."""

    def __init__(self, ranks: str):
        token = token_bytes(read_ranks(ranks))
        self.lengths = np.fromiter(map(len, token), np.int64, len(token))
        self.places = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(token), np.uint8)

    def decode(self, ids: bytes) -> bytes:
        at = np.frombuffer(ids, np.uint32)
        sizes = self.lengths[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.repeat(self.places[at] - ends + sizes, sizes) + np.arange(total)].tobytes()


class ByteCodec:
    """Encoder of one file of ranks."""

    def __init__(self, ranks: str, pattern: str, newer: dict[str, str]):
        self.rank = rank = read_ranks(ranks)
        self.split = Splitter(pattern, newer)
        self.token = token_bytes(rank)
        size = len(self.token)
        self.size = np.int64(size)
        self.byte = np.array([rank[bytes([b])] for b in range(256)], np.int64)
        # Every way to put a token together from two, as left * size + right.
        made = [
            (rank[token[:i]] * size + rank[token[i:]], r)
            for token, r in rank.items()
            for i in range(1, len(token))
            if token[:i] in rank and token[i:] in rank
        ]
        made = np.array(sorted(made), np.int64).reshape(-1, 2)
        self.pair, self.made = made[:, 0].copy(), made[:, 1].copy()
        two = np.arange(1 << 16)
        self.bigram = self._ranks(self.byte[two >> 8] * size + self.byte[two & 255])
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def boundaries(self, text: str) -> np.ndarray:
        """Ends of the pre-tokens of a text."""
        return np.cumsum([len(t) for t in self.split(text)], dtype=np.int64)

    def _ranks(self, pairs: np.ndarray) -> np.ndarray:
        """Ranks of what pairs make; `size` for those that make no token."""
        at = np.minimum(np.searchsorted(self.pair, pairs), len(self.pair) - 1)
        return np.where(self.pair[at] == pairs, self.made[at], self.size)

    def _merged(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of at most `LONG` bytes: in each turn the lowest-ranked pair of every
        piece, the leftmost among equals, becomes one token."""
        done: list[bytes] = [b""] * len(pieces)
        size = self.size
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ids, name = self.byte[raw], np.arange(len(pieces))
        # The rank of each id with the next one; none across pieces.
        ranks = np.append(self.bigram[(raw[:-1].astype(np.int64) << 8) | raw[1:]], size) if len(raw) else ids
        if len(name):
            ranks[np.cumsum(sizes) - 1] = size
        while len(name):
            ends = np.cumsum(sizes)
            least = np.minimum.reduceat(ranks, ends - sizes)
            still = least < size
            if not still.all():
                flat, stops, starts = ids.astype(np.uint32).tobytes(), (4 * ends).tolist(), (4 * (ends - sizes)).tolist()
                for i in np.flatnonzero(~still).tolist():
                    done[name[i]] = flat[starts[i] : stops[i]]
            hits = np.flatnonzero((ranks == np.repeat(least, sizes)) & (ranks < size))
            owner = np.searchsorted(ends, hits, "right")
            first = np.append(True, owner[1:] != owner[:-1]) if len(hits) else np.zeros(0, bool)
            hits, owner = hits[first], owner[first]
            ids[hits] = least[owner]
            ranks[hits] = ranks[hits + 1]  # whether there is a pair is what its right half knew
            keep = np.repeat(still, sizes)
            keep[hits + 1] = False
            place = np.cumsum(keep) - 1
            ids, ranks, sizes, name = ids[keep], ranks[keep], sizes[still] - 1, name[still]
            hits, ends = place[hits], np.cumsum(sizes)
            right = hits[hits != ends - 1]
            left = hits[hits != ends - sizes] - 1
            for at in (right, left):
                ranks[at] = self._ranks(ids[at] * size + ids[at + 1])
        return done

    def _long(self, piece: bytes) -> bytes:
        """Ids of one long piece: a queue of pairs over a linked list, n log n."""
        ids, n, rank, token = [self.rank[piece[i : i + 1]] for i in range(len(piece))], len(piece), self.rank, self.token
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]

        def pair(i: int) -> tuple[int, int, int, int] | None:
            j = after[i]
            r = rank.get(token[ids[i]] + token[ids[j]]) if j >= 0 else None
            return None if r is None else (r, i, ids[i], ids[j])

        queue = [p for p in map(pair, range(n)) if p]
        heapq.heapify(queue)
        while queue:
            r, i, left, right = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # one of the two has been merged since
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                found = pair(k) if k >= 0 else None
                if found:
                    heapq.heappush(queue, found)
        return np.array([t for t in ids if t >= 0], np.uint32).tobytes()

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Put the new ones of distinct pre-tokens into the memory; returns a table of all of
        them. Long ones are not remembered, as they may be of any size."""
        if len(self.kept) > KEPT:
            self.kept, self.old = {}, self.kept
        kept, old, rank = self.kept, self.old, self.rank
        names, short, more = [], [], {}
        for w in words - kept.keys():
            ids = old.get(w)
            if ids is None:
                raw = w.encode("utf-8", "replace")
                if raw in rank:  # a whole token stands for itself
                    ids = np.uint32(rank[raw]).tobytes()
                elif len(raw) > LONG:
                    more[w] = self._long(raw)
                    continue
                else:
                    names.append(w)
                    short.append(raw)
                    continue
            kept[w] = ids
        kept.update(zip(names, self._merged(short), strict=True))
        return kept | more if more else kept

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts (or stretches between boundaries), as little-endian unsigned
        32-bit integers; new pre-tokens of all of them are encoded together."""
        rows = [self.split(t) for t in texts]
        known = self._learn(set().union(*rows)).__getitem__
        return [b"".join(map(known, r)) for r in rows]


_codecs: dict[tuple, ByteCodec] = {}


def codec(ranks: str, pattern: str, newer: dict[str, str]) -> ByteCodec:
    """One codec, with its memory of words, per Python worker."""
    name = (ranks, pattern, *newer.items())
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = ByteCodec(ranks, pattern, newer)
    return _codecs[name]


def _chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Rows (doc, key, text) as chunks: doc, key, no, start, last, part."""
    key_type = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                text = batch.column(2)[i].as_py()
                starts = list(range(0, max(1, len(text) - overlap), chunk))
                for at in range(0, len(starts), 64):
                    some = starts[at : at + 64]
                    m = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[i].as_py()] * m, pa.int64()), pa.array([batch.column(1)[i].as_py()] * m, batch.schema.field(1).type),
                         pa.array([s // chunk for s in some], pa.int64()), pa.array([s == starts[-1] for s in some]),
                         pa.array([text[s:] if s == starts[-1] else text[s : s + chunk + overlap] for s in some], pa.string())],
                        names=["doc", "key", "no", "last", "part"])

    return docs.select("doc", "key", "text").mapInArrow(run, f"doc bigint, key {key_type}, no bigint, last boolean, part string")


def _pretokens(chunks: DataFrame, codec_of: tuple, chunk: int, overlap: int) -> DataFrame:
    """`chunks` with `head` and `tail`: the boundaries in the stretch shared with the chunk
    before and with the one after, counted from the start of that stretch."""
    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*codec_of)
        for batch in batches:
            heads, tails = [], []
            for last, part in zip(batch.column("last").to_pylist(), batch.column("part").to_pylist(), strict=True):
                ends = np.concatenate([[0], c.boundaries(part)])
                sure = ends if last else ends[ends <= len(part) - LOOK_AHEAD]
                heads.append(sure[sure < overlap].tolist())
                tails.append([] if last else (sure[sure >= chunk] - chunk).tolist())
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (heads, tails)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, "head", "tail"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in chunks.columns)
    return chunks.mapInArrow(run, f"{schema}, head array<int>, tail array<int>")


def _encoded(rows: DataFrame, codec_of: tuple, block: int = BLOCK_BYTES) -> DataFrame:
    """The first columns of `rows` and, for its last one (text), ids."""
    names = rows.columns[:-1]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*codec_of)
        for batch in batches:
            at = 0
            for some in text_blocks(batch.columns[-1], block):
                with paused_gc():
                    ids = c.encode(some.to_pylist())
                first = [col.slice(at, len(some)) for col in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*first, pa.array(ids, pa.binary())], names=[*names, "ids"])
                at += len(some)

    schema = ", ".join(f"{c} {kinds[c]}" for c in names)
    return rows.mapInArrow(run, f"{schema}, ids binary")


@lru_cache(2)
def decoder(ranks: str) -> ByteDecoder:
    return ByteDecoder(ranks)


def decoded(ids: Column, ranks: str) -> Column:
    """The raw bytes that ids stand for, one after another."""

    @F.arrow_udf(BinaryType())
    def decode(column: pa.Array) -> pa.Array:
        c = decoder(ranks)
        return pa.array([None if i is None else c.decode(i) for i in column.to_pylist()], pa.binary())

    return decode(ids)


@F.arrow_udf(BinaryType())
def _joined(parts: pa.Array) -> pa.Array:
    return pa.array([b"".join(p) for p in parts.to_pylist()], pa.binary())


def coded(
    docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """`key`, ids (little-endian unsigned 32-bit integers) and decoded bytes of every whole text.

    Null text counts as empty, which has no ids. Every row gives one row, whatever its key:
    null and repeated keys too. A text of up to `chunk` characters is one chunk, which needs no
    stitching; longer ones are spread over the cluster chunk by chunk. Other columns of `docs`
    play no part; an empty table gives an empty one.
    """
    if not 0 < overlap < chunk:
        raise ValueError("the overlap must be shorter than a chunk")
    codec_of = (ranks, pattern, newer_letters(pattern))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    short = _encoded(rows.filter(F.length("text") <= chunk), codec_of)

    long = rows.filter(F.length("text") > chunk).withColumn("doc", F.monotonically_increasing_id())
    parts = _chunks(long, chunk, overlap)
    spread = parts.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc", "no")
    parts = stored(_pretokens(spread, codec_of, chunk, overlap), "byte-pretokens")
    # Seams from narrow rows: the first boundary that a chunk shares with the next one.
    order, whole = Window.partitionBy("doc").orderBy("no"), Window.partitionBy("doc")
    shared = F.array_min(F.array_intersect("tail", F.lead("head").over(order)))
    seams = parts.select("doc", "no", "last", shared.alias("seam"))
    fits = F.min(F.col("last") | F.col("seam").isNotNull()).over(whole)
    seams = seams.select("doc", "no", "seam", F.lag("seam").over(order).alias("begin"), fits.alias("fits"))
    cut = parts.select("doc", "key", "no", "last", "part").join(seams, ["doc", "no"])
    begin = F.coalesce("begin", F.lit(0))
    end = F.coalesce(F.col("seam") + chunk, F.length("part"))
    stitched = cut.filter("fits").select("doc", "key", "no", F.substr("part", begin + 1, end - begin).alias("part"))
    # A text whose chunks do not all fit is put together again, without the overlaps.
    own = F.when(F.col("last"), F.col("part")).otherwise(F.substr("part", F.lit(1), F.lit(chunk)))
    unfit = cut.filter("not fits").select("doc", "key", "no", own.alias("part"))
    unfit = unfit.groupBy("doc").agg(F.first("key").alias("key"), F.sort_array(F.collect_list(F.struct("no", "part"))).alias("parts"))
    unfit = unfit.select("doc", "key", F.lit(0).cast("bigint").alias("no"), F.array_join("parts.part", "").alias("part"))
    pieces = _encoded(stitched.unionByName(unfit), codec_of)
    grouped = pieces.groupBy("doc").agg(F.first("key").alias("key"), F.sort_array(F.collect_list(F.struct("no", "ids"))).alias("p"))
    ids = short.unionByName(grouped.select("key", _joined(F.col("p.ids")).alias("ids")))
    return ids.select(F.col("key").alias(key), "ids", decoded(F.col("ids"), ranks).alias("decoded"))
