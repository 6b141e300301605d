"""Near-duplicate texts: improved consistent weighted sampling of TF-IDF word shingles.

A text is its shingles of five words, each weighing its count times its inverse document
frequency. A consistent weighted sample picks one shingle per hash so that two texts pick the
same with a probability of their weighted Jaccard similarity; bands of samples give candidate
groups, and every link is verified by the exact weighted Jaccard similarity.

*Frequencies* are counted over all texts in a table of fixed size (a shingle's place is the
head of its hash), and what is rarer than one text in `1 / RARE` weighs as if it were that
frequent. The rarest shingle weighs `1 + SPREAD` times the most frequent one: copies count in
the frequencies, so with a wide range the shingles of a large group would weigh little, edits
much, and its near copies would not link. The table's load per text does not depend on the
number of texts.
*Groups* of candidates are never expanded into pairs of rows. Equal texts are one. First each
group meets one member of it, which joins most near copies. Groups that still hold several
classes are cut into tiles of about `TILE_TEXTS` texts, and pairs of tiles are
compared inside a task, which returns no more links than join their classes. No pair of a
group is left out, so no link is lost, and what is written is linear in the texts of a tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.llm.common import WordRows, stored, text_blocks
from quizlake.llm.components import components

WORDS, SIMILAR = 5, 0.8
#: A pair of similarity 0.8 shares no band with a probability of (1 - 0.8^3)^12, or 0.0002.
BANDS, ROWS = 12, 3
PLACE_BITS, STRIPES = 20, 64
RARE = 1 / 500
#: How much more the rarest shingle weighs than one that all texts hold.
SPREAD = 0.1
TILE_TEXTS = 256
BLOCK = 1 << 20

_rng = np.random.default_rng(7)
#: Random draws of a sample, looked up by 16 bits of a hash: r and c of Gamma(2, 1), b of [0, 1).
DRAW_R = _rng.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
DRAW_C = np.log(_rng.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
DRAW_B = _rng.random(1 << 16).astype(np.float32)
ORDER = _rng.integers(1, 2**62, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SAMPLE = _rng.integers(1, 2**62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted 32-bit shingle hashes of every text, repeats included. Words are runs of letters
    and digits in lower case; a text of fewer than five words is one shingle; none if no word."""
    for block in text_blocks(column, BLOCK):
        plain = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(block), r"[^\pL\pN]+", " "))
        rows = WordRows(pc.if_else(pc.equal(plain, ""), pa.scalar([], pa.list_(pa.large_string())), pc.split_pattern(plain, " ")))
        words = np.fromiter(map(xxhash.xxh3_64_intdigest, rows.words), np.uint64, len(rows.words))[rows.at]
        n = max(0, len(words) - WORDS + 1)
        whole = np.zeros(n, np.uint64)
        for i in range(WORDS):
            whole += words[i : i + n] * ORDER[i]
        for end, size in zip(rows.ends.tolist(), rows.lengths.tolist(), strict=True):
            if size >= WORDS:
                part = whole[end - size : end - WORDS + 1]
            else:
                part = (words[end - size : end] * ORDER[:size]).sum(keepdims=True, dtype=np.uint64)[: min(size, 1)]
            part = (part ^ part >> np.uint64(32)) * MIX
            yield np.sort((part >> np.uint64(32)).astype(np.uint32))


def frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Inverse document frequency per place, from 1 to 1 + `SPREAD`; the table has 2^20 places at any size."""
    size, width = 1 << PLACE_BITS, (1 << PLACE_BITS) // STRIPES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(size, np.int64), 0
        for batch in batches:
            for row in shingles(batch.column(0)):
                np.add.at(total, np.unique(row) >> np.uint32(32 - PLACE_BITS), 1)
                texts += 1
        if texts:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(STRIPES), pa.int32()), pa.array([texts] * STRIPES, pa.int64()),
                 pa.array([total[i * width : (i + 1) * width].tobytes() for i in range(STRIPES)], pa.binary())],
                names=["stripe", "texts", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for counts in rows.column("counts"):
            total += np.frombuffer(counts.as_py(), np.int64)
        return pa.table({"stripe": rows.column("stripe").slice(0, 1), "texts": [pc.sum(rows.column("texts")).as_py()],
                         "counts": [total.tobytes()]})

    schema = "stripe int, texts bigint, counts binary"
    partial = docs.select(text).mapInArrow(count, schema)
    # Added up in two steps: one group has the tables of a sixteenth of the tasks at most.
    partial = partial.groupBy("stripe", F.spark_partition_id() % 16).applyInArrow(lambda key, rows: add(rows), schema)
    rows = partial.groupBy("stripe").applyInArrow(add, schema).collect()
    rows.sort(key=lambda r: r["stripe"])
    if not rows:
        return np.zeros(size)
    counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows])
    texts = rows[0]["texts"]
    rarity = np.log1p(texts / np.maximum(counts, max(1.0, texts * RARE)))
    least, most = np.log1p(1.0), np.log1p(1 / RARE)
    return 1 + SPREAD * (rarity - least) / (most - least)


def signature(row: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, float]:
    """Band keys and total weight of a text with shingles `row` (sorted, repeats included)."""
    keys, counts = np.unique(row, return_counts=True)
    rarity = idf[keys >> np.uint32(32 - PLACE_BITS)]
    log_weight = np.log(counts * rarity).astype(np.float32)
    wide = keys.astype(np.uint64)
    picks = np.zeros(BANDS * ROWS, np.uint64)
    some = max(1, min(BANDS * ROWS, (1 << 16) // len(keys)))  # samples at a time
    for at in range(0, BANDS * ROWS, some):
        draw = (((wide + np.uint64(1)) * SAMPLE[at : at + some, None]) >> np.uint64(48)).astype(np.int64)
        r, b = DRAW_R[draw], DRAW_B[draw]
        t = np.floor(log_weight / r + b)
        best = (DRAW_C[draw] - r * (t - b) - r).argmin(1)
        level = t[np.arange(len(best)), best].astype(np.int64).astype(np.uint64)
        picks[at : at + some] = (wide[best] * MIX) ^ (level * SAMPLE[0])
    picks = (picks ^ picks >> np.uint64(29)) * MIX
    bands = (picks.reshape(BANDS, ROWS) * ORDER[:ROWS]).sum(1, dtype=np.uint64)
    bands = ((bands ^ bands >> np.uint64(32)) * MIX).view(np.int64)
    return bands, float((counts * rarity).sum())


def weighted_jaccard(a: np.ndarray, b: np.ndarray, idf: np.ndarray) -> float:
    """Weighted Jaccard similarity of two texts' shingles."""
    x, y = (_numbered(row) for row in (a, b))
    common = np.intersect1d(x, y, assume_unique=True)
    weight = [idf[rows >> np.int64(64 - PLACE_BITS - 1)].sum() for rows in (common, x, y)]
    return float(weight[0] / (weight[1] + weight[2] - weight[0]))


def _numbered(row: np.ndarray) -> np.ndarray:
    """Each shingle with the number of its repeat, as one 63-bit integer."""
    n = np.arange(len(row))
    first = np.searchsorted(row, row)
    return row.astype(np.int64) << np.int64(31) | (n - first)


def tile_links(rows: pa.Table, x: np.ndarray, y: np.ndarray, idf: np.ndarray, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between the texts numbered `x` and `y` of `rows`, no more than join their classes:
    the similarities of all pairs are added up shingle by shingle."""
    vectors = [_numbered(np.frombuffer(v.as_py(), np.uint32)) for v in rows.column("vector")]
    member, weight = np.array(rows.column("member")), np.array(rows.column("weight"))
    class_, root = np.unique(np.array(rows.column("class")), return_inverse=True)
    same = len(x) == len(y) and (x == y).all()
    if len(class_) == 1:
        return member[:0], member[:0]
    key_y = np.concatenate([vectors[i] for i in y])
    owner = np.repeat(np.arange(len(y)), [len(vectors[i]) for i in y])
    order = np.argsort(key_y, kind="stable")
    key_y, owner = key_y[order], owner[order]
    root = root.tolist()

    def find(k: int) -> int:
        while root_of[k] != k:
            root_of[k] = root_of[root_of[k]]
            k = root_of[k]
        return k

    root_of = list(range(len(class_)))
    links: list[tuple[int, int]] = []
    for at, i in enumerate(x.tolist()):
        low, high = np.searchsorted(key_y, vectors[i]), np.searchsorted(key_y, vectors[i], "right")
        n = high - low
        take = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        rarity = np.repeat(idf[vectors[i] >> np.int64(64 - PLACE_BITS - 1)], n)
        common = np.bincount(owner[take], rarity, len(y))
        score = common / (weight[i] + weight[y] - common)
        for j in np.flatnonzero(score >= similar - 1e-9).tolist():
            k = int(y[j])
            a, b = find(root[i]), find(root[k])
            if a == b or (same and j <= at):
                continue
            if weighted_jaccard(*(np.frombuffer(rows.column("vector")[t].as_py(), np.uint32) for t in (i, k)), idf) >= similar:
                root_of[max(a, b)] = min(a, b)
                links.append((int(member[i]), int(member[k])))
    a, b = np.array(links, np.int64).reshape(-1, 2).T
    return a, b


def near_duplicates(
    docs: DataFrame, similar: float = SIMILAR, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: `key`, class_id (the smallest key that links lead to, itself
    included), kept (key = class_id).

    Texts without a word (null and empty ones too) link with nothing. Rows without a key are
    left out; rows that repeat a key must be copies of one row.
    """
    spark = docs.sparkSession
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
    idf = spark.sparkContext.broadcast(frequencies(rows))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                one, two, weight, bands, vector = [], [], [], [], []
                for row in shingles(part.column(1)):
                    digest = xxhash.xxh3_128_intdigest(row.tobytes())
                    one.append((digest >> 64) - 2**63)
                    two.append((digest & (2**64 - 1)) - 2**63)
                    band, total = signature(row, idf.value) if len(row) else (None, 0.0)
                    bands.append(None if band is None else band.tolist())
                    weight.append(total)
                    vector.append(row.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(weight, pa.float64()),
                     pa.array(bands, pa.list_(pa.int64())), pa.array(vector, pa.binary())],
                    names=["doc", "one", "two", "weight", "bands", "vector"])

    signed = rows.mapInArrow(sign, "doc bigint, one bigint, two bigint, weight double, bands array<bigint>, vector binary")
    signed = stored(signed, "near-signed")
    equal = signed.filter("bands is not null").groupBy("one", "two").agg(F.min("doc").alias("first"))
    equal = stored(equal, "near-equal")
    first = signed.select("doc", "weight", F.posexplode("bands").alias("band", "bucket"))
    first = first.join(equal.select(F.col("first").alias("doc")), "doc", "left_semi")
    members = first.select(F.xxhash64("band", "bucket").alias("bucket"), F.col("doc").alias("member"), "weight").distinct()
    wide = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    members = stored(members.join(wide, "bucket", "left_semi"), "near-members")
    needed = members.select(F.col("member").alias("doc")).distinct()
    vectors = stored(signed.select("doc", "vector").join(needed.hint("merge"), "doc", "left_semi"), "near-vectors")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (c.to_pylist() for c in batch.columns[2:])
            score = [weighted_jaccard(np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32), idf.value) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(score, pa.float64())], names=["pivot", "member", "score"])

    # Round one: every group against its first member.
    pivots = members.groupBy("bucket").agg(F.min_by(F.struct("member", "weight"), "member").alias("p"))
    pivots = pivots.select("bucket", F.col("p.member").alias("pivot"), F.col("p.weight").alias("p_weight"))
    pairs = members.join(pivots, "bucket").filter("pivot < member")
    pairs = pairs.filter(F.least("weight", "p_weight") >= similar * F.greatest("weight", "p_weight"))
    pairs = pairs.select("pivot", "member").distinct()
    pairs = pairs.join(vectors.select(F.col("doc").alias("member"), F.col("vector").alias("y")), "member")
    pairs = pairs.join(vectors.select(F.col("doc").alias("pivot"), F.col("vector").alias("x")), "pivot")
    scored = pairs.select("pivot", "member", "x", "y").mapInArrow(verify, "pivot bigint, member bigint, score double")
    scored = stored(scored.filter(F.col("score") >= similar), "near-scored")
    classes = components(scored, "pivot", "member")

    # Round two: the groups whose members are not of one class yet, in tiles.
    members = members.join(classes, F.col("member") == F.col("node"), "left")
    members = stored(members.select("bucket", "member", "weight", F.coalesce("component", "member").alias("class")), "near-members")
    mixed = (
        members.groupBy("bucket")
        .agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).alias("n"),
             F.sum(F.xxhash64("member").cast("decimal(38,0)")).alias("same"))
        .filter("low <> high")
        .groupBy("n", "same").agg(F.min("bucket").alias("bucket"), F.first("n").alias("size"))  # equal groups once
        .select("bucket", "size")
    )
    tiled = members.join(mixed, "bucket").withColumn("tile", F.pmod(F.xxhash64("member"), F.ceil(F.col("size") / TILE_TEXTS)))
    tiled = tiled.join(vectors.select(F.col("doc").alias("member"), "vector"), "member")
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("size") / TILE_TEXTS) - 1)))
    tiled = tiled.withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")})

    def compare(rows: pa.Table) -> pa.Table:
        first = np.array(rows.column("tile")) == rows.column("i")[0].as_py()
        parts = [np.flatnonzero(first), np.flatnonzero(~first) if (~first).any() else np.flatnonzero(first)]
        found = tile_links(rows, *parts, idf.value, similar)
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    tiles = tiled.select("bucket", "i", "j", "tile", "member", "weight", "class", "vector").groupBy("bucket", "i", "j")
    found = stored(tiles.applyInArrow(compare, "a bigint, b bigint"), "near-tiles")
    classes = components(scored.select("pivot", "member").union(found), "pivot", "member")
    by_text = equal.join(classes, F.col("first") == F.col("node"), "left")
    by_text = by_text.select("one", "two", F.coalesce("component", "first").alias("class_id"))
    own = signed.select("doc", "one", "two", F.col("bands").isNull().alias("bare"))
    out = own.join(by_text, ["one", "two"], "left")
    class_id = F.when(F.col("bare"), F.col("doc")).otherwise(F.coalesce("class_id", "doc"))
    return out.select(F.col("doc").alias(key), class_id.alias("class_id"), (F.col("doc") == class_id).alias("kept"))
