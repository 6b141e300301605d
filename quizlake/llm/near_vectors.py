"""Near-duplicate vectors: int8 tile products with rigorous error bounds.

Each unit vector u is held as s * a + r, a of 8-bit whole numbers, and |s a| and |r| are kept.
For two vectors |u.v - (s a).(s' a')| <= |s a| |r'| + |r|, so a tile of whole-number products
tells which pairs may reach the threshold; only these are computed again in double precision.

Equal vectors are one row with a count before any product. A tile returns per vector the
number of linked vectors and, of its links, only a spanning forest: output is linear in the
vectors of a tile even if they are all alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.llm.common import stored
from quizlake.llm.components import components
from quizlake.llm.vectors import blocks, finite, padded

TILE_ROWS, STEP_ROWS = 4096, 1024
#: Covers the rounding of the bound's own arithmetic in single precision.
SLACK = 1e-5


class Quantised:
    """Unit vectors, their 8-bit forms and bounds."""

    def __init__(self, values: np.ndarray):
        # A power of two as scale keeps tiny and huge vectors in range without rounding.
        top = np.abs(values).max(axis=1, initial=0, keepdims=True)
        values = values / np.exp2(np.floor(np.log2(top)))
        self.unit = values / np.sqrt((values * values).sum(1, keepdims=True))
        step = np.abs(self.unit).max(axis=1, initial=0) / 127
        self.whole = np.rint(self.unit / step[:, None]).astype(np.int8)
        near = self.whole * step[:, None]
        self.step = step.astype(np.float32)
        self.size = np.sqrt((near * near).sum(1)).astype(np.float32)
        self.rest = np.sqrt(((self.unit - near) ** 2).sum(1)).astype(np.float32)


def links(x: Quantised, y: Quantised, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of y) with cosine of at least `least`; of one block only row < row."""
    found_r, found_c = [], []
    right = y.whole.astype(np.float32).T  # products of 8-bit numbers stay exact in single precision
    for at in range(0, len(x.unit), STEP_ROWS):
        part = slice(at, at + STEP_ROWS)
        bound = x.whole[part].astype(np.float32) @ right
        bound *= x.step[part, None]
        bound *= y.step
        bound += x.size[part].max(initial=0) * y.rest
        bound += x.rest[part, None]
        r, c = np.nonzero(bound >= np.float32(least - SLACK))
        if same:
            r, c = r[r + at < c], c[r + at < c]
        if not len(r):
            continue
        rows, cols = np.unique(r), np.unique(c)
        if len(r) * 50 > len(rows) * len(cols):  # many pairs: one product of the rows they touch
            exact = x.unit[rows + at] @ y.unit[cols].T
            cosine = exact[np.searchsorted(rows, r), np.searchsorted(cols, c)]
        else:
            cosine = np.concatenate(
                [np.einsum("ij,ij->i", x.unit[r[i : i + 65536] + at], y.unit[c[i : i + 65536]])
                 for i in range(0, len(r), 65536)]
            )
        keep = cosine >= least
        found_r.append(r[keep] + at)
        found_c.append(c[keep])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *found_r]), np.concatenate([empty, *found_c])


def forest(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """Per node the smallest node that the links (a, b) lead to."""
    label = np.arange(nodes)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b):
            np.minimum.at(new, label[end], low)
        new = new[new]
        new = np.minimum(new, new[label])
        if (new == label).all():
            return label
        label = new


def near_duplicates(
    vectors: DataFrame, least: float = 0.95, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """One row per vector: `key`, n_links (other vectors with cosine >= `least`),
    component_id (smallest key that links lead to, itself included), kept (key = component_id).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing;
    rows without a key are left out. Shorter vectors end in zeros. Repeated rows are vectors of
    their own that link with each other.
    """
    rows = vectors.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("values")
    )
    whole = finite("values") & F.coalesce(F.exists("values", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("values", F.when(whole, F.col("values")))
    distinct = (
        rows.filter("values is not null")
        .groupBy("values")
        .agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("count"))
    )
    distinct = stored(distinct, "near-vectors")
    held = stored(blocks(distinct, TILE_ROWS), "near-blocks")
    numbers = [r[0] for r in held.select("block").orderBy("block").collect()]  # one per tile row

    def pairs(side: str) -> DataFrame:
        other = F.array(*[F.lit(n) for n in numbers]) if numbers else F.expr("cast(array() as array<bigint>)")
        mine, theirs = ("i", "j") if side == "x" else ("j", "i")
        out = held.select(F.col("block").alias(mine), *[F.col(c).alias(f"{side}_{c}") for c in held.columns[1:]])
        return out.withColumn(theirs, F.explode(other)).filter("i <= j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                same, width = r["i"] == r["j"], max(r["x_width"], r["y_width"])
                x, y = (Quantised(padded(r[f"{s}_values"], r[f"{s}_n"], r[f"{s}_width"], width)) for s in "xy")
                keys, counts = (
                    np.concatenate([np.frombuffer(r[f"{s}_{what}"], np.int64) for s in ("x" if same else "xy")])
                    for what in ("keys", "counts")
                )
                a, b = links(x, y, least, same)
                b = b if same else b + r["x_n"]
                n = len(keys)
                linked = np.bincount(a, counts[b], n) + np.bincount(b, counts[a], n)
                root = forest(a, b, n)
                root = forest_keys(root, keys)
                hit = np.flatnonzero(linked)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[hit]), pa.array(linked[hit].astype(np.int64)), pa.array(root[hit])],
                    names=["key", "linked", "root"],
                )

    tiles = pairs("x").join(pairs("y"), ["i", "j"])
    tiles = stored(tiles.mapInArrow(run, "key bigint, linked bigint, root bigint"), "near-tiles")
    linked = tiles.groupBy("key").agg(F.sum("linked").alias("linked"))
    component = components(tiles.select("key", "root"), "key", "root")
    classes = (
        distinct.join(linked, "key", "left")
        .join(component, distinct["key"] == component["node"], "left")
        .select(
            "values",
            (F.coalesce("linked", F.lit(0)) + F.col("count") - 1).alias("n_links"),
            F.coalesce("component", "key").alias("component_id"),
        )
    )
    return rows.join(classes, "values", "left").select(
        F.col("key").alias(key),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.coalesce("component_id", "key").alias("component_id"),
        (F.col("key") == F.coalesce("component_id", "key")).alias("kept"),
    )


def forest_keys(root: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Per node the smallest key of its tree."""
    low = keys.copy()
    np.minimum.at(low, root, keys)
    return low[root]
