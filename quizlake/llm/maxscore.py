"""Exact top-k search by inner product, MaxScore over shards.

A vector's components are its terms; a term of a query adds q * v to the score. In a block of
candidates a term can add at most its bound (from the block's least and greatest value of the
component), measured from the least it can add. Terms in rising order of bounds are
non-essential as long as all of them together, on top of the least score, stay below the
query's k-th best score so far: no candidate can enter the result by them alone. The postings
of the essential terms are traversed for all candidates of the block; a candidate is probed for
the other terms, largest bound first, only while its score so far plus the rest of the bounds
can still reach the k-th best. Each run of shards returns its k best per query; these are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizlake.llm.common import scratch, stored
from quizlake.llm.vectors import filed, finite, read_block, widened

SHARD_ROWS, QUERY_ROWS, STEP_ROWS = 8192, 512, 1024
#: Shards that a task meets one after another, at most.
RUN_SHARDS = 32
#: Terms are non-essential while their bounds stay below this share of the way from the least
#: score to the k-th best. 1 would be the most terms allowed; with dense vectors a traversal of
#: few more postings is far cheaper than a probe of very many candidates.
SPLIT = 0.2
#: Scores up to here are exact in doubles, and so are the bounds that prune.
EXACT = 2.0**52


class Best:
    """The k best (score, key) of every query so far; equal scores go to the smaller key."""

    def __init__(self, queries: int, k: int):
        self.k, self.queries = k, queries
        self.q = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.key = np.zeros(0, np.int64)
        self.bar = np.full(queries, -np.inf)

    def add(self, q: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        q = np.concatenate([self.q, q])
        score = np.concatenate([self.score, score])
        key = np.concatenate([self.key, key])
        order = np.lexsort((key, -score, q))
        q, score, key = q[order], score[order], key[order]
        first = np.searchsorted(q, np.arange(self.queries))
        rank = np.arange(len(q)) - first[q]
        keep = rank < self.k
        last = rank == self.k - 1
        self.bar[q[last]] = score[last]
        self.q, self.score, self.key = q[keep], score[keep], key[keep]


def plain_scores(queries: np.ndarray, values: np.ndarray, most: float, own: np.ndarray) -> np.ndarray:
    """All scores in integers, where doubles would round them; 0 for a vector with itself."""
    if most < 2.0**62:
        return queries.astype(np.int64) @ values.astype(np.int64).T
    ints = np.frompyfunc(int, 1, 1)
    scores = np.where(own, 0, ints(queries) @ ints(values).T)
    if (np.abs(scores) >= 2**63).any():
        raise OverflowError("a score does not fit 64 bits")
    return scores.astype(np.int64)


def search(queries: np.ndarray, query_keys: np.ndarray, values: np.ndarray, keys: np.ndarray, best: Best) -> None:
    """Put the candidates of one shard (`values`, whole numbers) against all `queries`. Where
    scores are too large for exact bounds, nothing is pruned."""
    most = np.abs(queries).max(initial=0) * np.abs(values).max(initial=0) * queries.shape[1]
    kind = np.float32 if most < 2**23 else np.float64
    rows = np.arange(len(queries))
    weights = queries.astype(kind)
    for at in range(0, len(values), STEP_ROWS):
        part, part_keys = values[at : at + STEP_ROWS].astype(kind), keys[at : at + STEP_ROWS]
        if not most < EXACT:
            own = query_keys[:, None] == part_keys
            scores = plain_scores(queries, values[at : at + STEP_ROWS], most, own)
            q, c = np.nonzero(~own)
            best.add(rows[q], scores[q, c], part_keys[c])
            continue
        low, high = part.min(0), part.max(0)
        least = np.minimum(queries * low, queries * high).astype(np.float64)
        greatest = np.maximum(queries * low, queries * high).astype(np.float64)
        bound = greatest - least
        order = np.argsort(bound, axis=1)  # rising bounds
        reach = least.sum(1)[:, None] + np.cumsum(np.take_along_axis(bound, order, 1), axis=1)
        base = least.sum(1)[:, None]
        bar = base + SPLIT * (best.bar[:, None] - base)
        spare = (reach < bar).sum(1)  # so many terms are non-essential
        essential = np.ones_like(queries, bool)
        np.put_along_axis(essential, order, np.arange(queries.shape[1]) >= spare[:, None], axis=1)
        partial = np.where(essential, weights, 0).astype(kind) @ part.T
        rest = np.where(essential, 0.0, greatest).sum(1)
        q, c = np.nonzero(partial >= (best.bar - rest)[:, None])
        own = query_keys[q] == part_keys[c]
        q, c = q[~own], c[~own]
        score, rest = partial[q, c].astype(np.int64), rest[q]
        for place in range(int(spare.max(initial=0)) - 1, -1, -1):  # probe, largest bound first
            live = score + rest >= best.bar[q]
            if not live.all():
                q, c, score, rest = q[live], c[live], score[live], rest[live]
            todo = np.flatnonzero(place < spare[q])
            if not len(todo):
                continue
            term = order[q[todo], place]
            rest[todo] -= greatest[q[todo], term]
            score[todo] += (queries[q[todo], term] * values[at + c[todo], term]).astype(np.int64)
        live = score >= best.bar[q]
        best.add(rows[q[live]], score[live], part_keys[c[live]])


def scaled(vector: str, scale: float) -> Column:
    """floor(scale * x) of every component, x as a double."""

    def floor(x: Column) -> Column:
        y = F.lit(scale) * x.cast("double")
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)  # larger ones are whole

    return F.transform(vector, floor)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int,
    scale: float = 64.0,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """For every row where `is_query` holds, the k other rows of greatest inner product of the
    scaled, floored components: query_id, rank (from 1), `key`, score; ties to the smaller key.

    Vectors that are null, empty, hold null or non-finite components, or have no key, take no
    part. Rows that repeat a key count once (the greatest vector); shorter vectors end in zeros.
    No candidate is skipped; a score that does not fit a long raises. An empty table, or one
    without queries, gives no rows. Other columns play no part.
    """
    spark = vectors.sparkSession
    rows = (
        vectors.filter(F.col(key).isNotNull() & finite(vector))
        .select(F.col(key).cast("bigint").alias("key"), is_query.alias("_q"), scaled(vector, scale).alias("values"))
        .groupBy("key")
        .agg(F.max("values").alias("values"), F.max("_q").alias("_q"))
        .withColumn("count", F.lit(1).cast("bigint"))
    )
    rows = stored(rows, "search-vectors")
    shards = filed(rows, SHARD_ROWS, scratch(spark, "search-shards"))
    asked = filed(rows.filter("_q"), QUERY_ROWS, scratch(spark, "search-queries"))

    # Every query block meets every shard, but none travels with the pairs: a task has a query block and a run of
    # shards, reads these one after another, and gives the k best of all of them.
    enough = -(-2 * spark.sparkContext.defaultParallelism // max(1, len(asked)))
    runs = max(-(-len(shards) // RUN_SHARDS), min(len(shards), enough))
    tasks = len(asked) * runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                asked_keys, queries = read_block(*asked[i // runs])
                best = Best(len(queries), k)
                for shard in shards[i % runs :: runs]:
                    keys, values = read_block(*shard)
                    width = max(queries.shape[1], values.shape[1])
                    search(widened(queries, width), asked_keys, widened(values, width), keys, best)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked_keys[best.q]), pa.array(np.full(len(best.q), i % runs)), pa.array(best.key),
                     pa.array(best.score)],
                    names=["query_id", "run", key, "score"],
                )

    found = spark.range(0, tasks, 1, max(1, tasks)).mapInArrow(run, f"query_id bigint, run bigint, `{key}` bigint, score bigint")
    order = [F.desc("score"), F.col(key)]
    # Merge in two steps, so that a query's rows from very many runs do not meet at once.
    some = Window.partitionBy("query_id", F.pmod(F.xxhash64("run"), F.lit(64))).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k)
    whole = Window.partitionBy("query_id").orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", key, "score")

