"""Connected components of a table of links, by alternating star contractions.

Each round hangs the larger neighbours of a node, then its smaller ones, on the smallest node
it knows (large star, small star), until every node hangs on the smallest of its component.
Minima are aggregated with partial results and links are only joined, never gathered per node,
so a node with very many links is split like any skewed join. Rounds are cut by stored tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.llm.common import stored


def _is_done(links: DataFrame) -> bool:
    """Whether the links are stars: every node hangs on one node, which hangs on none."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(
        links.select("b", F.lit(0), F.lit(1))
    )
    ends = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return ends.filter("hangs > 1 or (hangs = 1 and holds = 1)").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node`, `component` (the smallest node that links lead to) for every node of `links`
    that is not the smallest of its component. Directions, repeats and self-links are ignored."""
    links = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    links = stored(links, "links")
    while not _is_done(links):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        links = stored(small.union(low.select("a", F.col("low").alias("b"))).distinct(), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
