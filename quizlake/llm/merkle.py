"""A Merkle manifest of a data set: leaf, subroot per source, root, and the proof of each row.

Nodes of a group are numbered and cut into aligned blocks of `FAN` ** `DEPTH` of them. A block
keeps each of its levels as one string of hex digests: the parents of a level are the hashes of
its substrings of `FAN` digests, and the siblings of a node are the substrings on both sides of
it in its run. The roots of the blocks are the nodes of the next tier, and so on until a group
has one node. The roots of the groups are the nodes of a last tree. Paths come down the same
way, from the root of the last tree to the leaves.

All of it is SQL functions; a task never holds more than one block of a group, and the level
strings are binary, where a substring is found without counting characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizlake.llm.common import stored

FAN, DEPTH = 16, 2
BLOCK = FAN**DEPTH
HEX = 64
STEP = "struct<before:binary,after:binary>"


def field(value: Column) -> Column:
    """One field of a leaf: `-` for null, else its size in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, step: digest(step["before"], h.cast("binary"), step["after"]))


def proof(path: Column) -> Column:
    """All siblings of a path in a row, as hex text."""
    sides = F.transform(path, lambda s: F.concat(s["before"], s["after"]).cast("string"))
    return F.array_join(sides, "")


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`rows` with `idx`, their place (from 0) in their group by `order`, and `n`, the size of
    the group. Rows are dealt by ranges of (group, order), so a group that holds most rows is
    spread over many tasks; only one count per group and range crosses them."""
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(group, *order, "_tie").withColumn("_part", F.spark_partition_id())
    dealt = stored(dealt, "merkle-order")
    by = ["_part", group]
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    ranges = ranges.select(
        *by,
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(Window.partitionBy(group)).alias("n"),
    )
    inside = F.row_number().over(Window.partitionBy(*by).orderBy(*order, "_tie")) - 1
    placed = dealt.withColumn("_inside", inside).join(ranges, by)
    return placed.withColumn("idx", F.col("_offset") + F.col("_inside")).drop("_part", "_tie", "_offset", "_inside")


def _parents(level: Column) -> Column:
    """The next level: one hash per run of `FAN` digests."""
    width = FAN * HEX
    runs = F.sequence(F.lit(0), F.ceil(F.octet_length(level) / width).cast("int") - 1)
    hashes = F.transform(runs, lambda i: F.sha2(F.substr(level, i * width + 1, F.lit(width)), 256))
    return F.array_join(hashes, "").cast("binary")


def _blocks(nodes: DataFrame) -> DataFrame:
    """Blocks of nodes (g, idx, n, h, what): their nodes in order, and their levels as strings.
    `level_<k>` is null from where the group has one node left."""
    node = F.struct("idx", "h", "what")
    blocks = nodes.groupBy("g", F.expr(f"idx div {BLOCK}").alias("block")).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(node)).alias("nodes"))
    blocks = blocks.withColumn("level_0", F.array_join(F.col("nodes.h"), "").cast("binary"))
    for k in range(DEPTH):
        blocks = blocks.withColumn(f"level_{k + 1}", F.when(F.col("n") > FAN**k, _parents(F.col(f"level_{k}"))))
    return blocks


def _side(k: int) -> Column:
    """What stands on both sides of node `at` of a block in its run of level `k`."""
    level, width = F.col(f"level_{k}"), FAN * HEX
    place = F.expr(f"at div {FAN**k}")
    start, inside = F.floor(place / FAN).cast("int") * width, (place % FAN).cast("int") * HEX
    return F.struct(
        F.substr(level, start + 1, inside).alias("before"),
        F.substr(level, start + inside + HEX + 1, F.lit(width - HEX) - inside).alias("after"),
    )


class Tree:
    """Trees over groups of nodes (g, idx, n, h, what), one root per group."""

    def __init__(self, nodes: DataFrame):
        self.tiers: list[DataFrame] = []
        while True:
            tier = stored(_blocks(nodes), "merkle-blocks")
            self.tiers.append(tier)
            top = F.coalesce(*[f"level_{k}" for k in range(DEPTH, -1, -1)]).cast("string")
            nodes = tier.select(
                "g", F.col("block").alias("idx"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"),
                top.alias("h"), F.lit(None).cast("string").alias("what"))
            if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
                break
        self.roots = nodes.select("g", "h")

    def paths(self, tops: DataFrame) -> DataFrame:
        """g, what, h and `path` of every node, and the other columns of `tops`, which holds g
        and the path (steps from a group's root upwards)."""
        more = [c for c in tops.columns if c not in ("g", "path")]
        above = tops.withColumn("idx", F.lit(0).cast("bigint"))
        for tier in reversed(self.tiers):
            above = above.withColumnRenamed("idx", "block")
            nodes = tier.join(above, ["g", "block"]).select("*", F.posexplode("nodes").alias("at", "node"))
            # A level without parents has one node: no step.
            steps = [F.when(F.col(f"level_{k + 1}").isNotNull(), F.array(_side(k))).otherwise(F.array().cast(f"array<{STEP}>")) for k in range(DEPTH)]
            above = nodes.select("g", "node.idx", "node.what", "node.h", F.concat(*steps, "path").alias("path"), *more)
            if tier is not self.tiers[0]:
                above = above.drop("what", "h")
        return above.drop("idx")


def manifest(
    docs: DataFrame, columns: list[str], key: str = "doc_id", source: str = "source", tampered: dict[str, Column] | None = None
) -> DataFrame:
    """Per row of `docs`: `key`, leaf, subroot (of its source), root (of all sources), path
    (steps of before and after, from the leaf to the root) and tampered_leaf.

    A leaf is the hash of the fields `columns`. Leaves of a source ascend by `key`, null keys
    first and rows of one key by leaf; rows that are equal in all fields are leaves of their
    own. Sources ascend bytewise, the null source first. `tampered` gives other values for
    some columns: `tampered_leaf` is then the leaf with those, else it equals the leaf. No row
    is lost for a null, and an empty table has no rows and no root; other columns play no part.
    """
    changed = tampered or {}
    name = F.coalesce(F.concat(F.lit("+"), F.col(source)), F.lit(""))  # null first, and no null
    leaf = digest(*[field(F.col(c)) for c in columns])
    other = digest(*[field(changed.get(c, F.col(c))) for c in columns])
    leaves = docs.select(name.alias("g"), F.col(key).alias("k"), leaf.alias("h"), other.alias("t"))
    leaves = stored(leaves.withColumn("t", F.when(F.col("t") != F.col("h"), F.col("t"))), "merkle-leaves")
    nodes = numbered(leaves, "g", ["k", "h"])
    tree = Tree(nodes.select("g", "idx", "n", "h", F.struct("k", "t").alias("what")))

    roots = tree.roots.select(F.lit("").alias("all"), "g", F.col("h").alias("subroot"))
    sources = Tree(numbered(roots, "all", ["g"]).select(
        F.col("all").alias("g"), "idx", "n", F.col("subroot").alias("h"), F.col("g").alias("what")))
    none = F.array().cast(f"array<{STEP}>")
    above = sources.paths(sources.roots.select("g", F.col("h").alias("root"), none.alias("path")))
    tops = stored(above.select(F.col("what").alias("g"), "path", F.col("h").alias("subroot"), "root"), "merkle-sources")
    found = tree.paths(tops)
    return found.select(
        F.col("what.k").alias(key), F.col("h").alias("leaf"), "subroot", "root", "path",
        F.coalesce("what.t", "h").alias("tampered_leaf"))
