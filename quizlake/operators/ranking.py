"""Numbering, neighbours and top-n per key that survive one key holding most rows.

A plain `row_number() over (partition by job ...)` puts a whole job into one task. Here
the job is cut into ordered buckets: rows are numbered inside (key, bucket), and a small
table with one row per (key, bucket) supplies the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizlake.session import cut

BUCKET_WIDTH = 4096


def span(order: str, width: int = BUCKET_WIDTH) -> Column:
    """Bucket of a whole-number order column."""
    return F.expr(f"floor({order} / {int(width)})")


def ordinal(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    bucket: Column,
    name: str = "idx",
    start: int = 1,
) -> DataFrame:
    """Dense numbering per key. `bucket` must never decrease along `order`."""
    bucketed = df.withColumn("_bucket", bucket)
    by = [*keys, "_bucket"]
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*by, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return (
        bucketed.withColumn("_inside", inside)
        .join(offsets, by)
        .withColumn(name, F.col("_inside") + F.col("_offset") + F.lit(start - 1))
        .drop("_bucket", "_inside", "_offset")
    )


def previous(
    df: DataFrame, keys: list[str], order: str, value: Column, bucket: Column, name: str
) -> DataFrame:
    """`lag(value)` per key: inside a bucket by window, across buckets by joining the last
    value of the nearest earlier non-empty bucket."""
    bucketed = df.withColumn("_bucket", bucket).withColumn("_value", F.struct(value.alias("v")))
    by = [*keys, "_bucket"]
    tails = (
        bucketed.groupBy(*by)
        .agg(F.max_by("_value", order).alias("_tail"))
        .select(
            *by,
            F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carry"),
        )
    )
    inside = F.lag("_value").over(Window.partitionBy(*by).orderBy(order))
    return (
        bucketed.withColumn("_inside", inside)
        .join(tails, by)
        .withColumn(name, F.coalesce(F.col("_inside"), F.col("_carry"))["v"])
        .drop("_bucket", "_value", "_inside", "_carry")
    )


def top_n(
    df: DataFrame, keys: list[str], order: list[Column], n: int, salt: Column, salts: int = 32
) -> DataFrame:
    """First n rows per key in two steps: n per (key, salt), then n per key. Both steps also
    get Spark's per-task group limit, so a hot key ships n rows per task, not all its rows."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
    for by in ([*keys, "_salt"], keys):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        salted = salted.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
    return salted.drop("_salt")


def top_share(
    df: DataFrame,
    keys: list[str],
    score: str,
    tie: str,
    share: float,
    bins_per_unit: int = 1000,
    tie_width: int = BUCKET_WIDTH,
) -> DataFrame:
    """Rows whose rank per key (score descending, then tie ascending) is within
    max(1, ceil(share * rows)). The rank is the sum of three counts: rows in higher score
    bins, rows with a higher score in the bin, rows before it among equal scores. No task
    sees more than one bin's distinct scores or one run of `tie_width` ties."""
    base = df.withColumn("_bin", F.floor(F.col(score) * bins_per_unit))
    by_bin, by_score = [*keys, "_bin"], [*keys, "_bin", "_score"]
    base = base.withColumn("_score", F.col(score))
    bins = base.groupBy(*by_bin).agg(F.count(F.lit(1)).alias("_rows"))
    higher = Window.partitionBy(*keys).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy(*keys)
    bins = bins.select(
        *by_bin,
        F.coalesce(F.sum("_rows").over(higher), F.lit(0)).alias("_above"),
        F.greatest(F.lit(1), F.ceil(F.sum("_rows").over(total) * F.lit(float(share)))).alias("_keep"),
        F.col("_rows").alias("_bin_rows"),
    )
    placed = base.join(bins, by_bin)
    whole = placed.filter(F.col("_above") + F.col("_bin_rows") <= F.col("_keep"))
    # Only the one bin per key that the cut falls into needs finer counting.
    split = placed.filter(
        (F.col("_above") < F.col("_keep")) & (F.col("_above") + F.col("_bin_rows") > F.col("_keep"))
    )
    scores = split.groupBy(*by_score).agg(F.count(F.lit(1)).alias("_rows"))
    better = Window.partitionBy(*by_bin).orderBy(F.desc("_score")).rowsBetween(Window.unboundedPreceding, -1)
    scores = scores.select(
        *by_score, F.coalesce(F.sum("_rows").over(better), F.lit(0)).alias("_better")
    )
    ranked = ordinal(
        split.join(scores, by_score),
        by_score,
        [F.col(tie)],
        span(tie, tie_width),
        name="_place",
    ).filter(F.col("_above") + F.col("_better") + F.col("_place") <= F.col("_keep"))
    return whole.select(*df.columns).unionByName(ranked.select(*df.columns))


def running(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, total: str) -> DataFrame:
    """`df` with `name`, the running sum of `value` per key by `order` (own row included), and
    `total`, its sum per key. Rows are dealt by ranges of (keys, order), so a key with most
    rows is spread over many tasks; one sum per key and range crosses them. Rows of one key
    must differ in `order`."""
    dealt = cut(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    by = [*keys, "_part"]
    sums = dealt.groupBy(*by).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *by, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"),
        F.sum("_sum").over(Window.partitionBy(*keys)).alias(total),
    )
    inside = F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_inside", inside).join(sums, by).withColumn(name, F.col("_offset") + F.col("_inside")).drop(
        "_part", "_offset", "_inside")
