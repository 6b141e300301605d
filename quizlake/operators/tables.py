"""Table maintenance and joins over job, frame, log and artifact tables.

There is no table format underneath: each operation is a query for the next snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlake.operators.ranking import ordinal, span, top_n

# --- fixed values -----------------------------------------------------------------
RETAINED_JOBS, LOG_ROWS, LOG_ROWS_SHOWN, RECENT_JOBS, RECOVERED_JOBS = 20, 1000, 40, 10, 50
ITEMS_PER_PAGE = 2
RESTART_ERROR, RESTART_PROGRESS = "Job interrupted by app restart.", "Interrupted on restart"
# -----------------------------------------------------------------------------------


def latest(rows: DataFrame, keys: list[str], version: str | list[str]) -> DataFrame:
    """Newest row per key. The aggregate combines map-side, so a key with many versions
    sends one row per task."""
    versions = [version] if isinstance(version, str) else version
    whole = F.struct(*[c for c in rows.columns if c not in keys])
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(whole, F.struct(*versions)).alias("_row"))
        .select(*keys, "_row.*")
        .select(*rows.columns)
    )


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    return latest(base.unionByName(changes), keys, version)


def replace_children(base: DataFrame, fresh: DataFrame, touched: DataFrame, key: str = "job_id") -> DataFrame:
    """Delete all rows of the touched parents, then insert the fresh ones (possibly none)."""
    return base.join(touched.select(key).distinct(), key, "left_anti").unionByName(fresh)


def delete_jobs(tables: dict[str, DataFrame], doomed: DataFrame, key: str = "job_id") -> dict[str, DataFrame]:
    return {name: df.join(doomed.select(key), key, "left_anti") for name, df in tables.items()}


def recent(jobs: DataFrame, n: int = RECENT_JOBS) -> DataFrame:
    return jobs.orderBy(F.desc("updated_at"), F.asc("job_id")).limit(n)


def retained(jobs: DataFrame, child: DataFrame, keep: int = RETAINED_JOBS) -> DataFrame:
    """Child rows of the newest jobs. The kept ids are at most `keep` rows."""
    return child.join(recent(jobs, keep).select("job_id"), "job_id", "left_semi")


def recover_interrupted(jobs: DataFrame, message: str = "Interrupted", n: int = RECOVERED_JOBS) -> DataFrame:
    """Newest jobs that never reached a final state, marked failed."""
    from quizlake.functions.events import is_terminal

    newest = recent(jobs, n).filter(~is_terminal(F.col("state")))
    return newest.withColumn("state", F.lit("failed")).withColumn("error_message", F.lit(message))


def recovered(jobs: DataFrame, logs: DataFrame | None = None, n: int = RECOVERED_JOBS) -> tuple[DataFrame, DataFrame | None]:
    """The job table after a restart, and the log (job_id, seq, stage, message) if given: the
    newest `n` jobs that never reached a final state are failed, and each gets one more log
    row. At most `n` ids are repaired, so they may be broadcast."""
    repaired = recover_interrupted(jobs, RESTART_ERROR, n).select("job_id", F.lit(True).alias("_hit"))
    state = {"state": "failed", "error_message": RESTART_ERROR, "error_code": "unknown", "progress_message": RESTART_PROGRESS}
    marked = jobs.join(F.broadcast(repaired), "job_id", "left")
    for name, value in state.items():
        if name in jobs.columns:
            marked = marked.withColumn(name, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(name)))
    if logs is None:
        return marked.drop("_hit"), None
    last = logs.join(F.broadcast(repaired), "job_id", "left_semi").groupBy("job_id").agg(F.max("seq").alias("_last"))
    fresh = repaired.join(last, "job_id", "left").select(
        "job_id", (F.coalesce("_last", F.lit(0)) + 1).alias("seq"), F.lit("failed").alias("stage"), F.lit(RESTART_ERROR).alias("message"))
    return marked.drop("_hit"), logs.unionByName(fresh)


def newest_logs(logs: DataFrame, n: int = LOG_ROWS) -> DataFrame:
    return top_n(logs, ["job_id"], [F.desc("seq")], n, F.col("seq"))


def patch(base: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """`changes` holds has_<column> flags: absent keeps, present sets, present NULL clears."""
    renamed = changes.select(
        *keys, *[F.col(c).alias(f"_new_{c}") for c in columns], *[F.col(f"has_{c}") for c in columns]
    )
    out = base.join(renamed, keys, "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.coalesce(f"has_{c}", F.lit(False)), F.col(f"_new_{c}")).otherwise(F.col(c)))
    return out.select(*base.columns)


def paginate(items: DataFrame, order: str, pages_per_part: float | None = None) -> DataFrame:
    """Page and part of every item, two items a page; parts are cut when a positive finite
    page limit is given."""
    limit = int(pages_per_part) if pages_per_part and 0 < pages_per_part < float("inf") else 0
    out = ordinal(items, ["job_id"], [F.col(order)], span(order), name="_i", start=0)
    page = F.floor(F.col("_i") / ITEMS_PER_PAGE)
    part = F.floor(F.col("_i") / (ITEMS_PER_PAGE * limit)) if limit else F.lit(0).cast("bigint")
    out = out.withColumn("page", page).withColumn("part", part)
    sizes = out.groupBy("job_id", "part").agg(
        F.ceil(F.count(F.lit(1)) / ITEMS_PER_PAGE).alias("pages_in_part")
    )
    return out.drop("_i").join(sizes, ["job_id", "part"])


def _in_runs(rows: DataFrame, order: list[str], bucket: Column, size: int, name: str) -> DataFrame:
    """Rows per job in order, as arrays of structs of at most `size` rows with a run number."""
    fields = [c for c in rows.columns if c != "job_id"]
    numbered = ordinal(rows, ["job_id"], [F.col(c) for c in order], bucket, name="_i", start=0)
    runs = numbered.withColumn("run", F.floor(F.col("_i") / size)).groupBy("job_id", "run")
    listed = F.array_sort(F.collect_list(F.struct("_i", F.struct(*fields).alias("row"))))
    return runs.agg(listed.alias("_rows")).select("job_id", "run", F.transform("_rows", lambda x: x["row"]).alias(name))


def jobs_with_children(jobs: DataFrame, frames: DataFrame, logs: DataFrame, rows_per_run: int = 500) -> DataFrame:
    """Jobs with all columns of all their frames (by seconds, frame_idx) and log rows (by
    seq), in runs of at most `rows_per_run`. A job with more rows takes several rows; no
    array grows with the job, and a job without rows has one row with no run."""
    shown = _in_runs(frames, ["seconds", "frame_idx"], span("seconds"), rows_per_run, "frames")
    told = _in_runs(logs, ["seq"], span("seq"), rows_per_run, "logs")
    return jobs.join(shown.join(told, ["job_id", "run"], "full"), "job_id", "left")


def toggled(events: DataFrame, keys: list[str]) -> DataFrame:
    """Set membership after many toggles: ids toggled an odd number of times."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("toggles")).filter(F.col("toggles") % 2 == 1)


def shuffled(questions: DataFrame, seed: str, order: str = "q_idx") -> DataFrame:
    """Reproducible random order per job. The digest prefix cuts a job into equal buckets."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("job_id").cast("string"), F.lit(":"), F.col(order).cast("string")))
    out = questions.withColumn("_digest", digest)
    bucket = F.conv(F.substring("_digest", 1, 3), 16, 10).cast("bigint")
    return ordinal(out, ["job_id"], [F.col("_digest"), F.col(order)], bucket, name="exam_no").drop("_digest")


def in_batches(rows: DataFrame, order: str, size: int, bucket: Column | None = None) -> DataFrame:
    """batch_no and pos (both from 0) per job in order."""
    out = ordinal(rows, ["job_id"], [F.col(order)], span(order) if bucket is None else bucket, name="_i", start=0)
    return out.withColumn("batch_no", F.floor(F.col("_i") / size)).withColumn(
        "pos", (F.col("_i") % size).cast("bigint")
    ).drop("_i")
