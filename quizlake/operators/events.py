"""Audits and reports over job state changes and progress events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.functions import events as ev
from quizlake.operators.ranking import previous, span

# --- fixed values -----------------------------------------------------------------
PROGRESS_MILLIS, PIPELINE_MILLIS = 380, 220
EVENT_TYPES = ("progress", "done", "error")
# -----------------------------------------------------------------------------------


def illegal_transitions(versions: DataFrame, bucket_width: int = 4096) -> DataFrame:
    """State changes that the edge table does not allow. A repeated state is no change."""
    seen = previous(
        versions.select("job_id", "version", "state"),
        ["job_id"],
        "version",
        F.col("state"),
        span("version", bucket_width),
        "before",
    )
    return seen.filter(
        F.col("before").isNotNull()
        & (F.col("before") != F.col("state"))
        & ~ev.allowed_transition(F.col("before"), F.col("state"))
    )


def classified_errors(versions: DataFrame) -> DataFrame:
    code = ev.error_code(F.col("error_message"))
    return versions.filter(F.col("error_message").isNotNull()).select(
        "job_id",
        "version",
        code.alias("code"),
        ev.error_category(F.col("error_message"), code).alias("category"),
        ev.transient_pipeline(F.col("error_message")).alias("transient_pipeline"),
        ev.transient_model(F.col("error_message")).alias("transient_model"),
    )


def phase_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("job_id", ev.stage_phase(F.col("stage")).alias("phase")).agg(
        F.count(F.lit(1)).alias("events")
    )


def throttled(logs: DataFrame, millis: int = PROGRESS_MILLIS) -> DataFrame:
    """Latest event per job and time bucket; combines map-side."""
    bucket = F.floor(ev.micros(logs, "ts") / (millis * 1000))
    return (
        logs.groupBy("job_id", bucket.alias("bucket"))
        .agg(
            F.max_by(F.struct("seq", "stage"), F.struct("ts", "seq")).alias("_last"),
            F.count(F.lit(1)).alias("events"),
        )
        .select("job_id", "bucket", "events", F.col("_last.seq").alias("seq"), F.col("_last.stage").alias("stage"))
    )


def run_outcomes(events: DataFrame) -> DataFrame:
    """First terminal event (done or error) of every run."""
    final = events.filter(F.col("type").isin("done", "error"))
    return final.groupBy("run_id").agg(
        F.min("seq").alias("seq"), F.min_by("type", "seq").alias("outcome")
    )
