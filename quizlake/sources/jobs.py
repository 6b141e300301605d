"""Lenient decoding of job rows, learner state, video metadata and worker events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlake.functions.events import is_live
from quizlake.operators.events import EVENT_TYPES

# --- fixed values -----------------------------------------------------------------
INTERVAL_DEFAULT = 5.0
STATE_VERSION = 1
CAPTURE_MODES = ("mode_a", "mode_b")
# -----------------------------------------------------------------------------------


def finite_or(c: Column, default: float) -> Column:
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c).otherwise(F.lit(default))


def decode_requests(rows: DataFrame) -> DataFrame:
    """Flattened request union: kind inferred from the path, remote rows get an interval."""
    kind = F.coalesce("request_kind", F.when(F.col("request_file_path").isNotNull(), "local").otherwise(F.lit("remote")))
    local = (kind == "local") & (F.coalesce("request_file_path", F.lit("")) != "")
    keep = [c for c in rows.columns if not c.startswith("request_")]
    return rows.select(
        *keep,
        F.when(local, "local").otherwise(F.lit("remote")).alias("kind"),
        F.when(local, F.col("request_file_path")).alias("file_path"),
        F.when(~local, F.col("request_url")).alias("url"),
        F.when(~local, finite_or(F.col("request_interval_sec"), INTERVAL_DEFAULT)).alias("interval_sec"),
    )


def encode_requests(rows: DataFrame) -> DataFrame:
    """Inverse of `decode_requests`: the stored request columns."""
    local = F.col("kind") == "local"
    keep = [c for c in rows.columns if c not in ("kind", "file_path", "url", "interval_sec")]
    return rows.select(
        *keep,
        F.col("kind").alias("request_kind"),
        F.when(local, F.regexp_extract("file_path", r"([^/\\]+)[/\\]*$", 1)).otherwise(F.col("url")).alias("request_url"),
        F.when(local, F.col("file_path")).alias("request_file_path"),
        F.when(local, F.lit(0.0)).otherwise(F.col("interval_sec")).alias("request_interval_sec"),
    )


def decode_rows(rows: DataFrame) -> DataFrame:
    """The job row beyond its request: unknown capture modes and empty presets are null, other
    presets the default one, an error needs both code and message, numbers that are not finite
    are 0 (or null where the column may be), `fallback_required` is a flag, and capture
    settings come from their JSON, none if it is broken. Other columns stay as they are."""
    from quizlake.operators.frame_filters import DEFAULT_PRESET, PRESETS

    mode = lambda c: F.when(F.col(c).isin(*CAPTURE_MODES), F.col(c)).alias(c)
    both = (F.coalesce("error_code", F.lit("")) != "") & (F.coalesce("error_message", F.lit("")) != "")
    number = lambda c: F.when(F.col(c).isNotNull(), finite_or(F.col(c).cast("double"), 0.0)).alias(c)
    zero = lambda c: finite_or(F.col(c).cast("double"), 0.0).alias(c)
    known = F.col("extraction_preset").isin(*[p[0] for p in PRESETS])
    preset = F.when(F.col("extraction_preset") != "", F.when(known, F.col("extraction_preset")).otherwise(F.lit(DEFAULT_PRESET)))
    capture = F.try_parse_json("advanced_capture_json")
    setting = lambda k: F.try_variant_get(capture, f"$.{k}", "double")
    made = {
        "mode_planned": mode("mode_planned"), "mode_used": mode("mode_used"),
        "fallback_required": F.coalesce(F.col("fallback_required") == 1, F.lit(False)).alias("fallback_required"),
        "error_code": F.when(both, F.col("error_code")).alias("error_code"),
        "error_message": F.when(both, F.col("error_message")).alias("error_message"),
        "progress_percent": zero("progress_percent"), "skipped_blank": zero("skipped_blank"), "skipped_duplicate": zero("skipped_duplicate"),
        "video_duration_sec": number("video_duration_sec"), "last_mcq_count": number("last_mcq_count"),
        "local_fps_interval_sec": number("local_fps_interval_sec"), "local_cooldown_sec": number("local_cooldown_sec"),
        "local_smart_change_threshold": number("local_smart_change_threshold"),
        "extraction_preset": preset.alias("extraction_preset"),
        "advanced_capture_json": F.struct(
            setting("fpsIntervalSeconds").alias("interval_sec"), setting("cooldownSeconds").alias("cooldown_sec"),
            setting("changeThreshold").alias("change_threshold")).alias("advanced_capture"),
    }
    return rows.select(*[made.get(c, F.col(c)) for c in rows.columns])


def learner_state(raw: Column) -> Column:
    """Versioned learner state; any fault gives the empty state, non-strings are dropped."""
    parsed = F.try_parse_json(raw)
    good = F.try_variant_get(parsed, "$.version", "int") == STATE_VERSION

    def ids(field: str) -> Column:
        items = F.try_variant_get(parsed, f"$.{field}", "array<variant>")
        texts = F.transform(
            F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string")
        )
        return F.coalesce(F.when(good, texts), F.array().cast("array<string>"))

    return F.struct(
        F.lit(STATE_VERSION).alias("version"),
        ids("bookmarkedQuestionIds").alias("bookmarked"),
        ids("solvedQuestionIds").alias("solved"),
    )


def video_metadata(raw: Column) -> Column:
    meta = F.from_json(raw, "id string, title string, is_live boolean, live_status string")
    return F.struct(
        meta["id"].alias("video_id"), meta["title"].alias("title"), is_live(meta["is_live"], meta["live_status"]).alias("live")
    )


def worker_events(lines: DataFrame, body: str = "value") -> DataFrame:
    """Worker output lines to events; malformed lines and unknown types are skipped. Works
    on batch and streaming frames."""
    event = F.from_json(
        F.col(body), "type string, stage string, message string, current int, total int, outPath string"
    )
    keep = [c for c in lines.columns if c != body]
    return lines.select(*keep, event.alias("_e")).select(*keep, "_e.*").filter(F.col("type").isin(*EVENT_TYPES))
