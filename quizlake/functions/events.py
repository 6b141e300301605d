"""Columns over pipeline events and error texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizlake.functions.text import trim_web

# --- fixed values -----------------------------------------------------------------
TRANSIENT_PIPELINE = ("worker exited", "exited with code", "econnreset", "spawn enoent", "timed out", "epipe")
TRANSIENT_MODEL = (
    "econnreset", "timed out", "timeout", "aborted", "429", "503", "502",
    "mcq ocr worker finished without", "worker thread exited",
)
STAGE_PHASE = {"llm": "ai", "pdf": "pdf", "dedupe": "detecting", "ocr": "extracting", "init": "scanning"}
DEFAULT_PHASE = "extracting"
TERMINAL_STATES = ("done", "failed", "fallback_required", "cancelled")
TRANSITIONS = {
    "queued": ("probing", "paused", "cancelled"),
    "probing": ("downloading", "extracting", "fallback_required", "failed", "paused", "cancelled"),
    "downloading": ("extracting", "fallback_required", "failed", "paused", "cancelled"),
    "extracting": ("filtering", "fallback_required", "failed", "paused", "cancelled"),
    "filtering": ("building_pdf", "failed", "paused", "cancelled"),
    "building_pdf": ("done", "failed", "paused", "cancelled"),
    "paused": ("probing", "downloading", "extracting", "filtering", "building_pdf", "cancelled"),
    "done": (),
    "failed": (),
    "fallback_required": (),
    "cancelled": (),
}
DECODER_NOISE = (
    r"Late SEI is not implemented",
    r"If you want to help, upload a sample of this file",
    r"(?i)^\[h264\s+@",
    r"(?i)^\[warn\]\s*\[h264",
    r"(?is)(?=.*is not implemented)(?=.*(?:ffmpeg|git))",
    r"Update your FFmpeg version to the newest one from Git",
    r"(?i)^\[out#0/image2",
    r"muxing overhead: unknown",
)
# -----------------------------------------------------------------------------------


def micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970 of an instant, or of the wall clock of a zoneless time."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col(ts))
    return F.unix_micros(F.col(ts))


def _contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | text.contains(needle)
    return found


def error_code(message: Column) -> Column:
    m = F.lower(message)
    return (
        F.when(_contains_any(m, ("forbidden", "private", "members-only", "drm")), "protected_content")
        .when(m.contains("not found") & _contains_any(m, ("ffmpeg", "yt-dlp")), "binary_missing")
        .when(_contains_any(m, ("permission", "enoent", "eacces")), "path_permission")
        .when(_contains_any(m, ("invalid", "url")), "validation")
        .when(_contains_any(m, ("network", "timed out", "unable to download")), "network")
        .when(m.isNotNull(), "unknown")
    )


def error_category(message: Column, code: Column) -> Column:
    """Category shown for a failed job; message rules come before the code."""
    m = F.lower(message)
    return (
        F.when(_contains_any(m, ("worker exited", "exited with code")), "helper_stopped")
        .when(_contains_any(m, ("tesseract", "ocr engine")), "recognition_failed")
        .when(_contains_any(m, ("paddle", "python")), "engine_not_started")
        .when(code.isin("binary_missing", "path_permission", "network"), code)
        .when(m.isNotNull(), "other")
    )


def transient_pipeline(message: Column) -> Column:
    return F.coalesce(_contains_any(F.lower(message), TRANSIENT_PIPELINE), F.lit(False))


def transient_model(message: Column) -> Column:
    return F.coalesce(_contains_any(F.lower(message), TRANSIENT_MODEL), F.lit(False))


def stage_phase(stage: Column) -> Column:
    out = F.lit(DEFAULT_PHASE)
    for name, phase in STAGE_PHASE.items():
        out = F.when(stage == name, F.lit(phase)).otherwise(out)
    return out


def is_terminal(state: Column) -> Column:
    return state.isin(*TERMINAL_STATES)


def allowed_transition(before: Column, after: Column) -> Column:
    """The edge table is fixed and small, so it is a predicate rather than a join."""
    out = F.lit(False)
    for source, targets in TRANSITIONS.items():
        if targets:
            out = out | ((before == source) & after.isin(*targets))
    return out


def decoder_noise(line: Column) -> Column:
    text = trim_web(line)
    out = text == ""
    for pattern in DECODER_NOISE:
        out = out | text.rlike(pattern)
    return out


def decoded_seconds(line: Column) -> Column:
    """Seconds from `time=HH:MM:SS.ff`, NULL when absent."""
    pattern = r"time=(\d+):(\d+):(\d+\.\d+)"
    part = lambda i: F.nullif(F.regexp_extract(line, pattern, i), F.lit("")).cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3)


def is_live(is_live_flag: Column, live_status: Column) -> Column:
    return F.coalesce(is_live_flag, F.lit(False)) | F.lower(F.coalesce(live_status, F.lit(""))).isin(
        "is_live", "is_upcoming", "post_live"
    )


def valid_title(title: Column) -> Column:
    return F.length(trim_web(title)).between(1, 200)
