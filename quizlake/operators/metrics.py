"""Aggregates over frames, questions and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlake.functions import text as tx
from quizlake.operators.questions import draft_order
from quizlake.operators.ranking import top_n

# --- fixed values -----------------------------------------------------------------
KEYWORDS = r"(?i)(?:what|which|why|how|select|choose|assertion|reason|fill in|true|false)"
MIN_TEXT, MIN_RAW, MIN_KEY, MIN_COUNT = 12, 15, 12, 2
TOP_STEMS, TOP_STEMS_SHOWN = 12, 8
DROPPED_SECONDS, KEPT_SECONDS = 8, 3
SLIDE_RATIO, TOPIC_BASE, SLIDE_WEIGHT, STEM_WEIGHT, TOPIC_LIMITS = 0.18, 6, 0.28, 1.4, (6, 64)
JUNK_MAX = 99
# -----------------------------------------------------------------------------------


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def stem_counts(frames: DataFrame) -> DataFrame:
    """Repeated lines of question-like frames, with first frame and first position."""
    text = tx.trim_web(F.col("ocr_text"))
    numbered = rf"(?m)^{tx.WEB_SPACE}*\d+[.)]{tx.WEB_SPACE}+([^\n\r\x{{2028}}\x{{2029}}]+)"
    lines = (
        frames.select("job_id", "frame_idx", "name", text.alias("text"))
        .filter((F.length("text") >= MIN_TEXT) & F.col("text").rlike(KEYWORDS))
        .select("job_id", "frame_idx", "name", F.posexplode(F.split("text", "\n+", -1)).alias("line_no", "line"))
    )
    body = F.coalesce(F.nullif(F.regexp_extract("line", numbered, 1), F.lit("")), F.col("line"))
    keyed = (
        lines.withColumn("raw", tx.trim_web(body))
        .filter(F.length("raw") >= MIN_RAW)
        .withColumn("stem", tx.frequency_key("raw"))
        .filter(F.length("stem") >= MIN_KEY)
    )
    place = draft_order(F.col("frame_idx"), F.col("line_no"))
    return (
        keyed.groupBy("job_id", "stem")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.min_by("name", place).alias("sample_frame"),
            F.min(place).alias("first_order"),
        )
        .filter(F.col("count") >= MIN_COUNT)
    )


def top_stems(frames: DataFrame, limit: int = TOP_STEMS) -> DataFrame:
    order = [F.desc("count"), F.asc("first_order")]
    return top_n(stem_counts(frames), ["job_id"], order, limit, F.col("stem")).drop("first_order")


def topic_count(questions: DataFrame) -> DataFrame:
    """Distinct trimmed lower-case topics per job, NULL when there are none."""
    topic = F.lower(tx.trim_web(F.col("topic")))
    return (
        questions.select("job_id", F.explode_outer("topics").alias("topic"))
        .groupBy("job_id")
        .agg(F.count_distinct(F.when(topic != "", topic)).alias("n"))
        .select("job_id", F.nullif("n", F.lit(0)).alias("topic_count"))
    )


def topic_estimate(frames: DataFrame, stems: DataFrame) -> DataFrame:
    slides = frames.groupBy("job_id").agg(F.count_if(F.col("change_ratio") >= SLIDE_RATIO).alias("slides"))
    anchors = stems.filter(F.col("count") >= MIN_COUNT).groupBy("job_id").agg(F.count(F.lit(1)).alias("anchors"))
    blended = round_half_up(
        F.lit(float(TOPIC_BASE)) + F.col("slides") * SLIDE_WEIGHT + F.coalesce("anchors", F.lit(0)) * STEM_WEIGHT
    )
    low, high = TOPIC_LIMITS
    return slides.join(anchors, "job_id", "left").select(
        "job_id", F.greatest(F.lit(low), F.least(F.lit(high), blended)).cast("bigint").alias("topic_estimate")
    )


def time_saved_minutes(dropped: Column, kept: Column) -> Column:
    seconds = dropped * DROPPED_SECONDS + kept * KEPT_SECONDS
    return F.greatest(F.lit(0), round_half_up(seconds / 60)).cast("bigint")


def junk_percent(dropped: Column, kept: Column) -> Column:
    total = dropped + kept
    share = F.least(F.lit(JUNK_MAX), round_half_up(dropped / F.when(total > 0, total) * 100))
    return F.coalesce(share, F.lit(0)).cast("bigint")


def job_savings(jobs: DataFrame, frames: DataFrame) -> DataFrame:
    """Kept and dropped frames per job with both derived figures."""
    kept = frames.groupBy("job_id").agg(F.count(F.lit(1)).alias("kept"))
    dropped = F.col("skipped_blank") + F.col("skipped_duplicate")
    return (
        jobs.join(kept, "job_id", "left")
        .select("job_id", dropped.cast("bigint").alias("dropped"), F.coalesce("kept", F.lit(0)).alias("kept"))
        .select(
            "*",
            time_saved_minutes(F.col("dropped"), F.col("kept")).alias("minutes_saved"),
            junk_percent(F.col("dropped"), F.col("kept")).alias("junk_percent"),
        )
    )


def token_counts(questions: DataFrame, key: str) -> DataFrame:
    """Token multiset of every stem."""
    return (
        questions.select(key, F.explode(tx.jaccard_tokens("stem")).alias("token"))
        .groupBy(key, "token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
