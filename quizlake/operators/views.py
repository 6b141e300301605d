"""Filtered views over frames, questions and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlake.functions import text as tx
from quizlake.operators.ranking import top_share

# --- fixed values -----------------------------------------------------------------
SLIDE_RATIO = 0.2
HEAVY_CHARS = 120
BEST_SHARE = 0.55
QUESTION_SCORE, INCLUDED_SCORE, TEXT_SCORE_MAX, TEXT_SCORE_CHARS = 2.0, 1.5, 1.2, 400.0
# -----------------------------------------------------------------------------------


def question_flags(frames: DataFrame) -> DataFrame:
    text = F.coalesce("ocr_text", F.lit(""))
    return frames.select(
        "job_id",
        "frame_idx",
        tx.question_mark(text).alias("has_question_mark"),
        tx.mcq_style(text).alias("mcq_style"),
        tx.roman_enumeration(text).alias("roman_enumeration"),
    )


def _asks(text: Column) -> Column:
    return tx.question_mark(text) | tx.mcq_style(text)


def questions_view(frames: DataFrame) -> DataFrame:
    text = F.coalesce("ocr_text", F.lit(""))
    asks = (tx.trim_web(text) != "") & _asks(text)
    # Told by a generator of one row, which no filter passes: a plain filter goes below the columns that make the
    # text, and makes it anew, words and all, wherever its condition names it.
    return frames.select("*", F.explode_outer(F.array(asks)).alias("_asks")).filter("_asks").drop("_asks")


def slides_view(frames: DataFrame) -> DataFrame:
    return frames.filter(F.col("change_ratio") >= SLIDE_RATIO)


def text_heavy_view(frames: DataFrame) -> DataFrame:
    """Long frames. Long text implies text, so no per-job signal is needed to filter."""
    return frames.filter(F.length("ocr_text") > HEAVY_CHARS)


def text_signal(frames: DataFrame) -> DataFrame:
    """Whether a job has any recognised text at all."""
    return frames.groupBy("job_id").agg(
        F.coalesce(F.bool_or(F.length("ocr_text") > 0), F.lit(False)).alias("has_text")
    )


def included(c: Column | str = "include_in_pdf") -> Column:
    return F.coalesce(c, F.lit(True))


def usable_frames(frames: DataFrame) -> DataFrame:
    return frames.filter((tx.trim_web(F.coalesce("ocr_text", F.lit(""))) != "") & included())


def kept_frames(frames: DataFrame) -> DataFrame:
    return frames.filter(included())


def best_score(frames: DataFrame) -> DataFrame:
    text = F.coalesce("ocr_text", F.lit(""))
    score = (
        F.when(_asks(text), QUESTION_SCORE).otherwise(0.0)
        + F.when(included(), INCLUDED_SCORE).otherwise(0.0)
        + F.least(F.lit(TEXT_SCORE_MAX), F.length(text) / TEXT_SCORE_CHARS)
        + F.col("change_ratio")
    )
    return frames.withColumn("score", score)


def best_frames(frames: DataFrame) -> DataFrame:
    """Top 55 % of each job by score; ties keep frame order."""
    scored = best_score(frames).select("job_id", "frame_idx", "name", "score")
    return top_share(scored, ["job_id"], "score", "frame_idx", BEST_SHARE)


def first_of_groups(grouped: DataFrame) -> DataFrame:
    """First frame of every duplicate group: its order value is the group's `rep`."""
    return grouped.filter(F.col("frame_idx") == F.col("rep"))


def group_sizes(grouped: DataFrame) -> DataFrame:
    """Frames per group, counted with map-side combine instead of a window over the group."""
    return grouped.groupBy("job_id", "rep").agg(F.count(F.lit(1)).alias("group_size"))


def with_topic(questions: DataFrame, needle: str) -> DataFrame:
    wanted = needle.strip().lower()
    return questions.filter(F.exists("topics", lambda t: F.lower(t).contains(wanted)))


def unsolved(questions: DataFrame, solved: DataFrame, keys: list[str]) -> DataFrame:
    return questions.join(solved, keys, "left_anti")


def solved_only(questions: DataFrame, solved: DataFrame, keys: list[str]) -> DataFrame:
    return questions.join(solved, keys, "left_semi")


def finished(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("state") == "done")


def artifact_paths(artifacts: DataFrame) -> DataFrame:
    return artifacts.select("job_id", "kind", "path")
