"""Input views derived from the given tables.

The tables hold prose, events and vectors; frames, questions, grids, jobs and logs are
derived from whole tables and whole texts. Each view has a DataFrame form here and an
equal SQL form (for the oracle) in `VIEW_SQL`.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake.operators.ranking import BUCKET_WIDTH, ordinal, previous, span


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("job_id"), "doc_id", "text", "n_chars"
    )
    return ordinal(docs, ["job_id"], [F.col("doc_id")], span("doc_id"), name="frame_idx")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered_documents(spark, sf_dir).select(
        "job_id",
        "frame_idx",
        F.format_string("frame_%06d.png", "frame_idx").alias("name"),
        (F.col("frame_idx") - 1).cast("double").alias("seconds"),
        (((F.col("doc_id") * 37) % 100).cast("double") / F.lit(100.0)).alias("change_ratio"),
        F.col("text").alias("ocr_text"),
        (50 + F.col("n_chars") % 51).cast("double").alias("ocr_confidence"),
        F.when(F.col("doc_id") % 7 == 0, F.lit(False))
        .when(F.col("doc_id") % 3 != 0, F.lit(True))
        .alias("include_in_pdf"),
    )


# A text is cut into blocks of about this many words; every word lands in one block.
BLOCK_WORDS = 96


def _block_text(join) -> str:
    """SQL for one block from word slices. Layout variety: lettered options, Q form with a
    stray line, stem plus inline line, leading inline block, inline on the stem line,
    repeated letter plus E, hyphen wrap, no question."""
    stem = join("lo + 1", "hi - 5 * g")
    o = [join(f"hi - {5 - i} * g + 1", f"hi - {4 - i} * g") for i in range(5)]
    n = "CAST(c + 1 AS STRING)"
    parts = {
        0: [n, "'. '", stem, "'?'", "nl", "'A) '", o[0], "nl", "'B) '", o[1], "nl", "'C) '", o[2],
            "nl", "'D) '", o[3], "nl", o[4]],
        1: ["'Q'", n, "': '", stem, "nl", "'(a): '", o[0], "nl", "'(b): '", o[1], "nl", o[4], "nl",
            "'(c): '", o[2], "nl", o[3]],
        2: [n, "') '", stem, "nl", "'(A) '", o[0], "' (B) '", o[1], "' (C) '", o[2], "' (D) '",
            o[3], "nl", o[4]],
        3: ["'(A) '", o[0], "' (B) '", o[1], "nl", "'(C) '", o[2], "' (D) '", o[3], "nl", "nl", n,
            "'. '", stem, "nl", "'A. '", o[0], "nl", "'B. '", o[4]],
        4: ["'Question '", n, "'. '", stem, "' (A) '", o[0], "' (B) '", o[1], "nl", o[2], "' '",
            o[3], "' '", o[4]],
        5: [n, "'. '", stem, "nl", "'A. '", o[0], "nl", "'A. '", o[1], "nl", "'E. '", o[2], "nl",
            o[3], "' '", o[4]],
        6: [n, "'. '", stem, "'-'", "nl", o[4], "nl", "'A) '", o[0], "nl", "'B) '", o[1], "nl",
            "'C) '", o[2], "nl", "'D) '", o[3]],
        7: [stem, "nl", o[0], "nl", o[1], "nl", o[2], "' '", o[3], "' '", o[4]],
    }
    whens = " ".join(f"WHEN {k} THEN concat({', '.join(v)})" for k, v in parts.items())
    sep = "CASE WHEN c = 0 THEN '' WHEN c % 3 = 0 THEN nl ELSE concat(nl, nl) END"
    text = f"concat({sep}, CASE (doc_id + c) % 8 {whens} END)"
    return text.replace(" nl", " chr(10)").replace("(nl", "(chr(10)")


def _spark_join(lo: str, hi: str) -> str:
    # By number: a slice copies all words of a text, for every part of every block. What is done per
    # word is not compiled, so the places are counted from zero once.
    return f"array_join(transform(sequence(CAST({lo} AS INT) - 1, CAST({hi} AS INT) - 1), i -> words[i]), ' ')"


def _duck_join(lo: str, hi: str) -> str:
    return f"array_to_string(list_slice(words, {lo}, {hi}), ' ')"


def _bounds(expr: str, div: str) -> str:
    """Put block bounds and option size in place of lo, hi and g."""
    lo = f"((c * n_words) {div} n_blocks)"
    hi = f"(((c + 1) * n_words) {div} n_blocks)"
    g = f"greatest(1, ({hi} - {lo}) {div} 16)"
    out = expr
    for name, value in (("lo", lo), ("hi", hi), ("g", g)):
        out = re.sub(rf"(?<![\w.(]){name}(?![\w(])|(?<=\(){name}(?![\w(])", value, out)
    return out


def mcq_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr(
        "source AS job_id", "doc_id", "CAST(40 + n_chars % 61 AS DOUBLE) AS conf", "text")
    # Texts are numbered and dealt as they are, since words take far more room. They are split once: used
    # more than once above, neither the words nor their number is inlined there.
    docs = ordinal(docs, ["job_id"], [F.col("doc_id")], span("doc_id"), name="frame_idx")
    docs = docs.selectExpr(
        "job_id", "doc_id", "frame_idx", "conf", "array_remove(split(replace(text, chr(10), ' '), ' '), '') AS words")
    docs = docs.withColumn("n_words", F.size("words").cast("bigint"))
    docs = docs.withColumn("n_blocks", F.expr(f"greatest(1, n_words div {BLOCK_WORDS})"))
    block = _bounds(_block_text(_spark_join), "div")
    return docs.selectExpr(
        "job_id",
        "frame_idx",
        "format_string('frame_%06d.png', frame_idx) AS name",
        "conf AS ocr_confidence",
        "CASE WHEN n_words < 12 THEN array_join(words, ' ') ELSE "
        f"array_join(transform(sequence(0L, n_blocks - 1), c -> {block}), '') END AS ocr_text",
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of job rows: one per event."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS job_id",
        "event_id AS version",
        "ts AS updated_at",
        "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'probing' "
        "WHEN 'click' THEN 'extracting' WHEN 'purchase' THEN 'done' ELSE 'failed' END AS state",
        "CAST(floor(value) AS INT) AS skipped_blank",
        "CAST(event_id % 40 AS INT) AS skipped_duplicate",
        "CASE event_type WHEN 'error' THEN concat('worker exited with code ', "
        "CAST(event_id % 3 AS STRING)) WHEN 'view' THEN concat('Unable to download video: ', "
        "CASE event_id % 4 WHEN 0 THEN 'HTTP 429' WHEN 1 THEN 'Private video' "
        "WHEN 2 THEN 'connection timed out' ELSE 'ffmpeg not found' END) END AS error_message",
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS job_id", "event_id AS seq", "ts", "event_type AS stage", "value"
    )


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 luma grids, row major; some flat, some copied from the frame before."""
    vectors = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    vectors = previous(
        vectors, ["label"], "vec_id", F.col("embedding"), span("vec_id", BUCKET_WIDTH), "_prev"
    )
    return vectors.selectExpr(
        "label AS job_id",
        "vec_id AS frame_idx",
        "CASE WHEN vec_id % 37 <> 5 THEN transform("
        "CASE WHEN vec_id % 5 = 1 THEN coalesce(_prev, embedding) ELSE embedding END, "
        "x -> greatest(0D, least(255D, 128D + (CASE WHEN vec_id % 11 = 0 THEN 10D ELSE 400D END)"
        " * CAST(x AS DOUBLE)))) END AS grid",
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every frame text, in order."""
    return frames(spark, sf_dir).selectExpr(
        "job_id", "frame_idx", "posexplode(split(ocr_text, '\\n', -1)) AS (line_no, line)"
    ).withColumn("line_no", F.col("line_no").cast("bigint"))


_DUCK_DOCS = """SELECT source AS job_id, doc_id, text, n_chars,
 row_number() OVER (PARTITION BY source ORDER BY doc_id) AS frame_idx FROM documents"""

VIEW_SQL = {
    "v_frames": f"""SELECT job_id, frame_idx, printf('frame_%06d.png', frame_idx) AS name,
 CAST(frame_idx - 1 AS DOUBLE) AS seconds,
 CAST((doc_id * 37) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS change_ratio,
 text AS ocr_text,
 CAST(50 + n_chars % 51 AS DOUBLE) AS ocr_confidence,
 CASE WHEN doc_id % 7 = 0 THEN false WHEN doc_id % 3 = 0 THEN NULL ELSE true END AS include_in_pdf
 FROM ({_DUCK_DOCS})""",
    "v_mcq": f"""SELECT job_id, frame_idx, printf('frame_%06d.png', frame_idx) AS name,
 conf AS ocr_confidence,
 CASE WHEN n_words < 12 THEN array_to_string(words, ' ') ELSE
 array_to_string(list_transform(range(0, n_blocks), lambda c: {_bounds(_block_text(_duck_join), '//')}), '')
 END AS ocr_text
 FROM (SELECT *, greatest(1, n_words // {BLOCK_WORDS}) AS n_blocks FROM (
  SELECT *, len(words) AS n_words FROM (
   SELECT job_id, frame_idx, doc_id, CAST(40 + n_chars % 61 AS DOUBLE) AS conf,
    list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda w: w <> '') AS words
   FROM ({_DUCK_DOCS}))))""",
    "v_jobs": """SELECT user_id AS job_id, event_id AS version, ts AS updated_at,
 CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'probing' WHEN 'click' THEN 'extracting'
  WHEN 'purchase' THEN 'done' ELSE 'failed' END AS state,
 CAST(floor(value) AS INT) AS skipped_blank, CAST(event_id % 40 AS INT) AS skipped_duplicate,
 CASE event_type WHEN 'error' THEN concat('worker exited with code ', CAST(event_id % 3 AS STRING))
  WHEN 'view' THEN concat('Unable to download video: ', CASE event_id % 4 WHEN 0 THEN 'HTTP 429'
   WHEN 1 THEN 'Private video' WHEN 2 THEN 'connection timed out' ELSE 'ffmpeg not found' END) END AS error_message
 FROM events""",
    "v_logs": "SELECT user_id AS job_id, event_id AS seq, ts, event_type AS stage, value FROM events",
    "v_grids": """SELECT label AS job_id, vec_id AS frame_idx,
 CASE WHEN vec_id % 37 = 5 THEN NULL ELSE list_transform(e, lambda x: greatest(0::double, least(255::double,
  128::double + (CASE WHEN vec_id % 11 = 0 THEN 10::double ELSE 400::double END) * x::double))) END AS grid
 FROM (SELECT *, CASE WHEN vec_id % 5 = 1 THEN coalesce(lag(embedding) OVER (PARTITION BY label ORDER BY vec_id),
  embedding) ELSE embedding END AS e FROM embeddings) z""",
    "v_lines": """SELECT job_id, frame_idx, CAST(i - 1 AS BIGINT) AS line_no, parts[i] AS line FROM (
 SELECT job_id, frame_idx, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
  SELECT job_id, frame_idx, string_split(ocr_text, chr(10)) AS parts FROM v_frames))""",
}
