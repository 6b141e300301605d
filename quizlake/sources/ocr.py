"""Recognition output: word tables, line arrays, text bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizlake.functions.text import trim_doc

# --- fixed values -----------------------------------------------------------------
WORD_LEVEL = 5
TEXT_CONFIDENCE, NO_TEXT_CONFIDENCE = 70.0, 0.0
UNIT_SCALE_MAX, UNIT_SCALE_FACTOR = 1.5, 100.0
# Columns of a recognised-word file.
WORD_COLUMNS = (
    "level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text",
)
# -----------------------------------------------------------------------------------


def read_word_tables(spark: SparkSession, path: str) -> DataFrame:
    """Word files, one per frame: (path, word_no, level, conf, word). A file is one frame,
    so it is read whole; its own line order is the word order."""
    files = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), F.posexplode(F.split("value", "\r?\n", -1)).alias("word_no", "line")
    )
    cells = F.split("line", "\t", -1)
    return files.filter(F.size(cells) >= len(WORD_COLUMNS)).select(
        "path",
        F.col("word_no").cast("bigint").alias("word_no"),
        F.try_to_number(trim_doc(cells[0]), F.lit("999999")).cast("int").alias("level"),
        cells[10].try_cast("double").alias("conf"),
        cells[11].alias("word"),
    )


def words_to_text(words: DataFrame, keys: tuple[str, ...] = ("job_id", "frame_idx")) -> DataFrame:
    """Text and mean confidence per frame. Only word rows with a non-negative confidence
    count; words are joined as they are, blank ones too."""
    usable = F.coalesce((F.col("level") == WORD_LEVEL) & (F.col("conf") >= 0), F.lit(False))
    grouped = words.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(usable, F.struct("word_no", F.coalesce("word", F.lit("")).alias("w"))))).alias("_w"),
        F.avg(F.when(usable, F.col("conf"))).alias("_mean"),
    )
    text = F.array_join(F.transform("_w", lambda x: x["w"]), " ")
    return grouped.select(*keys, text.alias("text"), "_mean").select(
        *keys,
        "text",
        F.coalesce(
            "_mean", F.when(F.col("text") != "", F.lit(TEXT_CONFIDENCE)).otherwise(F.lit(NO_TEXT_CONFIDENCE))
        ).alias("mean_confidence"),
    )


def display_scale(scores: Column) -> Column:
    """Scores given as 0..1 become 0..100."""
    unit = F.array_max(scores) <= UNIT_SCALE_MAX
    return F.when(unit, F.transform(scores, lambda s: s * UNIT_SCALE_FACTOR)).otherwise(scores)


def lines_to_text(results: DataFrame, keys: tuple[str, ...] = ("job_id", "frame_idx")) -> DataFrame:
    """Recognised line arrays (rec_texts, rec_scores) to text and mean confidence. Blank
    lines go, missing scores are 0."""
    pairs = F.filter(
        F.arrays_zip("rec_texts", "rec_scores"),
        lambda p: p["rec_texts"].isNotNull() & (trim_doc(p["rec_texts"]) != ""),
    )
    scores = display_scale(F.transform(pairs, lambda p: F.coalesce(p["rec_scores"], F.lit(0.0))))
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.when(F.size(scores) > 0, F.size(scores))
    return results.select(
        *keys,
        F.array_join(F.transform(pairs, lambda p: trim_doc(p["rec_texts"])), "\n").alias("text"),
        F.coalesce(mean, F.lit(0.0)).alias("mean_confidence"),
    )


def nested_lines(pages: Column) -> tuple[Column, Column]:
    """Texts and scores of the older nested form: array(page) of array(line) of
    (box, (text, score))."""
    flat = F.flatten(F.filter(pages, lambda p: p.isNotNull()))
    return F.transform(flat, lambda x: x["result"]["text"]), F.transform(flat, lambda x: x["result"]["score"])


BUNDLE_ITEM = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("meanConfidence", T.StringType()),
        T.StructField("mean_confidence", T.StringType()),
    ]
)


def parse_bundles(bundles: DataFrame, keys: tuple[str, ...] = ("job_id",), body: str = "body") -> DataFrame:
    """Text bundles (one JSON array per row) to frames. Elements that are not objects are
    dropped before counting; lenient names and confidences."""
    elements = F.filter(
        F.from_json(F.col(body), "array<string>"), lambda e: F.coalesce(e.startswith("{"), F.lit(False))
    )
    items = bundles.select(*keys, F.posexplode(elements).alias("idx", "element")).withColumn(
        "item", F.from_json("element", BUNDLE_ITEM)
    )
    given = F.coalesce("item.meanConfidence", "item.mean_confidence")
    return items.select(
        *keys,
        F.col("idx").cast("bigint").alias("frame_idx"),
        F.coalesce(F.nullif("item.name", F.lit("")), F.concat(F.lit("frame_"), F.col("idx"))).alias("name"),
        F.coalesce("item.text", F.lit("")).alias("ocr_text"),
        F.coalesce(given.try_cast("double"), F.lit(TEXT_CONFIDENCE)).alias("ocr_confidence"),
    )


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Bundle files, one per job; the job id is the parent folder."""
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("job_id"), F.col("value").alias("body")
    )
    return parse_bundles(files)
