"""Question mining: text frames -> lines -> blocks -> drafts -> bank.

Reading a frame top to bottom is a three-state scan (outside / inside a block / skipping
after an inline block). It is expressed with running counts per frame:

* a blank line starts a new paragraph and ends whatever was open;
* inside a paragraph every stem label opens block n;
* a block is closed by its fourth distinct option letter;
* outside a block, or on a stem label, an inline-option line that yields two options
  consumes the rest of its paragraph. The first such line is all that matters.

All windows partition by a prefix of (job, frame, ...), so one shuffle on (job, frame), of
whole frames, serves every step; a frame is one input row, so no window is larger than one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizlake.functions import text as tx
from quizlake.operators.ranking import ordinal
from quizlake.session import spread

FRAME = ["job_id", "frame_idx"]
# --- fixed values -----------------------------------------------------------------
INLINE_STEM = "(inline options)"
BLOCK_FULL = 4
MIN_OPTIONS = 2
MIN_STEM = 4
INLINE_SPAN = 4
BLOB_MARKS = ("(A)", "(B)", "(C)", "(D)")
BLOB_MIN_MARKS = 3
BLOB_STEM_CHARS = 2000
BLOB_FACTOR = 0.7
DEFAULT_CONFIDENCE = 70.0
# -----------------------------------------------------------------------------------
LINE_BITS = 24


def draft_order(frame_idx: Column, line_no: Column) -> Column:
    """One sortable number per draft: frame, then first line inside the frame. Numbers that do
    not fit raise, rather than meet those of another frame."""
    frame, line = frame_idx.cast("bigint"), line_no.cast("bigint")
    fits = (F.shiftright(line, LINE_BITS) == 0) & (F.shiftright(frame, 63 - LINE_BITS) == 0)
    order = F.shiftleft(frame, LINE_BITS).bitwiseOR(line)
    return F.when(fits | frame.isNull() | line.isNull(), order).otherwise(
        F.raise_error("a frame or line number is too large for the draft order").cast("bigint"))


def frame_confidence(mean: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean / 100.0))


def frame_stats(frames: DataFrame) -> DataFrame:
    """Recognition statistics of a frame and the confidence its questions inherit."""
    mean = F.coalesce(F.col("ocr_confidence"), F.lit(DEFAULT_CONFIDENCE))
    return frames.select(
        *FRAME,
        "name",
        F.round(mean, 4).alias("mean_confidence"),
        F.length(F.coalesce("ocr_text", F.lit(""))).alias("char_count"),
        frame_confidence(mean).alias("confidence"),
    )


def classified_lines(frames: DataFrame) -> DataFrame:
    """One row per line with its role flags. What a draft inherits from its frame (name,
    confidence, fallback stem on the first line) rides along, so no join back is needed."""
    rows = frames.select(
        *FRAME,
        "name",
        frame_confidence(F.coalesce("ocr_confidence", F.lit(DEFAULT_CONFIDENCE))).alias("confidence"),
        F.transform(F.split(F.coalesce("ocr_text", F.lit("")), "\n", -1), tx.rtrim_doc).alias("lines"),
    ).withColumn("_text", F.array_join("lines", "\n"))
    # No other character becomes one of these letters in upper case.
    held = lambda m: (F.col("_text").contains(m) | F.col("_text").contains(m.lower())).cast("int")
    marks = sum(map(held, BLOB_MARKS), F.lit(0))
    blob = F.when(marks >= BLOB_MIN_MARKS, F.substring("_text", 1, BLOB_STEM_CHARS))
    # A text has a line at least; a plain explode would filter on the lines, and so make them anew.
    lines = rows.withColumn("blob", blob).select(
        *FRAME, "name", "confidence", "blob", F.posexplode_outer("lines").alias("line_no", "raw")
    )
    body = F.col("body")
    return lines.withColumn("body", tx.trim_doc(F.col("raw"))).select(
        *FRAME,
        F.col("line_no").cast("bigint").alias("line_no"),
        "name",
        "confidence",
        F.when(F.col("line_no") == 0, F.col("blob")).alias("blob"),
        "raw",
        "body",
        (body == "").alias("blank"),
        tx.is_stem_label(body).alias("stem_label"),
        tx.option_letter(body).alias("letter"),
        tx.inline_trigger(F.col("raw")).alias("inline_mark"),
    )


def _inline_pairs(chunk: Column) -> Column:
    """(letter, text) pairs of `(A) one (B) two`, blank texts dropped."""
    letters = F.transform(
        F.regexp_extract_all(chunk, F.lit(f"({tx.INLINE_OPTION})"), F.lit(1)),
        lambda m: tx.upper_letter(F.regexp_extract(m, "([A-Da-d])", 1)),
    )
    values = F.slice(F.split(chunk, tx.INLINE_OPTION, -1), F.lit(2), F.size(letters))
    pairs = F.zip_with(
        letters, values, lambda k, v: F.struct(k.alias("letter"), tx.trim_doc(v).alias("text"))
    )
    return F.filter(pairs, lambda p: p["text"] != "")


def _letter_map(pairs: Column, letters: tuple[str, ...]) -> Column:
    """Map from ordered (letter, text) pairs; the last text of a letter wins."""
    entries = F.transform(
        F.array(*[F.lit(x) for x in letters]),
        lambda k: F.struct(
            k.alias("key"),
            F.try_element_at(F.filter(pairs, lambda p: p["letter"] == k), F.lit(-1))["text"].alias("value"),
        ),
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def segmented_lines(lines: DataFrame) -> DataFrame:
    """Add paragraph, block, closed-before and, from there on, the paragraph's first inline line.

    Paragraphs and blocks are runs of lines, so all of it follows from what the frame held up to
    a line, and from where the run began: one order of the lines serves every window."""
    in_frame = Window.partitionBy(*FRAME).orderBy("line_no")
    so_far = in_frame.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = in_frame.rowsBetween(Window.unboundedPreceding, -1)

    def last(where: Column, value: str, window=so_far) -> Column:
        return F.max(F.when(where, F.col(value))).over(window)

    def since(line: Column, start: str) -> Column:
        """Whether there is such a line, and it is in the run that began at `start`."""
        return F.coalesce(line >= F.coalesce(start, F.lit(0)), F.lit(False))

    chunk = F.array_join(
        F.array("raw", *[F.lead("raw", i).over(in_frame) for i in range(1, INLINE_SPAN)]), " "
    )
    out = lines.select(
        "*",
        F.sum(F.col("blank").cast("int")).over(so_far).alias("paragraph"),
        F.sum(F.col("stem_label").cast("int")).over(so_far).alias("_labels"),
        last(F.col("blank"), "line_no").alias("_paragraph_at"),
        last(F.col("blank") | F.col("stem_label"), "line_no").alias("_block_at"),
        F.when(F.col("inline_mark"), chunk).alias("chunk"),
        *[last(F.col("letter") == x, "line_no", before).alias(f"_last_{x}") for x in tx.OPTION_LETTERS],
    )
    letters_before = sum((since(F.col(f"_last_{x}"), "_block_at").cast("int") for x in tx.OPTION_LETTERS), F.lit(0))
    out = out.select(
        *lines.columns, "paragraph", "_paragraph_at", "chunk",
        (F.col("_labels") - F.coalesce(last(F.col("blank"), "_labels"), F.lit(0))).alias("block"),
        (letters_before >= BLOCK_FULL).alias("closed"),
        F.when(F.col("inline_mark"), _inline_pairs(F.col("chunk"))).alias("pairs"),
    )
    top_level = F.col("stem_label") | (F.col("block") == 0) | F.col("closed")
    enough = F.size(F.array_distinct(F.transform("pairs", lambda p: p["letter"]))) >= MIN_OPTIONS
    out = out.withColumn("_fires", ~F.col("blank") & top_level & F.coalesce(enough, F.lit(False)))
    again = since(last(F.col("_fires"), "line_no", before), "_paragraph_at")
    out = out.withColumn("_first", F.col("_fires") & ~again)
    found = last(F.col("_first"), "line_no")
    return out.withColumn("inline_line", found).withColumn(
        "inline_line", F.when(since(F.col("inline_line"), "_paragraph_at"), F.col("inline_line"))
    ).drop("_paragraph_at", "_fires", "_first")


# Group numbers of the two drafts that are not lettered blocks.
_INLINE, _BLOB = -1, -2


def _grouped(segments: DataFrame) -> DataFrame:
    """Bring the lines of each draft together. A line may serve a block, the inline draft
    of its paragraph and (line 0) the whole-frame fallback."""
    in_block = (
        ~F.col("blank")
        & (F.col("block") >= 1)
        & ~F.col("closed")
        & (F.col("inline_line").isNull() | (F.col("line_no") < F.col("inline_line")))
    )
    roles = F.array(
        F.when(in_block, F.col("block").cast("int")),
        F.when(F.col("line_no") == F.col("inline_line"), F.lit(_INLINE)),
        F.when(F.col("blob").isNotNull(), F.lit(_BLOB)),
    )
    is_option = F.col("letter").isNotNull() & ~F.col("stem_label")
    rows = segments.select(
        *FRAME,
        "paragraph",
        "line_no",
        "name",
        "confidence",
        "blob",
        "pairs",
        F.when(~is_option, F.struct("line_no", tx.trim_doc(F.col("raw")).alias("body"))).alias("stem_line"),
        F.when(
            is_option, F.struct("line_no", "letter", tx.option_text(tx.trim_doc(F.col("raw"))).alias("text"))
        ).alias("option_line"),
        F.explode(F.filter(roles, lambda r: r.isNotNull())).alias("role"),
    )
    lettered = F.col("role") >= 1
    return rows.groupBy(*FRAME, "paragraph", "role").agg(
        F.min("line_no").alias("line_no"),
        F.first("name").alias("name"),
        F.first("confidence").alias("confidence"),
        F.first(F.when(F.col("role") == _BLOB, F.col("blob")), True).alias("blob"),
        F.first(F.when(F.col("role") == _INLINE, F.col("pairs")), True).alias("pairs"),
        F.array_sort(F.collect_list(F.when(lettered, F.col("stem_line")))).alias("stem_lines"),
        F.array_sort(F.collect_list(F.when(lettered, F.col("option_line")))).alias("option_lines"),
    )


def drafts(frames: DataFrame, repair: bool = True, drop_ocr_errors: bool = False) -> DataFrame:
    """Question drafts of all frames, keyed by (job_id, draft_ord). `kind` tells lettered
    blocks, inline blocks and whole-frame fallbacks apart."""
    if drop_ocr_errors:
        frames = frames.filter(~F.coalesce(F.col("ocr_text").startswith("[OCR error]"), F.lit(False)))
    if repair:
        frames = frames.withColumn("ocr_text", tx.repaired_text(F.coalesce("ocr_text", F.lit(""))))
    # Frames are dealt before they become lines, which takes less room than dealing these, and over
    # all tasks, as lines are heavy for their bytes; the trimmed line is made again from the raw
    # one, so that no window carries both.
    lines = classified_lines(spread(frames, *FRAME)).drop("body")
    groups = _grouped(segmented_lines(lines))
    block_stem = tx.trim_doc(F.array_join(F.transform("stem_lines", lambda x: x["body"]), "\n"))
    role = F.col("role")
    # A block that stays has options under two letters; told before its options are made.
    lettered = F.size(F.array_distinct(F.transform("option_lines", lambda x: x["letter"]))) >= MIN_OPTIONS
    groups = groups.filter((role < 0) | lettered)
    found = groups.select(
        *FRAME,
        "line_no",
        "name",
        role,
        F.when(role == _BLOB, F.col("blob"))
        .when(role == _INLINE, F.lit(INLINE_STEM))
        .otherwise(block_stem)
        .alias("stem"),
        F.when(role == _INLINE, _letter_map(F.col("pairs"), tx.REQUIRED_LETTERS))
        .otherwise(_letter_map(F.col("option_lines"), tx.OPTION_LETTERS))
        .alias("options"),
        F.when(role == _BLOB, F.col("confidence") * BLOB_FACTOR)
        .otherwise(F.col("confidence"))
        .alias("confidence"),
    ).filter(
        (role < 0) | (F.length("stem") >= MIN_STEM)
    )
    real = F.count(F.when(role != _BLOB, F.lit(1))).over(Window.partitionBy(*FRAME))
    return (
        found.withColumn("_real", real)
        .filter((role != _BLOB) | (F.col("_real") == 0))
        .select(
            "job_id",
            draft_order(F.col("frame_idx"), F.col("line_no")).alias("draft_ord"),
            "frame_idx",
            "line_no",
            F.when(role == _BLOB, F.lit("blob"))
            .when(role == _INLINE, F.lit("inline"))
            .otherwise(F.lit("block"))
            .alias("kind"),
            "stem",
            "options",
            F.col("name").alias("source_frame"),
            "confidence",
        )
    )


def numbered(questions: DataFrame, order: str = "draft_ord", width_bits: int = LINE_BITS + 10) -> DataFrame:
    """Stable ids q1..qn per job in draft order."""
    bucket = F.shiftright(F.col(order), width_bits)
    out = ordinal(questions, ["job_id"], [F.col(order)], bucket, name="q_idx")
    return out.withColumn("id", F.concat(F.lit("q"), F.col("q_idx")))
