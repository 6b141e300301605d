"""Text and HTML forms of a question bank.

A bank can be larger than any one task, so these give one block per question, in order, or
bounded parts; joining the blocks of a job in order gives the whole document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlake.functions import text as tx

QUESTIONS_PER_PART = 200


def _sorted_options(options: Column, one, joiner: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(options)), one), joiner)


def plain_block(number: Column, stem: Column, options: Column) -> Column:
    lines = F.transform(
        F.array_sort(F.map_entries(options)),
        lambda e: F.concat(F.lit("  ("), e["key"], F.lit(") "), e["value"], F.lit("\n")),
    )
    return F.concat(F.lit("Question "), number.cast("string"), F.lit("\n"), stem, F.lit("\n"), F.array_join(lines, ""))


def plain_text_parts(questions: DataFrame, per_part: int = QUESTIONS_PER_PART) -> DataFrame:
    """Plain text of a bank in parts of `per_part` questions."""
    block = plain_block(F.col("q_idx"), F.col("stem"), F.col("options"))
    return (
        questions.withColumn("part", F.floor((F.col("q_idx") - 1) / per_part))
        .groupBy("job_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct("q_idx", block.alias("block")))).alias("_blocks"))
        .select("job_id", "part", F.array_join(F.transform("_blocks", lambda b: b["block"]), "\n").alias("body"))
    )


def question_article(ident: Column, stem: Column, options: Column) -> Column:
    """Article fragment used by the raw and the polished bank."""
    items = _sorted_options(
        options,
        lambda e: F.concat(
            F.lit("<li><strong>"), tx.escape_html(e["key"]), F.lit(".</strong> "), tx.escape_html(e["value"]), F.lit("</li>")
        ),
        "\n",
    )
    return F.concat(
        F.lit('<article class="q">\n  <h2>'), tx.escape_html(ident),
        F.lit('</h2>\n  <p class="stem">'), tx.escape_html(stem),
        F.lit('</p>\n  <ol class="opts">'), items, F.lit("</ol>\n</article>"),
    )


def answer_item(ident: Column, letter: Column, rationale: Column) -> Column:
    return F.concat(
        F.lit("<li><strong>"), tx.escape_html(ident), F.lit('</strong> · <span class="letter">'),
        tx.escape_html(letter), F.lit("</span> — "), tx.escape_html(rationale), F.lit("</li>"),
    )


def notes_chunk(title: Column, html: Column) -> Column:
    title = tx.trim_web(title)
    head = F.when(title != "", F.concat(F.lit("<h2>"), tx.escape_html(title), F.lit("</h2>"))).otherwise(F.lit(""))
    return F.concat(F.lit('<div class="chunk">'), head, html, F.lit("</div>"))


def exam_article(number: Column, stem: Column, options: Column) -> Column:
    """Article fragment of the shuffled exam."""
    items = _sorted_options(
        options,
        lambda e: F.concat(
            F.lit("<li><strong>"), tx.escape_html(e["key"]), F.lit(".</strong> "), tx.escape_html(e["value"]), F.lit("</li>")
        ),
        "",
    )
    return F.concat(
        F.lit('<article class="q"><h2>Question '), number.cast("string"), F.lit("</h2><p>"),
        tx.escape_html(stem), F.lit('</p><ol type="A" class="opts">'), items, F.lit("</ol></article>"),
    )
