"""Batched enrichment of questions by a model.

The model call is outside: it is a table of replies per (job_id, batch_no). This module
picks and packs the batches, validates replies, merges them with per-row fallback and keeps
the cache. A batch holds at most 40 rows, so per-batch aggregates are bounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizlake.functions import text as tx
from quizlake.operators.tables import in_batches, upsert
from quizlake.operators.views import with_topic
from quizlake.session import cut, kept

# --- fixed values -----------------------------------------------------------------
BATCH_DEFAULT, BATCH_MIN, BATCH_MAX = 25, 5, 40
MAX_TOPICS = 3
NO_LETTER = "?"
ROW_MISSING = "Missing model row — verify manually."
CALL_FAILED = "DeepSeek unavailable — verify manually."
NO_RATIONALE = "—"
NOTES_TITLE, NOTES_EMPTY = "Notes", "<section><p>(empty)</p></section>"
NOTES_FAILED = (
    "<section><p>Section unavailable (offline or timeout). Use raw MCQ export.</p><pre>",
    "</pre></section>",
)
STEM_RULE = "\n---\n"
REVISION_FAILED = ("<section><h2>Batch ", "</h2><p>Revision fragment unavailable.</p></section>")
# -----------------------------------------------------------------------------------
BATCH = ["job_id", "batch_no"]


def batch_size(requested: float | None = None) -> int:
    if requested is not None and BATCH_MIN <= requested <= BATCH_MAX:
        return int(requested)
    return BATCH_DEFAULT


def routed(questions: DataFrame, mode: str) -> DataFrame:
    need = tx.needs_cleanup(F.col("stem"), F.col("options"), F.coalesce("confidence", F.lit(0.0)), mode)
    return questions.withColumn("needs_cleanup", F.coalesce(need, F.lit(True)))


def cleanup_batches(questions: DataFrame, cache: DataFrame, mode: str, size: int = BATCH_DEFAULT) -> DataFrame:
    """Questions that need work, cut into batches first and then looked up in the cache.

    The cache fills up during a run: what a batch has called for is there for the batches of
    its job after it, not yet for itself. So of all batches that hold a question, the first
    one calls for it (every copy in it); later copies are hits and take its answer, with
    `from_batch` naming that batch. A cache with a `job_id` is looked up per job, one without
    serves all jobs. `call_pos` numbers the calls of a batch. A `content_hash` that the questions
    bring along is taken as it is."""
    # Routing and hashes are heavy and their rows are read many times over, so both are stored; all is told on
    # numbers and hashes, and the questions come in at the end.
    need = routed(questions, mode).filter("needs_cleanup")
    if "content_hash" not in need.columns:
        need = need.withColumn("content_hash", tx.content_hash("stem", "options"))
    need = cut(need.select("job_id", "q_idx", "content_hash"))
    cut_rows = in_batches(need, "q_idx", size)
    by = ["job_id", "content_hash"] if "job_id" in cache.columns else ["content_hash"]
    hits = cache.select(
        *by, F.col("stem").alias("cached_stem"), F.col("options").alias("cached_options"), F.lit(True).alias("_known")
    )
    first = cut_rows.groupBy("job_id", "content_hash").agg(F.min("batch_no").alias("_first"))
    joined = cut_rows.join(first, ["job_id", "content_hash"]).join(hits, by, "left")
    later = F.col("_known").isNull() & (F.col("batch_no") > F.col("_first"))
    joined = joined.withColumn("from_batch", F.when(later, F.col("_first"))).withColumn(
        "cache_hit", F.col("_known").isNotNull() | later
    )
    calls = F.row_number().over(Window.partitionBy(*BATCH, "cache_hit").orderBy("pos")) - 1
    joined = joined.drop("_known", "_first").withColumn("call_pos", F.when(~F.col("cache_hit"), calls))
    return questions.drop("content_hash").join(joined, ["job_id", "q_idx"])


def all_batches(questions: DataFrame, size: int = BATCH_DEFAULT) -> DataFrame:
    """Every question in batches, as the answer key, topic, notes and revision calls use."""
    return in_batches(questions, "q_idx", size).withColumn("call_pos", F.col("pos"))


def requests(batches: DataFrame) -> DataFrame:
    """One JSON request per batch: [{id, stem, options}] in call order."""
    rows = F.array_sort(
        F.collect_list(F.struct("call_pos", F.to_json(F.struct("id", "stem", "options")).alias("q")))
    )
    return (
        batches.filter(F.col("call_pos").isNotNull())
        .groupBy(*BATCH)
        .agg(F.count(F.lit(1)).alias("n"), rows.alias("_rows"))
        .select(*BATCH, "n", F.concat(
            F.lit("["), F.array_join(F.transform("_rows", lambda r: r["q"]), ","), F.lit("]")
        ).alias("request"))
    )


def _json_text(element: Column, field: str) -> Column:
    """Value of a field when it is a JSON string, else NULL."""
    value = F.try_variant_get(element, f"$.{field}", "variant")
    return F.when(
        F.schema_of_variant(value) == "STRING", F.try_variant_get(element, f"$.{field}", "string")
    )


def validated(batches: DataFrame, replies: DataFrame, objects: bool = False) -> DataFrame:
    """Reply rows of accepted batches: the reply must be a JSON array with one element per
    request row, for corrections (`objects`) of objects only. Columns: batch key, call_pos, element (text) and v (variant)."""
    sizes = batches.filter(F.col("call_pos").isNotNull()).groupBy(*BATCH).agg(F.count(F.lit(1)).alias("n"))

    def parsed(body: Column) -> Column:
        return F.from_json(F.when(F.try_parse_json(body).isNotNull(), body), "array<string>")

    def accepted(elements: Column) -> Column:
        kinds = F.lit(not objects) | F.forall(elements, lambda e: F.coalesce(e.startswith("{"), F.lit(False)))
        return F.when((F.size(elements) == F.col("n")) & kinds, elements)

    # One value from the reply to its elements, and rows told apart after the explode: a filter on
    # the elements would parse every reply again for each of its conditions.
    elements = tx.bound(tx.bound(tx.unwrap_fence("reply", "json"), parsed), accepted)
    rows = sizes.join(replies, BATCH).select(*BATCH, F.posexplode_outer(elements).alias("call_pos", "element"))
    return rows.filter("call_pos IS NOT NULL").select(
        *BATCH, F.col("call_pos").cast("bigint").alias("call_pos"), "element", F.try_parse_json("element").alias("v")
    )


def corrections(batches: DataFrame, replies: DataFrame) -> DataFrame:
    """Validated corrections per call row; missing or mistyped fields keep the source."""
    v = F.col("v")
    raw_options = F.get_json_object("element", "$.options")
    given = F.when(
        raw_options.startswith("{"),
        F.map_filter(F.from_json(raw_options, "map<string,string>"), lambda _, x: x.isNotNull()),
    )
    rows = validated(batches, replies, objects=True).select(
        *BATCH,
        "call_pos",
        _json_text(v, "id").alias("_id"),
        _json_text(v, "stem").alias("_stem"),
        given.alias("_options"),
    )
    calls = batches.filter(F.col("call_pos").isNotNull())
    return calls.join(rows, [*BATCH, "call_pos"]).select(
        *BATCH,
        "call_pos",
        "q_idx",
        F.coalesce("_id", "id").alias("id"),
        F.coalesce("_stem", "stem").alias("stem"),
        F.coalesce("_options", "options").alias("options"),
    )


def _answers(batches: DataFrame, replies: DataFrame, failures: bool = True) -> DataFrame:
    """What a run puts into the cache of a job: (job_id, content_hash, stem, options). A call
    without an accepted reply answers with what it was sent, if `failures`; of several calls
    for one question, all in one batch, the last one counts."""
    fixed = corrections(batches, replies).select(*BATCH, "call_pos", F.col("stem").alias("_s"), F.col("options").alias("_o"))
    calls = batches.filter(~F.col("cache_hit")).join(fixed, [*BATCH, "call_pos"], "left" if failures else "inner")
    answer = F.struct(F.coalesce("_s", "stem").alias("stem"), F.coalesce("_o", "options").alias("options"))
    last = calls.groupBy("job_id", "content_hash").agg(F.max_by(answer, "call_pos").alias("a"))
    return last.select("job_id", "content_hash", "a.stem", "a.options")


def polished(questions: DataFrame, batches: DataFrame, replies: DataFrame) -> DataFrame:
    """Questions after clean-up: cache hit (of the cache as it was, then of this run), then
    correction, then the original."""
    named = ["job_id", "q_idx", F.col("stem").alias("_new_stem"), F.col("options").alias("_new_options")]
    fixed = corrections(batches, replies).select(*named)
    hits = batches.filter("cache_hit AND from_batch IS NULL").select(
        "job_id", "q_idx", F.col("cached_stem").alias("_new_stem"), F.col("cached_options").alias("_new_options")
    )
    later = batches.filter("from_batch IS NOT NULL").select("job_id", "q_idx", "content_hash")
    later = later.join(_answers(batches, replies), ["job_id", "content_hash"]).select(*named)
    return (
        questions.join(fixed.unionByName(hits).unionByName(later), ["job_id", "q_idx"], "left")
        .withColumn("stem", F.coalesce("_new_stem", "stem"))
        .withColumn("options", F.coalesce("_new_options", "options"))
        .drop("_new_stem", "_new_options", "content_hash")
    )


def updated_cache(cache: DataFrame, batches: DataFrame, replies: DataFrame, cache_failures: bool = True) -> DataFrame:
    """Cache after a run. Failed calls are cached as they were sent unless told otherwise. In a
    cache without `job_id`, which all jobs share, the answer of the last job stays."""
    fresh = _answers(batches, replies, cache_failures).withColumn("_v", F.struct(F.lit(1).alias("run"), F.col("job_id").cast("string").alias("job")))
    old = cache.withColumn("_v", F.struct(F.lit(0).alias("run"), F.lit("").alias("job")))
    by = ["job_id", "content_hash"] if "job_id" in cache.columns else ["content_hash"]
    columns = [*by, "stem", "options", "_v"]
    return upsert(old.select(*columns), fresh.select(*columns), by, "_v").drop("_v")


def counters(questions: DataFrame, batches: DataFrame, replies: DataFrame, mode: str) -> DataFrame:
    """Calls with an accepted reply, cache hits (also of answers of this run) and skipped
    questions per job: those that are in none of the batches routed by `mode`."""
    accepted = validated(batches, replies, objects=True).select(*BATCH).distinct().groupBy("job_id").agg(
        F.count(F.lit(1)).alias("calls")
    )
    # What needs work has been told once, for the batches; the patterns are not run again.
    rows = questions.select("job_id", F.lit(1).alias("_n"), F.lit(False).alias("cache_hit"))
    rows = rows.unionByName(batches.select("job_id", F.lit(-1).alias("_n"), "cache_hit"))
    counted = rows.groupBy("job_id").agg(F.count_if("cache_hit").alias("cache_hits"), F.sum("_n").alias("skipped"))
    return counted.join(accepted, "job_id", "left").select(
        "job_id", F.coalesce("calls", F.lit(0)).alias("calls"), "cache_hits", "skipped"
    )


def batch_calls(batches: DataFrame) -> DataFrame:
    """Calls per job where every batch is one call."""
    return batches.groupBy("job_id").agg(F.count_distinct("batch_no").alias("calls"))


def answer_key(batches: DataFrame, replies: DataFrame) -> DataFrame:
    v = F.col("v")
    letter = F.coalesce(F.try_variant_get(v, "$.letter", "string"), F.lit(NO_LETTER))
    rows = validated(batches, replies).select(
        *BATCH,
        "call_pos",
        _json_text(v, "id").alias("_id"),
        F.substring(F.upper(tx.trim_web(letter)), 1, 1).alias("letter"),
        F.coalesce(_json_text(v, "rationale"), F.lit(NO_RATIONALE)).alias("rationale"),
    )
    return batches.join(rows, [*BATCH, "call_pos"], "left").select(
        "job_id",
        "q_idx",
        F.coalesce("_id", "id").alias("id"),
        F.coalesce("letter", F.lit(NO_LETTER)).alias("letter"),
        F.coalesce("rationale", F.lit(CALL_FAILED)).alias("rationale"),
    )


def topic_tags(batches: DataFrame, replies: DataFrame) -> DataFrame:
    """Questions with up to three trimmed topics; none gives NULL, a failed batch keeps what
    the questions had (column `topics`, if any)."""
    if "topics" not in batches.columns:
        batches = batches.withColumn("topics", F.lit(None).cast("array<string>"))
    items = F.try_variant_get(F.col("v"), "$.topics", "array<variant>")
    texts = F.transform(
        F.filter(items, lambda t: F.schema_of_variant(t) == "STRING"),
        lambda t: tx.trim_web(F.try_variant_get(t, "$", "string")),
    )
    kept = F.slice(F.filter(texts, lambda t: t != ""), 1, MAX_TOPICS)
    rows = validated(batches, replies).select(
        *BATCH, "call_pos", F.lit(True).alias("_ok"), F.when(F.size(kept) > 0, kept).alias("_topics")
    )
    return batches.join(rows, [*BATCH, "call_pos"], "left").withColumn(
        "topics", F.when(F.col("_ok"), F.col("_topics")).otherwise(F.col("topics"))
    ).drop("_ok", "_topics")


def _batch_stems(batches: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("pos", "stem")))
    return batches.groupBy(*BATCH).agg(rows.alias("_rows")).select(
        *BATCH, F.array_join(F.transform("_rows", lambda r: r["stem"]), STEM_RULE).alias("stems")
    )


def notes_sections(batches: DataFrame, replies: DataFrame) -> DataFrame:
    """One titled section per batch; without a usable reply, the plain stems."""
    v = F.try_parse_json(tx.unwrap_fence("reply", "json"))
    ok = v.isNotNull() & ~F.is_variant_null(v)
    parsed = replies.select(
        *BATCH,
        ok.alias("_ok"),
        F.coalesce(_json_text(v, "title"), F.lit(NOTES_TITLE)).alias("_title"),
        F.coalesce(_json_text(v, "html"), F.lit(NOTES_EMPTY)).alias("_html"),
    )
    number = (F.col("batch_no") + 1).cast("string")
    fallback = F.concat(F.lit(NOTES_FAILED[0]), tx.escape_minimal("stems"), F.lit(NOTES_FAILED[1]))
    return _batch_stems(batches).join(parsed, BATCH, "left").select(
        *BATCH,
        F.when(F.col("_ok"), F.col("_title")).otherwise(F.concat(F.lit("Batch "), number)).alias("title"),
        F.when(F.col("_ok"), F.col("_html")).otherwise(fallback).alias("html"),
    )


def revision_fragments(batches: DataFrame, replies: DataFrame) -> DataFrame:
    v = F.try_parse_json(tx.unwrap_fence("reply", "json"))
    html = _json_text(v, "html")
    parsed = replies.select(*BATCH, F.when(tx.trim_web(html) != "", html).alias("_html"))
    number = (F.col("batch_no") + 1).cast("string")
    fallback = F.concat(F.lit(REVISION_FAILED[0]), number, F.lit(REVISION_FAILED[1]))
    return batches.select(*BATCH).distinct().join(parsed, BATCH, "left").select(
        *BATCH, F.coalesce("_html", fallback).alias("html")
    )


def cluster_coverage(replies: DataFrame) -> DataFrame:
    """Index clusters returned by a model: (key, n, reply as JSON list of lists). Adds the
    exploded clusters only where every index 0..n-1 occurs exactly once."""
    clusters = F.from_json(tx.unwrap_fence("reply", "json"), "array<array<bigint>>")
    flat = F.flatten("clusters")
    whole = (F.size(flat) == F.col("n")) & (
        F.array_sort(flat) == F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))
    )
    return replies.withColumn("clusters", clusters).withColumn("complete", F.coalesce(whole, F.lit(False)))


def finalize(
    questions: DataFrame,
    sources: DataFrame,
    mode: str,
    cache: DataFrame | None = None,
    reply_source: Callable[[str, DataFrame], DataFrame] | None = None,
    size: int = BATCH_DEFAULT,
) -> dict[str, DataFrame]:
    """Export mode routing over (questions, sources). `pyq` collapses near copies first,
    `exam` adds the answer key, `notes` adds sections and skips clean-up. Without a
    `reply_source(kind, requests)` the questions pass through as they are. `counters` holds the
    calls of a job; those for notes and for an answer key count one per batch, whatever became
    of them. Outputs are made as they are read: store `questions` to read them more than once."""
    from quizlake.operators.questions import numbered
    from quizlake.operators.similarity import collapse_questions

    if mode == "pyq":
        merged, sources = collapse_questions(questions, sources)
        renumbered = numbered(merged.withColumnRenamed("q_idx", "_old"), "_old", width_bits=12)
        sources = sources.withColumnRenamed("q_idx", "_old").join(
            renumbered.select("job_id", "_old", "q_idx"), ["job_id", "_old"]
        ).drop("_old")
        questions = renumbered.drop("_old")
    out = {"questions": questions, "sources": sources}
    if reply_source is None:
        return out
    if mode == "notes":
        batches = all_batches(questions, size)
        out["notes"] = notes_sections(batches, reply_source("notes", requests(batches)))
        none = F.lit(0).cast("bigint")
        out["counters"] = batch_calls(batches).select("job_id", "calls", none.alias("cache_hits"), none.alias("skipped"))
        return out
    if cache is None:
        cache = questions.select("job_id", F.lit("").alias("content_hash"), "stem", "options").limit(0)
    batches = kept(cleanup_batches(questions, cache, mode, size), "batches")
    replies = reply_source("cleanup", requests(batches))
    out["questions"] = polished(questions, batches, replies)
    out["cache"] = updated_cache(cache, batches, replies)
    out["counters"] = counters(questions, batches, replies, mode)
    if mode == "exam":
        keyed = all_batches(out["questions"], size)
        out["answer_key"] = answer_key(keyed, reply_source("answer_key", requests(keyed)))
        # Clean-up leaves the numbers of questions as they are, so calls are counted without it.
        more = batch_calls(all_batches(questions.select("job_id", "q_idx"), size)).withColumnRenamed("calls", "_more")
        out["counters"] = out["counters"].join(more, "job_id", "left").withColumn(
            "calls", F.col("calls") + F.coalesce("_more", F.lit(0))).drop("_more")
    return out


def weak_topic_bank(questions: DataFrame, sources: DataFrame, topic: str, **options) -> dict[str, DataFrame]:
    """Questions on one topic, cleaned up in exam mode."""
    return finalize(with_topic(questions, topic), sources, "exam", **options)
