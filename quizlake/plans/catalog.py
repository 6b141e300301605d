"""One entry per query: (spark, sf_dir) -> DataFrame over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake.functions import events as ev
from quizlake.functions import frames as ff
from quizlake.functions import text as tx
from quizlake.operators import documents, enrichment, frame_filters, metrics, questions, similarity, tables, views
from quizlake.operators import events as event_ops
from quizlake.operators.ranking import ordinal, previous, span
from quizlake.plans import bank
from quizlake.plans import views as v
from quizlake.session import cut, kept, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def plain_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered drafts without repair and dedupe. Numbering reads its input twice, so the
    drafts are stored first."""
    return questions.numbered(kept(questions.drafts(v.mcq_frames(spark, sf_dir), repair=False), "drafts"))


def flat(df: DataFrame) -> DataFrame:
    """Options as text, for results that are compared by value."""
    return df.withColumn("options", tx.options_text("options"))


def tagged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as questions, with topics taken from their labels."""
    docs = v.table(spark, sf_dir, "documents").select(F.col("source").alias("job_id"), "doc_id")
    labels = v.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    topics = F.array(
        F.when(F.col("quality") == 1, F.lit(" Clean Prose ")).when(F.col("quality") == 0, F.lit("Rough draft")),
        F.when(F.col("toxic") == 1, F.lit("Toxic Content")),
    )
    return docs.join(labels, "doc_id", "left").select(
        "job_id", "doc_id", F.filter(topics, lambda t: t.isNotNull()).alias("topics")
    )


def reply_table(requests: DataFrame, kind: str) -> DataFrame:
    """Canned replies derived from the request rows: valid, fenced, short by one, missing."""
    rows = F.from_json("request", "array<struct<id:string>>")
    one = {
        "cleanup": lambda r: F.concat(
            F.lit('{"id":"'), r["id"], F.lit('","stem":"fixed '), r["id"], F.lit('","options":{"A":"one","B":2}}')
        ),
        "answer_key": lambda r: F.concat(F.lit('{"id":"'), r["id"], F.lit('","letter":" b","rationale":"see notes"}')),
        "topics": lambda r: F.concat(
            F.lit('{"id":"'), r["id"], F.lit('","topics":[" Law ","",'), F.substring(r["id"], 2, 9), F.lit(',"b","c","d"]}')
        ),
    }
    if kind == "notes":
        body = F.concat(F.lit('{"title":"Part '), F.col("batch_no").cast("string"), F.lit('","html":"<p>n</p>"}'))
    else:
        body = F.concat(F.lit("["), F.array_join(F.transform(rows, one[kind]), ","), F.lit("]"))
    short = F.lit("[]") if kind != "notes" else F.lit("null")
    case = F.col("batch_no") % 4
    reply = (
        F.when(case == 0, body)
        .when(case == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(case == 2, short)
    )
    return requests.select("job_id", "batch_no", reply.alias("reply"))


def cached_polish(bank_df: DataFrame) -> DataFrame:
    """A cache holding the questions whose stem has an even number of characters."""
    return (
        bank_df.filter(F.length("stem") % 2 == 0)
        .select("job_id", F.col("content_hash") if "content_hash" in bank_df.columns else tx.content_hash("stem", "options").alias("content_hash"))
        .distinct()
        .select("job_id", "content_hash", F.lit("cached").alias("stem"), F.create_map(F.lit("A"), F.lit("hit")).alias("options"))
    )


# --- sources ------------------------------------------------------------------------
@query
def ocr_words_to_text(spark, sf_dir):
    """Word tables back to text and mean confidence."""
    from quizlake.sources.ocr import words_to_text

    # Frames are dealt before they become words, so that no word is shuffled.
    words = spread(v.frames(spark, sf_dir).select("job_id", "frame_idx", "ocr_text"), "job_id", "frame_idx").select(
        "job_id", "frame_idx", F.posexplode(F.split(F.coalesce("ocr_text", F.lit("")), "[ \n]", -1)).alias("word_no", "word")
    )
    words = words.select(
        "job_id", "frame_idx", F.col("word_no").cast("bigint").alias("word_no"), "word",
        F.when(F.col("word_no") % 9 == 8, F.lit(4)).otherwise(F.lit(5)).alias("level"),
        (F.length("word") * 7 % 101 - F.when(F.col("word_no") % 11 == 10, F.lit(200)).otherwise(F.lit(0))).cast("double").alias("conf"),
    )
    return words_to_text(words).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query
def decode_jobs(spark, sf_dir):
    from quizlake.sources.jobs import decode_requests

    raw = v.jobs(spark, sf_dir).select(
        "job_id",
        "version",
        F.when(F.col("version") % 3 == 0, F.lit("local")).when(F.col("version") % 3 == 1, F.lit("remote")).alias("request_kind"),
        F.concat(F.lit("https://host/"), F.col("version").cast("string")).alias("request_url"),
        F.when(F.col("version") % 2 == 0, F.concat(F.lit("/videos/"), F.col("version").cast("string"), F.lit(".mp4"))).alias("request_file_path"),
        F.when(F.col("version") % 5 != 0, F.col("skipped_blank")).cast("double").alias("request_interval_sec"),
    )
    return decode_requests(raw)


# --- frames ---------------------------------------------------------------------------
@query
def grid_stats(spark, sf_dir):
    return v.grids(spark, sf_dir).select(
        "job_id", "frame_idx", F.round(ff.grid_mean("grid"), 6).alias("mean"), F.round(ff.grid_std("grid"), 6).alias("std")
    )


@query
def blank_filter(spark, sf_dir):
    return frame_filters.grid_features(v.grids(spark, sf_dir)).select("job_id", "frame_idx", "decoded", "blank")


@query
def average_hash(spark, sf_dir):
    return v.grids(spark, sf_dir).select(
        "job_id", "frame_idx", ff.hash_text(ff.average_hash("grid")).alias("phash")
    )


@query
def hamming_pairs(spark, sf_dir):
    """Distance of every frame to the frame before it."""
    hashes = v.grids(spark, sf_dir).select("job_id", "frame_idx", ff.average_hash("grid").alias("h"))
    seen = previous(hashes, ["job_id"], "frame_idx", F.col("h"), span("frame_idx"), "before")
    return seen.filter("h IS NOT NULL AND before IS NOT NULL").select(
        "job_id", "frame_idx", ff.hamming("h", "before").alias("distance")
    )


@query
def change_ratio_lag(spark, sf_dir):
    seen = previous(v.grids(spark, sf_dir), ["job_id"], "frame_idx", F.col("grid"), span("frame_idx"), "before")
    return seen.filter("grid IS NOT NULL AND before IS NOT NULL").select(
        "job_id", "frame_idx", F.round(ff.change_ratio("grid", "before"), 6).alias("change_ratio")
    )


@query
def dedupe_last_kept(spark, sf_dir):
    features = frame_filters.grid_features(v.grids(spark, sf_dir))
    return frame_filters.last_kept_dedupe(features).select("job_id", "frame_idx", "accepted", "blank", "duplicate")


def _smart(spark, sf_dir):
    return frame_filters.smart_filter(frame_filters.grid_features(v.grids(spark, sf_dir)))


@query
def smart_filter(spark, sf_dir):
    return _smart(spark, sf_dir).select(
        "job_id", "frame_idx", "accepted", "blank", "duplicate", F.round("change_ratio", 6).alias("change_ratio"), "phash"
    )


@query
def filter_counters(spark, sf_dir):
    return frame_filters.filter_counters(_smart(spark, sf_dir))


@query
def accepted_manifest(spark, sf_dir):
    return frame_filters.accepted_manifest(_smart(spark, sf_dir)).select("job_id", "frame_idx", "frame_no", "name")


@query
def sample_interval(spark, sf_dir):
    sampled = frame_filters.sample_interval(v.logs(spark, sf_dir), 3600.0, ["job_id"], "ts", "seq")
    return sampled.select("job_id", "bucket", "seq", "stage", "in_bucket")


@query
def resolve_capture(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("fast_notes", "mcq_hunter", "full_lecture", "exam_revision", "other")])
    jobs = v.jobs(spark, sf_dir).select(
        "job_id",
        "version",
        F.element_at(names, (F.col("version") % 5 + 1).cast("int")).alias("preset"),
        (F.col("version") * 7 % 5000).cast("double").alias("duration_sec"),
        F.when(F.col("version") % 6 == 0, F.col("skipped_blank").cast("double")).alias("adv_interval"),
        F.when(F.col("version") % 10 == 0, (F.col("version") % 400).cast("double")).alias("adv_cooldown"),
        F.lit(None).cast("double").alias("adv_threshold"),
    )
    out = frame_filters.resolve_capture(jobs)
    return out.select(
        "job_id", "version", "preset", F.round("interval_sec", 6).alias("interval_sec"),
        F.round("cooldown_sec", 6).alias("cooldown_sec"), "change_threshold",
    )


# --- views ----------------------------------------------------------------------------
@query
def question_flags(spark, sf_dir):
    return views.question_flags(v.mcq_frames(spark, sf_dir))


@query
def view_questions(spark, sf_dir):
    return views.questions_view(v.mcq_frames(spark, sf_dir)).select("job_id", "frame_idx", "name")


@query
def view_slides(spark, sf_dir):
    return views.slides_view(v.frames(spark, sf_dir)).select("job_id", "frame_idx", "change_ratio")


@query
def view_text_heavy(spark, sf_dir):
    return views.text_heavy_view(v.frames(spark, sf_dir)).select("job_id", "frame_idx", "name")


@query
def text_signal(spark, sf_dir):
    return views.text_signal(v.frames(spark, sf_dir))


@query
def usable_frames(spark, sf_dir):
    return views.usable_frames(v.frames(spark, sf_dir)).select("job_id", "frame_idx", "name")


@query
def kept_frames(spark, sf_dir):
    return views.kept_frames(v.frames(spark, sf_dir)).select("job_id", "frame_idx", "name")


@query
def best_frames(spark, sf_dir):
    scored = cut(views.best_score(v.frames(spark, sf_dir)).select("job_id", "frame_idx", "name", "score"))
    best = views.top_share(scored, ["job_id"], "score", "frame_idx", views.BEST_SHARE)
    return best.select("job_id", "frame_idx", F.round("score", 6).alias("score"))


@query
def weak_topic_bank(spark, sf_dir):
    found = views.with_topic(tagged_documents(spark, sf_dir), "toxic")
    return found.select("job_id", "doc_id", F.array_join("topics", "|").alias("topics"))


@query
def unsolved_questions(spark, sf_dir):
    solved = v.table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    docs = v.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("job_id"))
    return views.unsolved(docs, solved, ["doc_id"])


@query
def structural_clean(spark, sf_dir):
    clean = tx.structurally_clean(F.col("stem"), F.col("options"))
    return plain_bank(spark, sf_dir).select("job_id", "q_idx", clean.alias("clean"))


@query
def wordbreak_artifacts(spark, sf_dir):
    broken = tx.question_has_word_break(F.col("stem"), F.col("options"))
    return plain_bank(spark, sf_dir).select("job_id", "q_idx", broken.alias("word_break"))


@query
def route_questions(spark, sf_dir):
    # Told once for all modes, and only where the lowest bar of confidence is met.
    low = min(tx.SKIP_CONFIDENCE.values())
    fit = F.when(F.coalesce(F.col("confidence") < low, F.lit(False)), False).otherwise(tx.fit_to_skip(F.col("stem"), F.col("options")))
    rows = plain_bank(spark, sf_dir).withColumn("fit", fit)
    need = lambda mode: tx.needs_cleanup_of(F.col("fit"), F.col("confidence"), mode)
    return rows.select(
        "job_id", "q_idx", need("fast").alias("fast"), need("exam").alias("exam"), need("notes").alias("notes")
    )


# --- text -------------------------------------------------------------------------------
@query
def normalize_ocr(spark, sf_dir):
    return v.table(spark, sf_dir, "documents").select("doc_id", tx.normalize_ocr("text").alias("norm"))


@query
def frequency_keys(spark, sf_dir):
    return v.lines(spark, sf_dir).select(
        "job_id", "frame_idx", "line_no", tx.frequency_key("line").alias("stem"), tx.dedupe_key("line").alias("norm")
    )


@query
def content_hash(spark, sf_dir):
    return plain_bank(spark, sf_dir).select("job_id", "q_idx", tx.content_hash("stem", "options").alias("content_hash"))


@query
def levenshtein_pairs(spark, sf_dir):
    """Edit ratio of each turn to the turn before it in the conversation."""
    turns = v.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("job_id"), "turn", tx.normalize_ocr("text").alias("norm")
    )
    seen = previous(turns, ["job_id"], "turn", F.col("norm"), span("turn"), "before")
    return seen.filter("before IS NOT NULL").select(
        "job_id", "turn", F.round(tx.edit_ratio(F.col("norm"), F.col("before")), 6).alias("ratio")
    )


@query
def multiset_jaccard_pairs(spark, sf_dir):
    """Token overlap of each line with the line before it in the same frame."""
    # A frame is one row, so a line finds the one before it there: no line is shuffled, and its
    # tokens are numbered once for both of its pairs.
    rows = v.frames(spark, sf_dir).select("job_id", "frame_idx", F.transform(
        F.split("ocr_text", "\n", -1), lambda x: tx.numbered_tokens(tx.jaccard_tokens(x))).alias("lines"))
    pairs = F.transform("lines", lambda x, i: F.struct(x.alias("t"), F.get("lines", i - 1).alias("before")))
    rows = rows.select("job_id", "frame_idx", F.posexplode(pairs).alias("line_no", "p")).filter("line_no > 0")
    return rows.select(
        "job_id", "frame_idx", F.col("line_no").cast("bigint").alias("line_no"),
        F.round(tx.numbered_jaccard(F.col("p.t"), F.col("p.before")), 6).alias("jaccard"),
    )


@query
def merge_wrapped_lines(spark, sf_dir):
    return v.mcq_frames(spark, sf_dir).select("job_id", "frame_idx", tx.merge_wrapped(tx.nfc("ocr_text")).alias("merged"))


@query
def repair_split_words(spark, sf_dir):
    return v.table(spark, sf_dir, "documents").select("doc_id", tx.repair_split_words("text").alias("repaired"))


@query
def format_timestamp(spark, sf_dir):
    return v.frames(spark, sf_dir).select(
        "job_id", "frame_idx", tx.format_timestamp(F.col("seconds") * 61.5).alias("clock")
    )


@query
def url_host_path_key(spark, sf_dir):
    """Video ids of page addresses and of addresses rewritten to the known shapes."""
    key = F.substring(F.md5("url"), 1, 11)
    shape = F.col("page_id") % 6
    address = (
        F.when(shape == 0, key)
        .when(shape == 1, F.concat(F.lit("https://youtu.be/"), key, F.lit("?t=4")))
        .when(shape == 2, F.concat(F.lit("https://www.youtube.com/watch?list=1&v="), key))
        .when(shape == 3, F.concat(F.lit("https://m.youtube.com/shorts/"), key, F.lit("/x")))
        .when(shape == 4, F.concat(F.lit("https://youtube.com/playlist?v="), key))
        .otherwise(F.col("url"))
    )
    return v.table(spark, sf_dir, "pages").select("page_id", tx.video_id(address).alias("video_id"))


@query
def escape_html(spark, sf_dir):
    return v.table(spark, sf_dir, "pages").select(
        "page_id", tx.escape_html("html").alias("escaped"), tx.escape_minimal("html").alias("minimal")
    )


@query
def topic_slugs(spark, sf_dir):
    return v.table(spark, sf_dir, "pages").select("page_id", tx.topic_slug("url").alias("slug"))


# --- questions --------------------------------------------------------------------------
@query
def classify_lines(spark, sf_dir):
    return questions.classified_lines(v.mcq_frames(spark, sf_dir)).select(
        "job_id", "frame_idx", "line_no", "blank", "stem_label", "letter", "inline_mark"
    )


def _of_kind(spark, sf_dir, kind):
    found = questions.drafts(v.mcq_frames(spark, sf_dir), repair=False).filter(F.col("kind") == kind)
    return flat(found).select(
        "job_id", "frame_idx", "line_no", "stem", "options", F.round("confidence", 6).alias("confidence")
    )


@query
def extract_questions(spark, sf_dir):
    return _of_kind(spark, sf_dir, "block")


@query
def extract_inline_options(spark, sf_dir):
    return _of_kind(spark, sf_dir, "inline")


@query
def blob_fallback(spark, sf_dir):
    return _of_kind(spark, sf_dir, "blob")


@query
def frame_text_stats(spark, sf_dir):
    return questions.frame_stats(v.frames(spark, sf_dir))


@query
def numbered_questions(spark, sf_dir):
    return plain_bank(spark, sf_dir).select("job_id", "q_idx", "id", "frame_idx", "line_no")


@query
def question_bank(spark, sf_dir):
    found, sources = bank.question_bank(v.mcq_frames(spark, sf_dir))
    counts = sources.groupBy("job_id", "q_idx").agg(F.count(F.lit(1)).alias("source_frames"))
    return flat(found.join(counts, ["job_id", "q_idx"])).select(
        "job_id", "q_idx", "id", "stem", "options", "confidence", "source_frames"
    )


@query
def question_sources(spark, sf_dir):
    return bank.question_bank(v.mcq_frames(spark, sf_dir))[1]


# --- similarity -------------------------------------------------------------------------
def _edit_groups(spark, sf_dir):
    return cut(similarity.edit_groups(v.frames(spark, sf_dir).select("job_id", "frame_idx", "name", "ocr_text")).drop("ocr_text"))


@query
def dup_groups_edit(spark, sf_dir):
    """Group id = dense number of the group's first frame in the job."""
    grouped = _edit_groups(spark, sf_dir)
    firsts = ordinal(
        views.first_of_groups(grouped).select("job_id", "rep"), ["job_id"], [F.col("rep")], span("rep"), "group_id", start=0
    )
    return grouped.join(firsts, ["job_id", "rep"]).select("job_id", "frame_idx", "rep", "group_id")


@query
def first_per_group(spark, sf_dir):
    return views.first_of_groups(_edit_groups(spark, sf_dir)).select("job_id", "frame_idx", "name")


@query
def dup_group_sizes(spark, sf_dir):
    grouped = _edit_groups(spark, sf_dir)
    return grouped.join(views.group_sizes(grouped), ["job_id", "rep"]).select("job_id", "frame_idx", "group_size")


@query
def dedupe_token_sort(spark, sf_dir):
    found = cut(questions.drafts(v.mcq_frames(spark, sf_dir), repair=False))
    return similarity.token_sort_groups(found).select("job_id", "frame_idx", "line_no", "rep")


@query
def collapse_jaccard(spark, sf_dir):
    rows = v.lines(spark, sf_dir).withColumn("ord", questions.draft_order(F.col("frame_idx"), F.col("line_no")))
    grouped = similarity.jaccard_groups(kept(rows, "lines"), order="ord", stem="line")
    mask = (1 << questions.LINE_BITS) - 1
    return grouped.select(
        "job_id", "frame_idx", "line_no",
        F.shiftright("rep", questions.LINE_BITS).alias("rep_frame"), F.col("rep").bitwiseAND(F.lit(mask)).alias("rep_line"),
    )


# --- metrics ----------------------------------------------------------------------------
@query
def top_stems(spark, sf_dir):
    return metrics.top_stems(v.frames(spark, sf_dir))


@query
def topic_count(spark, sf_dir):
    return metrics.topic_count(tagged_documents(spark, sf_dir))


@query
def topic_estimate(spark, sf_dir):
    frames = v.frames(spark, sf_dir)
    return metrics.topic_estimate(frames, metrics.top_stems(frames, metrics.TOP_STEMS_SHOWN))


def _savings(spark, sf_dir):
    jobs = tables.latest(v.jobs(spark, sf_dir), ["job_id"], "version")
    return metrics.job_savings(jobs, v.logs(spark, sf_dir))


@query
def time_saved(spark, sf_dir):
    return _savings(spark, sf_dir).select("job_id", "dropped", "kept", "minutes_saved")


@query
def junk_percent(spark, sf_dir):
    return _savings(spark, sf_dir).select("job_id", "dropped", "kept", "junk_percent")


@query
def token_counts(spark, sf_dir):
    rows = v.table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.first("text").alias("stem"))
    rows = rows.withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    return metrics.token_counts(rows, "key")


# --- tables -----------------------------------------------------------------------------
@query
def upsert_latest(spark, sf_dir):
    """Queued versions form the base table, all other versions arrive as changes."""
    rows = v.jobs(spark, sf_dir)
    return tables.upsert(rows.filter("state = 'queued'"), rows.filter("state <> 'queued'"), ["job_id"], "version")


@query
def artifact_upsert(spark, sf_dir):
    """Three-part key: job, kind, path; newest meta stays."""
    rows = v.logs(spark, sf_dir).select(
        "job_id", F.col("stage").alias("kind"), F.concat(F.lit("/f/"), (F.col("seq") % 17).cast("string")).alias("path"), "seq", "value"
    )
    return tables.latest(rows, ["job_id", "kind", "path"], "seq")


@query
def retain_newest_jobs(spark, sf_dir):
    jobs = tables.latest(v.jobs(spark, sf_dir), ["job_id"], "version")
    return tables.retained(jobs, v.logs(spark, sf_dir).select("job_id", "seq", "stage"))


@query
def delete_cascade(spark, sf_dir):
    """Logs that remain after all failed jobs are deleted."""
    jobs = tables.latest(v.jobs(spark, sf_dir), ["job_id"], "version")
    left = tables.delete_jobs({"logs": v.logs(spark, sf_dir)}, jobs.filter("state = 'failed'"))
    return left["logs"].select("job_id", "seq")


@query
def replace_children(spark, sf_dir):
    """Done jobs get one fresh log row each; queued jobs lose all of theirs."""
    jobs = tables.latest(v.jobs(spark, sf_dir), ["job_id"], "version")
    touched = jobs.filter("state IN ('done', 'queued')")
    fresh = jobs.filter("state = 'done'").select("job_id", F.col("version").alias("seq"), F.lit("fresh").alias("stage"))
    return tables.replace_children(v.logs(spark, sf_dir).select("job_id", "seq", "stage"), fresh, touched)


@query
def log_retention(spark, sf_dir):
    return tables.newest_logs(v.logs(spark, sf_dir)).select("job_id", "seq", "stage")


@query
def log_tail(spark, sf_dir):
    return tables.newest_logs(v.logs(spark, sf_dir), tables.LOG_ROWS_SHOWN).select("job_id", "seq", "stage")


@query
def patch_columns(spark, sf_dir):
    jobs = tables.latest(v.jobs(spark, sf_dir), ["job_id"], "version").select("job_id", "state", "error_message")
    changes = v.logs(spark, sf_dir).groupBy("job_id").agg(
        F.bool_or(F.col("value") > 150).alias("has_state"),
        F.bool_or(F.col("value") > 250).alias("has_error_message"),
    ).select("*", F.lit("paused").alias("state"), F.lit(None).cast("string").alias("error_message"))
    return tables.patch(jobs, changes, ["job_id"], ["state", "error_message"])


@query
def paginate_export(spark, sf_dir):
    frames = v.frames(spark, sf_dir).select("job_id", "frame_idx")
    return tables.paginate(frames, "frame_idx", 7)


@query
def bank_plain_text(spark, sf_dir):
    return documents.plain_text_parts(plain_bank(spark, sf_dir))


@query
def bank_html(spark, sf_dir):
    return plain_bank(spark, sf_dir).select(
        "job_id", "q_idx", documents.question_article(F.col("id"), F.col("stem"), F.col("options")).alias("html")
    )


@query
def shuffled_bank(spark, sf_dir):
    mixed = tables.shuffled(plain_bank(spark, sf_dir), "exam")
    return mixed.select(
        "job_id", "q_idx", "exam_no",
        documents.exam_article(F.col("exam_no"), F.col("stem"), F.col("options")).alias("html"),
    )


@query
def job_with_children(spark, sf_dir):
    """Logs of each user as the frames and log lines of one job."""
    jobs = tables.latest(v.jobs(spark, sf_dir), ["job_id"], "version").select("job_id", "state")
    logs = v.logs(spark, sf_dir)
    frames = logs.select(
        "job_id", F.col("seq").alias("frame_idx"), F.format_string("frame_%06d.png", "seq").alias("name"),
        (F.col("seq") % 50).cast("double").alias("seconds"),
    )
    out = tables.jobs_with_children(jobs, frames, logs.select("job_id", "seq", "stage"), rows_per_run=20)
    shown = F.transform("frames", lambda f: F.concat_ws("@", f["name"], f["seconds"].cast("bigint").cast("string")))
    told = F.transform("logs", lambda x: F.concat_ws(":", x["seq"].cast("string"), x["stage"]))
    return out.select("job_id", "state", "run", F.array_join(shown, ",").alias("frames"), F.array_join(told, ",").alias("logs"))


@query
def recent_jobs(spark, sf_dir):
    jobs = tables.latest(v.jobs(spark, sf_dir), ["job_id"], "version")
    return tables.recent(jobs).select("job_id", "version", "state")


@query
def recover_interrupted(spark, sf_dir):
    jobs = tables.latest(v.jobs(spark, sf_dir), ["job_id"], "version")
    return tables.recover_interrupted(jobs).select("job_id", "version", "state", "error_message")


@query
def finished_jobs(spark, sf_dir):
    return views.finished(v.jobs(spark, sf_dir)).select("job_id", "version")


@query
def toggle_parity(spark, sf_dir):
    return tables.toggled(v.logs(spark, sf_dir), ["job_id", "stage"])


# --- enrichment -------------------------------------------------------------------------
def _hashed_bank(spark, sf_dir):
    """The bank with the hashes that the cache and the batches look up, made once."""
    return kept(plain_bank(spark, sf_dir).withColumn("content_hash", tx.content_hash("stem", "options")), "bank")


def _cleanup(spark, sf_dir, mode="fast"):
    rows = _hashed_bank(spark, sf_dir)
    batches = kept(enrichment.cleanup_batches(rows, cut(cached_polish(rows)), mode), "batches")
    replies = reply_table(enrichment.requests(batches), "cleanup")
    return rows, batches, replies


@query
def enrichment_batches(spark, sf_dir):
    _, batches, _ = _cleanup(spark, sf_dir)
    return batches.select(
        "job_id", "q_idx", "batch_no", "pos", "cache_hit", F.col("call_pos").cast("bigint").alias("call_pos")
    )


@query
def cache_hits_misses(spark, sf_dir):
    _, batches, _ = _cleanup(spark, sf_dir)
    return batches.groupBy("job_id").agg(
        F.count_if("cache_hit").alias("hits"), F.count_if(~F.col("cache_hit")).alias("misses")
    )


@query
def pack_requests(spark, sf_dir):
    _, batches, _ = _cleanup(spark, sf_dir)
    return enrichment.requests(batches)


@query
def validate_replies(spark, sf_dir):
    _, batches, replies = _cleanup(spark, sf_dir)
    return flat(enrichment.corrections(batches, replies)).select("job_id", "batch_no", "q_idx", "id", "stem", "options")


@query
def polished_bank(spark, sf_dir):
    rows, batches, replies = _cleanup(spark, sf_dir)
    return flat(enrichment.polished(rows, batches, replies)).select("job_id", "q_idx", "stem", "options")


@query
def enrichment_counters(spark, sf_dir):
    rows, batches, replies = _cleanup(spark, sf_dir)
    return enrichment.counters(rows, batches, replies, "fast")


@query
def polish_cache(spark, sf_dir):
    """Cache of every job after the run."""
    rows, batches, replies = _cleanup(spark, sf_dir)
    return flat(enrichment.updated_cache(cached_polish(rows), batches, replies)).select("job_id", "content_hash", "stem", "options")


@query
def finalize_calls(spark, sf_dir):
    """Calls of an exam run: clean-up as routed, and one call per batch of the answer key."""
    bank_rows = _hashed_bank(spark, sf_dir)
    sources = bank_rows.select("job_id", "q_idx", F.col("frame_idx").cast("string").alias("source_frame"))
    out = enrichment.finalize(bank_rows, sources, "exam", cut(cached_polish(bank_rows)), lambda kind, asked: reply_table(asked, kind))
    return out["counters"].select("job_id", "calls", "cache_hits", "skipped")


@query
def answer_key(spark, sf_dir):
    batches = cut(enrichment.all_batches(plain_bank(spark, sf_dir)))
    return enrichment.answer_key(batches, reply_table(enrichment.requests(batches), "answer_key"))


@query
def topic_tags(spark, sf_dir):
    batches = cut(enrichment.all_batches(plain_bank(spark, sf_dir)))
    tagged = enrichment.topic_tags(batches, reply_table(enrichment.requests(batches), "topics"))
    return tagged.select("job_id", "q_idx", F.array_join("topics", "|").alias("topics"))


@query
def notes_sections(spark, sf_dir):
    batches = cut(enrichment.all_batches(plain_bank(spark, sf_dir)))
    return enrichment.notes_sections(batches, reply_table(enrichment.requests(batches), "notes"))


@query
def revision_fragments(spark, sf_dir):
    batches = cut(enrichment.all_batches(plain_bank(spark, sf_dir)))
    return enrichment.revision_fragments(batches, reply_table(enrichment.requests(batches), "notes"))


@query
def merge_with_fallback(spark, sf_dir):
    """User turns zipped with the reply at the next position, or a default."""
    turns = v.table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", "text")
    replies = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    replies = replies.groupBy("conv_id", "turn").agg(F.min("reply").alias("reply"))
    return asked.join(replies, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.md5(F.coalesce("reply", "text")).alias("merged"), F.col("reply").isNotNull().alias("answered")
    )


# --- pipeline events ----------------------------------------------------------------------
@query
def classify_errors(spark, sf_dir):
    return event_ops.classified_errors(v.jobs(spark, sf_dir)).select("job_id", "version", "code", "category")


@query
def transient_errors(spark, sf_dir):
    return event_ops.classified_errors(v.jobs(spark, sf_dir)).select(
        "job_id", "version", "transient_pipeline", "transient_model"
    )


@query
def illegal_transitions(spark, sf_dir):
    return event_ops.illegal_transitions(v.jobs(spark, sf_dir))


@query
def phase_counts(spark, sf_dir):
    stages = v.logs(spark, sf_dir).withColumn(
        "stage",
        F.when(F.col("stage") == "view", "ocr").when(F.col("stage") == "click", "llm")
        .when(F.col("stage") == "signup", "init").when(F.col("stage") == "error", "dedupe").otherwise(F.col("stage")),
    )
    return event_ops.phase_counts(stages)


@query
def throttle_latest(spark, sf_dir):
    return event_ops.throttled(v.logs(spark, sf_dir), 3_600_000)


@query
def run_outcomes(spark, sf_dir):
    rows = v.logs(spark, sf_dir).select(
        F.col("job_id").alias("run_id"), "seq",
        F.when(F.col("stage") == "purchase", "done").when(F.col("stage") == "error", "error").otherwise(F.lit("progress")).alias("type"),
    )
    return event_ops.run_outcomes(rows)


@query
def decoder_progress(spark, sf_dir):
    """Decoder log lines written from log rows: noise dropped, seconds read back."""
    stamp = F.concat(
        F.lit("frame=1 time="), F.format_string("%02d:%02d:%02d", (F.col("seq") % 3).cast("int"), (F.col("seq") % 60).cast("int"), (F.col("seq") % 59).cast("int")), F.lit(".50 bitrate=1")
    )
    line = (
        F.when(F.col("stage") == "view", F.lit("[h264 @ 0x1] decode error"))
        .when(F.col("stage") == "click", F.lit(" muxing overhead: unknown "))
        .when(F.col("stage") == "error", F.lit("no progress here"))
        .otherwise(stamp)
    )
    rows = v.logs(spark, sf_dir).select("job_id", "seq", line.alias("line"))
    return rows.filter(~ev.decoder_noise(F.col("line"))).select("job_id", "seq", ev.decoded_seconds(F.col("line")).alias("seconds"))
