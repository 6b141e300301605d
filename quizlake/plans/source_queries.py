"""Queries over the formats that sources read, and over parts of sinks and views that no other
query covers. Rows of the given tables are first written in the format (JSON, arrays), with
the faults that occur in it, then read; the SQL states what must come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake.functions import events as ev
from quizlake.operators import documents, frame_filters, tables
from quizlake.operators import views as view_ops
from quizlake.plans import catalog
from quizlake.plans import views as v
from quizlake.plans.oracles import ORACLES as CORE
from quizlake.plans.oracles import _esc, _with
from quizlake.sources import jobs as job_rows
from quizlake.sources import ocr

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return register


# --- recognition output -------------------------------------------------------------------
@query("""SELECT job_id, part, row_number() OVER (PARTITION BY job_id, part ORDER BY doc_id) - 1 AS frame_idx,
 CASE WHEN doc_id % 5 = 0 THEN concat('frame_', row_number() OVER (PARTITION BY job_id, part ORDER BY doc_id) - 1)
  ELSE concat('f', doc_id, '.png') END AS name, coalesce(text, '') AS ocr_text,
 CASE doc_id % 4 WHEN 0 THEN (n_chars % 100)::DOUBLE WHEN 1 THEN (n_chars % 50)::DOUBLE ELSE 70 END AS ocr_confidence
FROM (SELECT source AS job_id, doc_id // 50 AS part, * FROM documents WHERE doc_id % 9 <> 4)""")
def text_bundles(spark, sf_dir):
    """Bundles of 50 documents as JSON arrays; every ninth element is no object, names and
    confidences are missing, empty, text or under either name."""
    mod = lambda n: F.col("doc_id") % n
    item = F.to_json(F.struct(
        F.when(mod(10) == 0, F.lit("")).when(mod(5) != 0, F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".png"))).alias("name"),
        "text",
        F.when(mod(4) == 0, F.col("n_chars") % 100).alias("meanConfidence"),
        F.when(mod(4) == 1, (F.col("n_chars") % 50).cast("string")).when(mod(4) == 2, F.lit("high")).alias("mean_confidence"),
    ))
    element = F.when(mod(9) == 4, F.to_json(F.array("text"))).otherwise(item)
    docs = v.table(spark, sf_dir, "documents").select(F.col("source").alias("job_id"), "doc_id", element.alias("element"))
    bundles = docs.groupBy("job_id", F.expr("doc_id div 50").alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "element"))).alias("rows"))
    body = F.concat(F.lit("["), F.array_join(F.col("rows.element"), ","), F.lit("]")).alias("body")
    return ocr.parse_bundles(bundles.select("job_id", "part", body), ("job_id", "part"))


_LINES = """SELECT conv_id AS job_id, turn AS frame_idx, t, i FROM (
 SELECT conv_id, turn, lines[i] AS t, i FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS lines,
  unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM conversations))"""
_LINE_SQL = f"""SELECT job_id, frame_idx, coalesce(string_agg(trim(t), chr(10) ORDER BY i) FILTER (trim(t) <> ''), '') AS text,
 round(coalesce(avg(CASE WHEN most <= 1.5 THEN s * 100 ELSE s END) FILTER (trim(t) <> ''), 0), 6) AS mean_confidence FROM (
 SELECT *, max(s) FILTER (trim(t) <> '') OVER (PARTITION BY job_id, frame_idx) AS most FROM (
  SELECT *, CASE WHEN i % 5 = 0 THEN 0 ELSE (length(t) % 90) / (CASE WHEN frame_idx % 2 = 0 THEN 100.0::DOUBLE ELSE 1 END) END AS s FROM ({_LINES})))
GROUP BY job_id, frame_idx"""


def _recognised(spark, sf_dir) -> DataFrame:
    lines = F.split("text", "\n", -1)
    unit = F.when(F.col("turn") % 2 == 0, F.lit(100.0)).otherwise(F.lit(1.0))
    score = lambda t, i: F.when((i + 1) % 5 != 0, (F.length(t) % 90) / unit)
    return v.table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select(
        F.col("conv_id").alias("job_id"), F.col("turn").alias("frame_idx"), lines.alias("rec_texts"), F.transform(lines, score).alias("rec_scores"))


@query(_LINE_SQL)
def line_arrays(spark, sf_dir):
    """Turns as recognised lines; every fifth score is missing, half of the turns score up to 1."""
    return ocr.lines_to_text(_recognised(spark, sf_dir)).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query(_LINE_SQL)
def nested_line_arrays(spark, sf_dir):
    """The same lines in the older nested form: pages of (box, (text, score)), some pages null."""
    box = F.array(F.lit(0.0), F.lit(0.0)).alias("box")
    line = lambda t, s: F.struct(box, F.struct(t.alias("text"), s.alias("score")).alias("result"))
    rows = _recognised(spark, sf_dir)
    page = F.zip_with("rec_texts", "rec_scores", line)
    cut_at = F.expr("size(rec_texts) div 2")
    pages = F.array(F.slice(page, F.lit(1), cut_at), F.lit(None), F.slice(page, cut_at + 1, F.size(page) - cut_at))
    texts, scores = ocr.nested_lines(F.col("pages"))
    rows = rows.select("job_id", "frame_idx", pages.alias("pages")).select("job_id", "frame_idx", texts.alias("rec_texts"), scores.alias("rec_scores"))
    return ocr.lines_to_text(rows).withColumn("mean_confidence", F.round("mean_confidence", 6))


# --- jobs, learners, videos, workers --------------------------------------------------------
@query("""SELECT event_id AS seq, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'progress' END AS type,
 event_type AS stage, CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('m', event_id) END AS message,
 (event_id % 40)::INT AS current, 40 AS total, CASE WHEN event_type = 'purchase' THEN concat('/out/', user_id) END AS "outPath"
FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0""")
def worker_event_lines(spark, sf_dir):
    """Worker output: every seventh line is cut off, every eleventh has an unknown type."""
    kind = (F.when(F.col("event_id") % 11 == 0, F.lit("telemetry")).when(F.col("event_type") == "purchase", F.lit("done"))
            .when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("progress")))
    line = F.to_json(F.struct(
        kind.alias("type"), F.col("event_type").alias("stage"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("m"), F.col("event_id").cast("string"))).alias("message"),
        (F.col("event_id") % 40).alias("current"), F.lit(40).alias("total"),
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("/out/"), F.col("user_id").cast("string"))).alias("outPath")))
    cut = F.when(F.col("event_id") % 7 == 0, F.substring(line, 2, 9)).otherwise(line)
    return job_rows.worker_events(v.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), cut.alias("value")))


@query("""SELECT conv_id, turn, 1 AS version, CASE WHEN turn % 3 = 1 THEN concat(role, '|q', conv_id) ELSE '' END AS bookmarked,
 CASE WHEN turn % 3 = 1 AND turn % 2 = 1 THEN concat('q', turn) ELSE '' END AS solved FROM conversations""")
def learner_states(spark, sf_dir):
    """Learner states of version 1, of another version, and broken ones; ids that are no text are dropped."""
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    body = F.concat(F.lit('{"version":'), (F.col("turn") % 3).cast("string"), F.lit(',"bookmarkedQuestionIds":["'), F.col("role"), F.lit('",7,"q'),
                    conv, F.lit('",null],"solvedQuestionIds":'), F.when(F.col("turn") % 2 == 1, F.concat(F.lit('["q'), turn, F.lit('"]'))).otherwise(F.lit("3")), F.lit("}"))
    raw = F.when(F.col("turn") % 3 == 2, F.lit("{not json")).otherwise(body)
    state = job_rows.learner_state(raw)
    rows = v.table(spark, sf_dir, "conversations").select("conv_id", "turn", state.alias("s"))
    return rows.select("conv_id", "turn", "s.version", F.array_join("s.bookmarked", "|").alias("bookmarked"), F.array_join("s.solved", "|").alias("solved"))


@query("""SELECT page_id, concat('v', page_id) AS video_id, url AS title, page_id % 5 = 0 OR page_id % 3 = 1 AS live,
 length(trim(url)) BETWEEN 1 AND 200 AS titled FROM pages WHERE page_id % 8 <> 7
UNION ALL SELECT page_id, NULL, NULL, false, NULL FROM pages WHERE page_id % 8 = 7""")
def video_metadata(spark, sf_dir):
    """Metadata of videos, every eighth broken."""
    raw = F.to_json(F.struct(
        F.concat(F.lit("v"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("title"), (F.col("page_id") % 5 == 0).alias("is_live"),
        F.when(F.col("page_id") % 3 == 1, F.lit("IS_LIVE")).when(F.col("page_id") % 3 == 2, F.lit("was_live")).alias("live_status")))
    raw = F.when(F.col("page_id") % 8 == 7, F.lit("<html>")).otherwise(raw)
    rows = v.table(spark, sf_dir, "pages").select("page_id", job_rows.video_metadata(raw).alias("m"))
    return rows.select("page_id", "m.*", ev.valid_title(F.col("m.title")).alias("titled"))


@query("""SELECT job_id, version, CASE WHEN local THEN 'local' ELSE 'remote' END AS request_kind,
 CASE WHEN local THEN concat(version, '.mp4') ELSE concat('https://host/', version) END AS request_url,
 CASE WHEN local THEN concat('/videos/', version, '.mp4') END AS request_file_path,
 CASE WHEN local THEN 0 WHEN version % 5 <> 0 THEN skipped_blank::DOUBLE ELSE 5 END AS request_interval_sec FROM (
 SELECT user_id AS job_id, event_id AS version, floor(value)::INT AS skipped_blank,
  event_id % 2 = 0 AND (event_id % 3 = 0 OR event_id % 3 = 2) AS local FROM events)""")
def encode_jobs(spark, sf_dir):
    """Request columns decoded and stored again."""
    decoded = catalog.QUERIES["decode_jobs"](spark, sf_dir)
    return job_rows.encode_requests(decoded)


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'mode_a' WHEN 1 THEN 'mode_b' END AS mode_used,
 event_id % 4 = 1 AS fallback_required,
 CASE WHEN event_type = 'error' AND event_id % 5 <> 0 THEN 'unknown' END AS error_code,
 CASE WHEN event_type = 'error' AND event_id % 5 <> 0 THEN concat('m', event_id) END AS error_message,
 CASE WHEN event_id % 6 = 0 THEN 0 ELSE value END AS progress_percent,
 CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 6 = 0 THEN 0 ELSE value * 2 END AS video_duration_sec,
 CASE event_id % 4 WHEN 0 THEN 'mcq_hunter' WHEN 1 THEN 'full_lecture' WHEN 2 THEN NULL END AS extraction_preset,
 CASE WHEN event_id % 9 > 2 THEN value END AS interval_sec, CASE WHEN event_id % 9 > 5 THEN 3.5::DOUBLE END AS cooldown_sec FROM events""")
def job_columns(spark, sf_dir):
    """Job rows as they are stored, with unknown modes and presets, halves of errors, numbers
    that are none, and broken capture settings."""
    i = F.col("event_id")
    nan = F.when(i % 6 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    capture = F.concat(
        F.lit('{"fpsIntervalSeconds":'), F.col("value").cast("string"),
        F.when(i % 9 > 5, F.lit(',"cooldownSeconds":3.5}')).otherwise(F.lit(',"cooldownSeconds":"soon"}')))
    rows = v.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(i % 3 == 0, F.lit("mode_a")).when(i % 3 == 1, F.lit("mode_b")).otherwise(F.lit("mode_x")).alias("mode_used"),
        (i % 4).alias("fallback_required"),
        F.when((F.col("event_type") == "error") & (i % 5 != 0), F.lit("unknown")).alias("error_code"),
        F.concat(F.lit("m"), i.cast("string")).alias("error_message"),
        nan.alias("progress_percent"),
        F.when(i % 7 != 0, nan * 2).alias("video_duration_sec"),
        F.when(i % 4 == 0, F.lit("mcq_hunter")).when(i % 4 == 1, F.lit("other")).when(i % 4 == 2, F.lit("")).alias("extraction_preset"),
        F.when(i % 9 > 2, capture).when(i % 9 == 1, F.lit("{broken")).alias("advanced_capture_json"))
    found = job_rows.decode_rows(rows)
    return found.select("*", "advanced_capture.interval_sec", "advanced_capture.cooldown_sec").drop("advanced_capture")


# --- tables and views -----------------------------------------------------------------------
@query(_with("""SELECT job_id, version, CASE WHEN hit THEN 'failed' ELSE state END AS state,
 CASE WHEN hit THEN 'Job interrupted by app restart.' ELSE error_message END AS error_message FROM (
 SELECT *, row_number() OVER (ORDER BY updated_at DESC, job_id) <= 50
  AND state NOT IN ('done', 'failed', 'fallback_required', 'cancelled') AS hit FROM v_latest)"""))
def recovered_jobs(spark, sf_dir):
    """The whole next job table after a restart."""
    jobs = tables.latest(v.jobs(spark, sf_dir), ["job_id"], "version")
    return tables.recovered(jobs)[0].select("job_id", "version", "state", "error_message")


@query(_with("""SELECT job_id, seq, stage, message FROM (SELECT job_id, seq, stage, NULL AS message FROM v_logs)
UNION ALL SELECT l.job_id, coalesce(m, 0) + 1, 'failed', 'Job interrupted by app restart.' FROM (
 SELECT *, row_number() OVER (ORDER BY updated_at DESC, job_id) AS r FROM v_latest) l
LEFT JOIN (SELECT job_id, max(seq) AS m FROM v_logs GROUP BY 1) USING (job_id)
WHERE r <= 50 AND state NOT IN ('done', 'failed', 'fallback_required', 'cancelled')"""))
def recovered_logs(spark, sf_dir):
    """The whole log after a restart: one more row per repaired job."""
    jobs = tables.latest(v.jobs(spark, sf_dir), ["job_id"], "version")
    logs = v.logs(spark, sf_dir).select("job_id", "seq", "stage", F.lit(None).cast("string").alias("message"))
    return tables.recovered(jobs, logs)[1].select("job_id", "seq", "stage", "message")


_BUSY = """SELECT concat('src', user_id % 20) AS job_id, max(event_id) AS version FROM events GROUP BY 1"""


@query(_with(f"""SELECT f.job_id, frame_idx, name FROM v_frames f JOIN ({_BUSY}) j USING (job_id)
WHERE version % 4 IN (0, 1, 2) QUALIFY row_number() OVER (PARTITION BY f.job_id ORDER BY frame_idx DESC) <= 120"""))
def raw_preview_frames(spark, sf_dir):
    """Last frames of jobs that are extracting, filtering, or paused while doing so."""
    events = v.table(spark, sf_dir, "events")
    jobs = events.groupBy(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("job_id")).agg(F.max("event_id").alias("version"))
    shape = F.col("version") % 4
    jobs = jobs.select(
        "job_id",
        F.when(shape == 0, F.lit("extracting")).when(shape == 1, F.lit("filtering")).otherwise(F.lit("paused")).alias("state"),
        F.when(shape == 2, F.lit("Paused at Extracting")).otherwise(F.lit("Paused at ocr")).alias("progress_message"))
    return frame_filters.raw_preview(v.frames(spark, sf_dir), jobs).select("job_id", "frame_idx", "name")


@query(_with("SELECT DISTINCT job_id, stage AS kind, concat('/f/', seq % 17) AS path FROM v_logs"))
def artifact_paths(spark, sf_dir):
    return view_ops.artifact_paths(catalog.QUERIES["artifact_upsert"](spark, sf_dir))


@query("SELECT doc_id, source AS job_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def solved_questions(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("job_id"))
    return view_ops.solved_only(docs, v.table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"), ["doc_id"])


# --- document fragments ---------------------------------------------------------------------
@query(f"""SELECT job_id, q_idx, concat('<li><strong>', {_esc('id')}, '</strong> · <span class="letter">', {_esc('letter')}, '</span> — ',
 {_esc('rationale')}, '</li>') AS html FROM ({CORE['answer_key']})""")
def answer_key_items(spark, sf_dir):
    rows = catalog.QUERIES["answer_key"](spark, sf_dir)
    html = documents.answer_item(F.col("id"), F.col("letter"), F.col("rationale"))
    return rows.select("job_id", "q_idx", html.alias("html"))


@query(f"""SELECT job_id, batch_no, concat('<div class="chunk"><h2>', {_esc('title')}, '</h2>', html, '</div>') AS chunk
FROM ({CORE['notes_sections']})""")
def notes_chunks(spark, sf_dir):
    rows = catalog.QUERIES["notes_sections"](spark, sf_dir)
    return rows.select("job_id", "batch_no", documents.notes_chunk(F.col("title"), F.col("html")).alias("chunk"))


# --- addresses ------------------------------------------------------------------------------
_URL = "trim(url)"
_HOST = rf"regexp_replace(regexp_extract(lower({_URL}), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\.', '')"
_PATH = rf"regexp_extract({_URL}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_ID = "^[a-zA-Z0-9_-]{11}$"
_GIVEN = rf"""CASE WHEN regexp_matches({_URL}, '{_ID}') THEN {_URL}
 WHEN {_HOST} = 'youtu.be' THEN CASE WHEN regexp_matches(regexp_extract({_PATH}, '^/?([^/]*)', 1), '{_ID}') THEN regexp_extract({_PATH}, '^/?([^/]*)', 1) END
 WHEN {_HOST} IN ('youtube.com', 'm.youtube.com') THEN CASE WHEN {_PATH} = '/watch'
  THEN nullif(regexp_extract({_URL}, '[?&]v=([a-zA-Z0-9_-]{{11}})(?:[&#]|$)', 1), '')
  ELSE nullif(regexp_extract({_PATH}, '^/(?:embed|shorts|live)/([a-zA-Z0-9_-]{{11}})', 1), '') END END"""


@query(f"""SELECT page_id, 5 AS shape, {_GIVEN} AS video_id FROM pages
UNION ALL SELECT page_id, k, CASE WHEN k <= 3 THEN substring(md5(url), 1, 11) END FROM pages, (SELECT unnest(range(5))::INT AS k)""")
def video_addresses(spark, sf_dir):
    """Every given address as it is (shape 5), and five addresses made from its digest beside it."""
    key = F.substring(F.md5("url"), 1, 11)
    made = F.array(
        key, F.concat(F.lit("https://youtu.be/"), key, F.lit("?t=4")), F.concat(F.lit("https://www.youtube.com/watch?list=1&v="), key),
        F.concat(F.lit("https://m.youtube.com/shorts/"), key, F.lit("/x")), F.concat(F.lit("https://youtube.com/playlist?v="), key), F.col("url"))
    rows = v.table(spark, sf_dir, "pages").select("page_id", F.posexplode(made).alias("shape", "address"))
    return rows.select("page_id", "shape", catalog.tx.video_id("address").alias("video_id"))
