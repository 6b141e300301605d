"""Skew-safe ranking, table maintenance, enrichment edges."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quizlake.functions import text as tx
from quizlake.operators import documents, enrichment, frame_filters, ranking, tables
from quizlake.sources import banks, jobs, ocr


def test_ordinal_and_previous_cross_buckets(spark):
    rng = random.Random(1)
    rows = [(j, o) for j in ("a", "b") for o in rng.sample(range(500), 60)]
    df = spark.createDataFrame(rows, "job string, o bigint").repartition(4)
    got = {(r.job, r.o): r.idx for r in ranking.ordinal(df, ["job"], [F.col("o")], ranking.span("o", 16)).collect()}
    seen = {(r.job, r.o): r.p for r in ranking.previous(df, ["job"], "o", F.col("o"), ranking.span("o", 16), "p").collect()}
    for j in ("a", "b"):
        order = sorted(o for k, o in rows if k == j)
        assert [got[j, o] for o in order] == list(range(1, 61))
        assert [seen[j, o] for o in order] == [None] + order[:-1]


@pytest.mark.parametrize("n", [1, 2, 100, 180])
def test_top_share(spark, n):
    rng = random.Random(n)
    rows = [("a", i, rng.choice([0.5, 1.25, 1.2501, 1.2502, 3.0])) for i in range(n)]
    df = spark.createDataFrame(rows, "job string, i bigint, s double").repartition(3)
    got = sorted(r.i for r in ranking.top_share(df, ["job"], "s", "i", 0.55, tie_width=8).collect())
    keep = max(1, math.ceil(n * 0.55))
    assert got == sorted(i for _, i, _ in sorted(rows, key=lambda r: (-r[2], r[1]))[:keep])


def test_top_n(spark):
    rows = [(j, i, (i * 7) % 31) for j in "ab" for i in range(100)]
    df = spark.createDataFrame(rows, "job string, i bigint, v bigint")
    got = sorted((r.job, r.i) for r in ranking.top_n(df, ["job"], [F.desc("v"), F.asc("i")], 9, F.col("i")).collect())
    assert got == sorted((j, i) for j in "ab" for _, i, _ in sorted((r for r in rows if r[0] == j), key=lambda r: (-r[2], r[1]))[:9])


def test_upsert_twice_is_once(spark):
    base = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id int, v int, s string")
    new = spark.createDataFrame([(2, 3, "c"), (2, 2, "x"), (3, 1, "d")], "id int, v int, s string")
    once = tables.upsert(base, new, ["id"], "v")
    assert sorted(map(tuple, once.collect())) == [(1, 1, "a"), (2, 3, "c"), (3, 1, "d")]
    assert sorted(map(tuple, tables.upsert(once, new, ["id"], "v").collect())) == sorted(map(tuple, once.collect()))


def test_patch_has_three_states(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, s string")
    patch = spark.createDataFrame([(1, "z", True), (2, None, True), (3, "n", False)], "id int, s string, has_s boolean")
    assert sorted(map(tuple, tables.patch(base, patch, ["id"], ["s"]).collect())) == [(1, "z"), (2, None), (3, "c")]


def test_paginate_without_limit(spark):
    df = spark.createDataFrame([("j", i) for i in range(5)], "job_id string, i bigint")
    rows = tables.paginate(df, "i", 0).orderBy("i").collect()
    assert [(r.page, r.part, r.pages_in_part) for r in rows] == [(0, 0, 3), (0, 0, 3), (1, 0, 3), (1, 0, 3), (2, 0, 3)]


def test_plain_text_parts_join_to_the_document(spark):
    df = spark.createDataFrame([("j", i, f"s{i}", {"B": "y", "A": "x"}) for i in range(1, 4)],
                               "job_id string, q_idx bigint, stem string, options map<string,string>")
    parts = [r.body for r in documents.plain_text_parts(df, 2).orderBy("part").collect()]
    assert "\n".join(parts) == "\n".join(f"Question {i}\ns{i}\n  (A) x\n  (B) y\n" for i in range(1, 4))


def batch(spark):
    return spark.createDataFrame(
        [("j", 1, "q1", "stem one", {"A": "x"}, 0, 0, 0, False), ("j", 2, "q2", "stem two", {"A": "y"}, 0, 1, 1, False)],
        "job_id string, q_idx bigint, id string, stem string, options map<string,string>, batch_no bigint, pos bigint, "
        "call_pos bigint, cache_hit boolean").withColumn("content_hash", F.col("id"))


class Model:
    """Replies `<stem> by <job> <batch>`, fails on every third batch, and counts its calls."""

    def __init__(self):
        self.calls = 0

    def __call__(self, job, batch, stems):
        if batch % 3 == 2:
            return None
        self.calls += 1
        return [f"{s} by {job} {batch}" for s in stems]


def polish_loop(questions, cache, size, model):
    """The sequential rule: batch by batch, each looks into the cache that those before filled."""
    out, hits = {}, 0
    for job in sorted({q[0] for q in questions}):
        known = {h: s for (j, h), s in cache.items() if j == job}
        rows = [q for q in questions if q[0] == job]
        for start in range(0, len(rows), size):
            ask = []
            for _, i, stem in rows[start : start + size]:
                if stem in known:
                    hits += 1
                    out[job, i] = known[stem]
                else:
                    ask.append((i, stem))
            if ask:
                replies = model(job, start // size, [s for _, s in ask]) or [s for _, s in ask]
                for (i, stem), reply in zip(ask, replies, strict=True):
                    known[stem] = out[job, i] = reply
        cache.update({(job, h): s for h, s in known.items()})
    return out, hits


def test_cache_fills_up_during_a_run(spark):
    rng = random.Random(6)
    rows = [(f"j{j}", i, f"which of {rng.randrange(9)} is it") for j in range(3) for i in range(40)]
    df = spark.createDataFrame([(*r, f"q{r[1]}", {"A": "x"}, 0.1) for r in rows],
                               "job_id string, q_idx bigint, stem string, id string, options map<string,string>, confidence double")
    hashed = df.select("stem", tx.content_hash("stem", "options").alias("h")).distinct().collect()
    stem_of = {r.h: r.stem for r in hashed}
    old = [("j1", h, "known before", {"A": "old"}) for h, s in sorted(stem_of.items())[:2]]
    cache = spark.createDataFrame(old, "job_id string, content_hash string, stem string, options map<string,string>")
    model, loop_cache = Model(), {("j1", stem_of[h]): s for _, h, s, _ in old}
    want, hits = polish_loop(rows, loop_cache, 7, model)

    batches = enrichment.cleanup_batches(df, cache, "fast", 7)
    asked = batches.filter("NOT cache_hit").orderBy("job_id", "batch_no", "call_pos").collect()
    calls = {}
    for r in asked:
        calls.setdefault((r.job_id, r.batch_no), []).append(r.stem)
    replies = []
    for (job, number), stems in calls.items():
        said = Model()(job, number, stems)
        replies.append((job, number, None if said is None else json.dumps([{"stem": s} for s in said])))
    replies = spark.createDataFrame(replies, "job_id string, batch_no bigint, reply string")
    got = {(r.job_id, r.q_idx): r.stem for r in enrichment.polished(df, batches, replies).collect()}
    assert got == want
    counted = enrichment.counters(df, batches, replies, "fast").collect()
    assert sum(r.cache_hits for r in counted) == hits and sum(r.calls for r in counted) == model.calls
    after = {(r.job_id, stem_of[r.content_hash]): r.stem for r in enrichment.updated_cache(cache, batches, replies).collect()}
    assert after == loop_cache


@pytest.mark.parametrize("reply,stems", [
    ('```json\n[{"stem":"one!"},{"stem":5,"options":{"B":2,"C":null}}]\n```', ["one!", "stem two"]),
    ('[{"stem":"one!"}]', None), ('[{"stem":"a"},"x"]', None), ("not json", None), (None, None), ('{"a":1}', None),
])
def test_reply_validation(spark, reply, stems):
    replies = spark.createDataFrame([("j", 0, reply)], "job_id string, batch_no bigint, reply string")
    rows = enrichment.corrections(batch(spark), replies).orderBy("q_idx").collect()
    assert [r.stem for r in rows] == (stems or [])
    if stems:
        assert rows[1].options == {"B": "2"} and rows[0].options == {"A": "x"}
    cache = spark.createDataFrame([], "job_id string, content_hash string, stem string, options map<string,string>")
    kept = enrichment.updated_cache(cache, batch(spark), replies).count()
    assert kept == 2
    assert enrichment.updated_cache(cache, batch(spark), replies, cache_failures=False).count() == len(stems or [])


def test_topic_tags_and_answer_key(spark):
    reply = '[{"topics":[" a ","",3,"b","c","d"]},{"topics":[]}]'
    replies = spark.createDataFrame([("j", 0, reply)], "job_id string, batch_no bigint, reply string")
    rows = enrichment.topic_tags(batch(spark), replies).orderBy("q_idx").collect()
    assert [r.topics for r in rows] == [["a", "b", "c"], None]
    key = spark.createDataFrame([("j", 0, '[{"letter":" c","id":"z"},{}]')], "job_id string, batch_no bigint, reply string")
    rows = enrichment.answer_key(batch(spark), key).orderBy("q_idx").collect()
    assert [(r.id, r.letter, r.rationale) for r in rows] == [("z", "C", "—"), ("q2", "?", "—")]


def test_cluster_coverage(spark):
    df = spark.createDataFrame([(1, 3, "[[0,2],[1]]"), (2, 3, "[[0,2]]"), (3, 2, "[[0,0]]"), (4, 2, "x")], "k int, n int, reply string")
    assert [r.complete for r in enrichment.cluster_coverage(df).orderBy("k").collect()] == [True, False, False, False]


def test_resolve_capture_and_clamps(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [(1, "mcq_hunter", 700.0, None, None, None), (2, "nope", 4000.0, None, None, None), (3, "fast_notes", 4000.0, 500.0, None, 0.5),
         (4, None, nan, nan, None, None)],
        "job_id int, preset string, duration_sec double, adv_interval double, adv_cooldown double, adv_threshold double")
    rows = {r.job_id: (r.preset, round(r.interval_sec, 4), round(r.cooldown_sec, 4), r.change_threshold)
            for r in frame_filters.resolve_capture(df).collect()}
    assert rows == {1: ("mcq_hunter", 0.575, 1.1, 0.1), 2: ("full_lecture", 1.35, 2.2, 0.15),
                    3: ("fast_notes", 120.0, 2.5, 0.5), 4: ("full_lecture", 1.0, 2.0, 0.15)}
    got = spark.createDataFrame([(0.2,), (700.0,), (7.9,), (nan,)], "x double").select(frame_filters.clamp_interval(F.col("x"))).collect()
    assert [r[0] for r in got] == [1, 600, 7, 5]


def test_bundle_parsing(spark):
    body = '[{"text":"t0","meanConfidence":"x"},7,"s",{"name":"n","text":null,"mean_confidence":55},{"meanConfidence":40.5}]'
    rows = ocr.parse_bundles(spark.createDataFrame([("j", body)], "job_id string, body string")).orderBy("frame_idx").collect()
    assert [(r.name, r.ocr_text, r.ocr_confidence) for r in rows] == [("frame_0", "t0", 70.0), ("n", "", 55.0), ("frame_2", "", 40.5)]


def test_recognised_lines(spark):
    df = spark.createDataFrame([("j", 1, ["a ", " ", "b"], [0.9, 0.1]), ("j", 2, ["c"], [88.0]), ("j", 3, [], [])],
                               "job_id string, frame_idx int, rec_texts array<string>, rec_scores array<double>")
    rows = ocr.lines_to_text(df).orderBy("frame_idx").collect()
    assert [(r.text, r.mean_confidence) for r in rows] == [("a\nb", 45.0), ("c", 88.0), ("", 0.0)]


def test_learner_state_and_metadata(spark):
    raw = ['{"version":1,"bookmarkedQuestionIds":["a",2,"b"],"solvedQuestionIds":"x"}', '{"version":2,"solvedQuestionIds":["a"]}', "bad", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string")
    got = [(r.s.bookmarked, r.s.solved) for r in df.select("i", jobs.learner_state(F.col("r")).alias("s")).orderBy("i").collect()]
    assert got == [(["a", "b"], []), ([], []), ([], []), ([], [])]
    meta = spark.createDataFrame([('{"id":"v","is_live":false,"live_status":"POST_LIVE"}',), ('{"id":"w"}',)], "r string")
    assert [r.m.live for r in meta.select(jobs.video_metadata(F.col("r")).alias("m")).collect()] == [True, False]


def test_bank_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(banks, "SOURCES_PER_PART", 3)
    monkeypatch.setattr(banks, "QUESTIONS_PER_LINE", 2)
    rows = [("j", i, f"q{i}", f"stem {i}", {"A": "x", "B": str(i)}, 0.123456 * i, ["t"]) for i in range(1, 6)] + [("k", 1, "q1", "s", {}, 0.5, None)]
    questions = spark.createDataFrame(rows, "job_id string, q_idx bigint, id string, stem string, options map<string,string>, confidence double, topics array<string>")
    seen = {("j", i, f"f{k:02d}") for i in range(1, 5) for k in range(4 * i)}
    sources = spark.createDataFrame(sorted(seen), "job_id string, q_idx bigint, source_frame string")
    shown = {("j", f"f{k:02d}", 0.5 + k, 7 * k) for k in range(11)}
    frames = spark.createDataFrame(sorted(shown), "job_id string, name string, mean_confidence double, char_count int")
    path = str(tmp_path / "bank")
    banks.write_bank(questions, sources, frames, path, "dir")
    got = {(r.job_id, r.q_idx): r for r in banks.read_banks(spark, path).collect()}
    assert len(got) == 6
    for job, i, id_, stem, options, confidence, topics in rows:
        r = got[job, i]
        assert (r.id, r.stem, r.options, r.confidence, r.topics) == (id_, stem, options, round(confidence, 4), topics)
    assert {tuple(r) for r in banks.read_bank_sources(spark, path).collect()} == seen
    assert {tuple(r) for r in banks.read_bank_frames(spark, path).collect()} == shown
    lines = spark.read.json(path).collect()
    assert {(r.version, r.framesDir) for r in lines} == {(1, "dir")} and max(len(r.questions) for r in lines) <= 2
    folder = tmp_path / "banks" / "j9"
    folder.mkdir(parents=True)
    (folder / "b.json").write_text('{"version":1,"questions":[\n{"id":"x","stem":"s","options":{"A":"x"},"sourceFrames":["f"],"confidence":0.4}]}')
    row = banks.read_banks(spark, str(tmp_path / "banks"), one_per_file=True).first()
    assert (row.job_id, row.q_idx, row.stem, row.options) == ("j9", 1, "s", {"A": "x"})


def test_finalize_pyq(spark):
    rows = [("j", i, f"q{i}", s, {"A": "x"}, c) for i, s, c in
            [(1, "one two three four five six seven", 0.5), (2, "something else entirely here", 0.6), (3, "One, two three four five six SEVEN", 0.9)]]
    questions = spark.createDataFrame(rows, "job_id string, q_idx bigint, id string, stem string, options map<string,string>, confidence double")
    sources = spark.createDataFrame([("j", i, f"f{i}") for i in (1, 2, 3)], "job_id string, q_idx bigint, source_frame string")
    out = enrichment.finalize(questions, sources, "pyq")
    assert sorted((r.id, r.confidence) for r in out["questions"].collect()) == [("q1", 0.9), ("q2", 0.6)]
    assert sorted((r.q_idx, r.source_frame) for r in out["sources"].collect()) == [(1, "f1"), (1, "f3"), (2, "f2")]
