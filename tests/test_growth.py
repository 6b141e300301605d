"""Work that must not be repeated, or dealt row by row, as tables grow."""

import re

import pytest
from pyspark.sql import functions as F

from quizlake.functions import text as tx
from quizlake.operators import enrichment, questions
from quizlake.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trim_takes_all_white_space_and_only_that(spark):
    # A line end that is no white space of the UI language shields what is before it.
    web = [c for c in map(chr, range(0x3001)) if re.fullmatch(r"[ \t-\r\xa0  -     　]", c)] + ["﻿"]
    doc = [c for c in map(chr, range(0x3001)) if c.isspace()]
    assert sorted(tx.WEB_SPACES) == web and sorted(tx.DOC_SPACES) == doc
    rows = [(c + " a b " + c,) for c in map(chr, [*range(0x100), *range(0x1670, 0x1690), *range(0x1FF0, 0x2070), 0x3000, 0xFEFF, 0x1F600])]
    df = spark.createDataFrame([*rows, ("a \x85",), ("",), (" \n ",)], "t string")
    for got_t, got_web, got_doc in df.select("t", tx.trim_web(F.col("t")), tx.trim_doc(F.col("t"))).collect():
        assert got_web == got_t.strip("".join(web)) and got_doc == got_t.strip("".join(doc))


@pytest.mark.parametrize("space, plain", [(tx.WEB_SPACE, "WEB_SPACES"), (tx.DOC_SPACE, "DOC_SPACES")])
def test_white_space_classes_hold_the_same_characters(spark, space, plain):
    df = spark.range(0x10000).filter("id < 55296 OR id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    found = df.filter(F.col("c").rlike(f"^{space}\\z")).collect()
    assert sorted(r.c for r in found) == sorted(getattr(tx, plain))


def test_batches_route_and_hash_once(spark):
    rows = spark.createDataFrame([("j", i, f"q{i}", f"what is quoru m {i} about ?", {"A": "x"}, 0.1) for i in range(1, 60)],
                                 "job_id string, q_idx bigint, id string, stem string, options map<string,string>, confidence double")
    cache = catalog.cached_polish(rows.limit(0))
    batches = enrichment.cleanup_batches(rows, cache, "fast")
    # Neither the patterns nor the hashes of questions are in what reads the batches.
    assert "RLIKE" not in plan(batches) and plan(batches).count("sha2(") <= 2
    assert batches.count() == 59


def test_frames_are_dealt_whole(spark):
    """No line or word is shuffled: below what cuts a frame up there is the last exchange."""
    for df in (catalog.QUERIES["ocr_words_to_text"](spark, SF), catalog.QUERIES["multiset_jaccard_pairs"](spark, SF),
               questions.segmented_lines(questions.classified_lines(catalog.v.frames(spark, SF).repartition("job_id", "frame_idx")))):
        text = plan(df)
        assert "Exchange" not in text[: text.index("Generate")]


def test_drafts_deal_frames_not_lines(spark):
    text = plan(questions.drafts(catalog.v.frames(spark, SF), repair=False))
    above = text[: text.rindex("Generate posexplode")]
    assert "Exchange" not in above


def test_lines_are_put_in_order_once(spark):
    frames = spark.createDataFrame([("j", 1, "f", "1. a\nA) b", 50.0)], "job_id string, frame_idx bigint, name string, ocr_text string, ocr_confidence double")
    lines = questions.classified_lines(frames.checkpoint().repartition("job_id", "frame_idx"))
    # Neither does the explode filter on the lines, which would make them again.
    assert "Filter" not in plan(lines)
    assert plan(questions.segmented_lines(lines)).split("Initial Plan")[0].count("Sort [") == 1


def test_words_of_a_text_are_not_copied_per_block(spark):
    assert "slice(" not in plan(catalog.v.mcq_frames(spark, SF))


def test_replies_are_parsed_once_and_questions_routed_once(spark):
    rows = spark.createDataFrame([("j", i, f"q{i}", f"what is quoru m {i} about ?", {"A": "x"}, 0.1, f"h{i}") for i in range(1, 60)],
                                 "job_id string, q_idx bigint, id string, stem string, options map<string,string>, confidence double, content_hash string")
    batches = enrichment.cleanup_batches(rows, catalog.cached_polish(rows.limit(0)), "fast")
    # A hash that is there is not made again.
    assert {r.content_hash for r in batches.collect()} == {f"h{i}" for i in range(1, 60)}
    replies = catalog.reply_table(enrichment.requests(batches), "cleanup")
    parsed = plan(enrichment.validated(batches, replies.select("job_id", "batch_no", "reply").checkpoint(), objects=True))
    assert parsed.count("from_json(") == 1
    counted = enrichment.counters(rows, batches, replies.checkpoint(), "fast")
    assert "RLIKE" not in plan(counted)
    (row,) = counted.collect()
    # Of the batches 0, 1 and 2 the last one has a reply of the wrong length.
    assert (row.calls, row.cache_hits, row.skipped) == (2, 0, 0)


def test_word_breaks_are_those_of_the_plain_patterns(spark):
    texts = ["quoru m", "quorum is", "the quorum m", "abc d", "abcd  ef.", "abcd efg", "xTrip ura", "Trip ura", "Trip ura_", "_Trip ura", "Trip urage x",
             "Trip ura", "cafés ét", "Straße n!", "École est", "x École est", "Ab cd", "word a", "wor da", "a Trip ur", "ab12cdef g", ""]
    space = "[" + tx.WEB_SPACES + "]"
    lower, upper = "[a-zß-öø-ÿ]", "[A-ZÀ-ÖØ-Þ]"
    letter, edge = f"(?:{lower}|{upper})", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    one = re.compile(rf"{letter}{{4,}}{space}+{lower}{{1,2}}(?={space}|[?.!,;:]|\Z)")
    two = re.compile(rf"{edge}{upper}{lower}{{2,}}{space}+{lower}{{2,4}}{edge}")
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.has_word_break(F.col("t")).alias("b"))
    assert {r.t: r.b for r in df.collect()} == {t: bool(one.search(t) or two.search(t)) for t in texts}


def test_frames_are_dealt_over_all_tasks(spark):
    # Not merged by size: lines are heavy for their bytes.
    assert "REPARTITION_BY_NUM" in plan(questions.drafts(catalog.v.mcq_frames(spark, SF), repair=False))


def test_texts_are_numbered_before_they_become_words(spark):
    text = plan(catalog.v.mcq_frames(spark, SF)).split("Initial Plan")[0]
    # Split once, above the last exchange, and without a call per word.
    assert text.count("split(") == 1 and "Exchange" not in text[: text.index("split(")]
    assert "array_remove(" in text and "filter(" not in text


def test_patterns_are_not_tried_where_confidence_is_low(spark):
    rows = spark.createDataFrame(
        [(s, {k: "some text" for k in "ABCD"} if full else {"A": "x"}, c)
         for s in ("what is the quorum of the house", "what is quoru m of the house", "?? ?? ?? ?? ?? ab", "")
         for full in (True, False) for c in (0.5, 0.88, 0.95, None)],
        "stem string, options map<string,string>, confidence double")
    stem, options, conf = F.col("stem"), F.col("options"), F.col("confidence")
    for mode, bar in tx.SKIP_CONFIDENCE.items():
        if mode == "notes":
            continue
        plain = tx.question_has_word_break(stem, options) | ~((conf >= bar) & tx.structurally_clean(stem, options))
        got = tx.needs_cleanup(stem, options, conf, mode)
        both = rows.select(plain.alias("p"), got.alias("g"), tx.needs_cleanup_of(tx.fit_to_skip(stem, options), conf, mode).alias("f"))
        assert all(r.p == r.g == r.f for r in both.collect())
        # The bar stands before the patterns.
        text = plan(rows.select(got.alias("g")))
        assert text.index("confidence") < text.index("RLIKE")


def test_letters_of_a_stem_are_counted_by_runs(spark):
    stems = ["what is the quorum of", "é中文Ⅷ٣ 12 ab?!", "........... ab", "𝔘𝔫𝔦𝔠𝔬𝔡𝔢 text!", "-- - -- -- -- a"]
    df = spark.createDataFrame([(s, {k: "v" for k in "ABCD"}) for s in stems], "s string, o map<string,string>")
    clean = tx.structurally_clean(F.col("s"), F.col("o"))
    want = [len(s) >= 12 and sum(c.isalnum() for c in s) / len(s) >= 0.45 for s in stems]
    assert [r.c for r in df.select(clean.alias("c")).collect()] == want
    assert "regexp_count" not in plan(df.select(clean.alias("c")))


def test_questions_view_makes_words_once(spark):
    """No filter goes below the words: it would split a text again for every word it looks up."""
    assert plan(catalog.QUERIES["view_questions"](spark, SF)).count("split(replace(") == 1


def test_batches_are_cut_on_numbers(spark, monkeypatch):
    """Neither stems nor options are moved to number questions or to look them up."""
    seen, cut_up = [], enrichment.in_batches
    monkeypatch.setattr(enrichment, "in_batches", lambda df, *a: seen.append(set(df.columns)) or cut_up(df, *a))
    rows = spark.createDataFrame([("j", i, f"q{i}", f"what is quoru m {i % 7} about ?", {"A": "x"}, 0.1) for i in range(1, 60)],
                                 "job_id string, q_idx bigint, id string, stem string, options map<string,string>, confidence double")
    batches = enrichment.cleanup_batches(rows, catalog.cached_polish(rows.limit(0)), "fast")
    assert seen == [{"job_id", "q_idx", "content_hash"}]
    assert sorted((r.q_idx, r.batch_no, r.stem) for r in batches.collect()) == [
        (i, (i - 1) // 25, f"what is quoru m {i % 7} about ?") for i in range(1, 60)]
