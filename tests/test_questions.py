"""Window-based question mining against a line-by-line reader, and text repair."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quizlake.functions import text as tx
from quizlake.operators import questions as q

STEM = re.compile(r"\s*(?:Q(?:uestion)?\s*)?\d+\s*[).:]", re.I)
OPTION = re.compile(r"\s*(?:\(\s*([A-Ea-e])\s*\)\s*[).:]\s*(.+)|([A-E])\s*[).:]\s*(.+))$")
MARK = re.compile(r"\(\s*([A-Da-d])\s*\)")


def read_frame(text):
    """(kind, first line, stem, options) of one frame, read top to bottom."""
    lines = [x.rstrip() for x in text.split("\n")]
    found, block, skipping = [], None, False

    def close():
        nonlocal block
        if block and len(block["options"]) >= 2 and len("\n".join(block["stem"]).strip()) >= 4:
            found.append(("block", block["at"], "\n".join(block["stem"]).strip(), block["options"]))
        block = None

    for i, line in enumerate(lines):
        body = line.strip()
        if not body:
            close()
            skipping = False
            continue
        if skipping:
            continue
        is_stem = STEM.match(body)
        if block and not is_stem:
            option = OPTION.match(body)
            if option:
                block["options"][(option[1] or option[3]).upper()] = (option[2] or option[4]).strip()
                if len(block["options"]) >= 4:
                    close()
            else:
                block["stem"].append(body)
            continue
        close()
        if MARK.search(line) and line.count("(") >= 2:
            pieces = MARK.split(" ".join(lines[i:i + 4]))
            options = {k.upper(): v.strip() for k, v in zip(pieces[1::2], pieces[2::2]) if v.strip()}
            if len(options) >= 2:
                found.append(("inline", i, "(inline options)", options))
                skipping = True
                continue
        if is_stem:
            block = {"at": i, "stem": [body], "options": {}}
    close()
    if not found:
        blob = "\n".join(lines)
        if sum(m in blob.upper() for m in ("(A)", "(B)", "(C)", "(D)")) >= 3:
            found.append(("blob", 0, blob[:2000], {}))
    return found


PIECES = ["", "", "1. What is it", "Q2: stem", "Question 3) (A) x (B) y", "A) one", "B. two", "(c): three", "D: four",
          "E) five", "(A) x (B) y", "(a) only (", "(C) z (D) w", "plain words", "(A) (B)", "A.", "7:", "a. low", "  4 ) spaced  "]


def test_windows_match_the_reader(spark):
    rng = random.Random(8)
    rows = [("j", i, f"f{i}", 80.0, "\n".join(rng.choice(PIECES) for _ in range(rng.randint(1, 16)))) for i in range(600)]
    df = spark.createDataFrame(rows, "job_id string, frame_idx bigint, name string, ocr_confidence double, ocr_text string")
    got = {}
    for r in q.drafts(df, repair=False).collect():
        got.setdefault(r.frame_idx, set()).add((r.kind, r.line_no, r.stem, tuple(sorted(r.options.items()))))
    for _, i, _, _, text in rows:
        want = {(k, n, s, tuple(sorted(o.items()))) for k, n, s, o in read_frame(text)}
        assert got.get(i, set()) == want, text


def test_draft_confidence_and_numbering(spark):
    rows = [("j", 5, "f5", 90.0, "(A) a (B)\n(C) c"), ("j", 2, "f2", None, "1. abc\nA) x\nB) y"), ("j", 3, "f3", 150.0, "2. abd\nA) x\nB) y")]
    df = spark.createDataFrame(rows, "job_id string, frame_idx bigint, name string, ocr_confidence double, ocr_text string")
    rows = q.numbered(q.drafts(df)).orderBy("q_idx").collect()
    assert [(r.id, r.frame_idx, round(r.confidence, 6)) for r in rows] == [("q1", 2, 0.7), ("q2", 3, 1.0), ("q3", 5, 0.9)]


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.o for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()]


def test_merge_wrapped(spark):
    cases = {
        "the quick bro\nwn fox": "the quick brown fox",
        "hyphen-\n  ated word": "hyphenated word",
        "end of the\nquorum": "end of the\nquorum",
        "Hello world\nand more": "Hello world\nand more",
        "longest\nword": "longest\nword",
        "quoru\nm. Quorum is": "quoru\nm. Quorum is",
        "a b-\n1. next": "a b-\n1. next",
        "pa\nrt\nly": "partly",
        "x\n\ny": "x\n\ny",
        "ab\r\ncd": "abcd",
        "ab \n Cd": "ab \n Cd",
        "": "",
    }
    assert column(spark, list(cases), tx.merge_wrapped) == list(cases.values())


def test_repair_split_words(spark):
    cases = {
        "quoru m": "quorum",
        "abcd m?": "abcdm?",
        "abcd é": "abcdé",
        "ends, x": "ends, x",
        "abc m": "abc m",
        "Trip ura": "Tripura",
        "Trip  ura (x)": "Tripura (x)",
        "Trip uras!": "Tripuras!",
        "Trip urals": "Trip urals",
        "Where has": "Where has",
        "The will": "The will",
        "Wherehas been": "Where has been",
        "Éabc ura": "Éabc ura",
        "quoru\nm": "quoru\nm",
        "quoru m.\nTrip ura": "quorum.\nTripura",
        "": "",
    }
    assert column(spark, list(cases), tx.repair_split_words) == list(cases.values())


def test_repair_chain_and_nfc(spark):
    got = column(spark, ["quoru\nm. Quorum is?", "état", "﻿soft­hyphen"], tx.repaired_text)
    assert got == ["quorum is?", "état", "softhyphen"]


def test_scalar_text_columns(spark):
    assert column(spark, ["A  b!c?", " X﻿"], tx.normalize_ocr) == ["a b c?", "x"]
    assert column(spark, ["What's  UP?"], tx.frequency_key) == ["whats up"]
    assert column(spark, ["b a", "c  b"], lambda c: tx.sorted_tokens(tx.dedupe_key(c))) == ["a b", "b c"]
    clock = spark.createDataFrame([(3725.9,), (59.0,), (-1.0,), (float("nan"),), (None,)], "s double")
    assert [r[0] for r in clock.select(tx.format_timestamp("s")).collect()] == ["1:02:05", "0:59", "0:00", "0:00", "0:00"]
    fenced = column(spark, ["x ```json\n[1]\n``` y", " [2] ", "```\n{}```"], tx.unwrap_fence)
    assert fenced == ["[1]", "[2]", "{}"]
    ids = column(spark, ["abcdefghijk", "https://youtu.be/abcdefghijk?x=1", "https://www.youtube.com/embed/abcdefghijk/z",
                         "https://youtube.com/watch?a=1&v=abcdefghijk", "https://example.com/watch?v=abcdefghijk", "::"], tx.video_id)
    assert ids == ["abcdefghijk"] * 4 + [None, None]


def test_draft_order_raises_rather_than_collides(spark):
    df = spark.createDataFrame([(1, 5), (2**39 - 1, 2**24 - 1)], "f bigint, l bigint")
    got = [r.o for r in df.select(q.draft_order(F.col("f"), F.col("l")).alias("o")).collect()]
    assert got == [(1 << 24) + 5, 2**63 - 1]
    for f, line in ((1, 2**24), (2**39, 0)):
        with pytest.raises(Exception, match="too large"):
            spark.createDataFrame([(f, line)], "f bigint, l bigint").select(q.draft_order(F.col("f"), F.col("l"))).collect()
