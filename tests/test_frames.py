"""Frame features and ordered filters against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizlake.functions import frames as ff
from quizlake.operators import frame_filters as fl

SCHEMA = ("job_id string, frame_idx bigint, seconds double, decoded boolean, blank boolean, phash bigint, "
          "roi array<double>")


def make_frames(seed, n, jobs=("a", "b"), still=0.5):
    rng = random.Random(seed)
    rows = []
    for job in jobs:
        h, roi = rng.getrandbits(63), [rng.uniform(0, 255) for _ in range(16)]
        for i in range(1, n + 1):
            if rng.random() > still:
                h = rng.getrandbits(63)
                roi = [rng.uniform(0, 255) for _ in range(16)]
            elif rng.random() < 0.3:
                h ^= 1 << rng.randrange(63)
                roi = [x + rng.choice([0, 0, 20]) for x in roi]
            decoded, blank = rng.random() > 0.05, rng.random() < 0.1
            rows.append((job, i, float(i - 1), decoded, bool(decoded and blank), h if decoded else None, roi if decoded else None))
    return rows


def sequential(rows, smart):
    out = {}
    for job in {r[0] for r in rows}:
        last_hash, last_roi, last_sec = None, None, -float("inf")
        for _, idx, sec, decoded, blank, h, roi in sorted(r for r in rows if r[0] == job):
            if not decoded:
                out[job, idx] = (True, False, False, 1.0)
                last_hash, last_roi, last_sec = None, None, sec
            elif blank:
                out[job, idx] = (False, True, False, 0.0)
            elif last_hash is not None and bin(h ^ last_hash).count("1") <= 10:
                out[job, idx] = (False, False, True, 0.0)
            else:
                ratio = 1.0
                if smart:
                    if last_roi:
                        ratio = sum(abs(x - y) >= 12 for x, y in zip(roi, last_roi)) / len(roi)
                    if sec - last_sec < 2.0 or ratio < 0.15:
                        out[job, idx] = (False, False, False, ratio)
                        continue
                out[job, idx] = (True, False, False, ratio)
                last_hash, last_roi, last_sec = h, roi, sec
    return out


@pytest.mark.parametrize("smart,chunk,still", [(False, 1000, 0.5), (True, 1000, 0.5), (True, 7, 0.5), (False, 5, 0.9), (True, 5, 0.97)])
def test_filters_match_the_loop(spark, smart, chunk, still):
    rows = make_frames(11, 60, still=still)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {
        (r.job_id, r.frame_idx): (r.accepted, r.blank, r.duplicate, r.change_ratio)
        for r in fl.sequential_filter(df, smart=smart, chunk=chunk).collect()
    }
    assert got == sequential(rows, smart)


def test_static_chunks_settle_in_few_rounds(spark, monkeypatch):
    """64 chunks without a change, behind one that drifts: every chunk passes its entry on."""
    rows = make_frames(4, 10, jobs=("a",))
    h, roi = rows[0][5] or 1, [1.0] * 16
    rows += [("a", i, float(i - 1), True, False, h ^ (1 << (i % 3)), roi) for i in range(11, 331)]
    rounds = []
    stored = fl.cut
    monkeypatch.setattr(fl, "cut", lambda df: rounds.append(1) or stored(df))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.job_id, r.frame_idx): r.accepted for r in fl.smart_filter(df, chunk=5).collect()}
    assert got == {k: v[0] for k, v in sequential(rows, True).items()}
    assert len(rounds) <= 2 + 2 * 7  # features, first fold, and two tables a round


def test_counters_cover_every_frame(spark):
    rows = make_frames(3, 40)
    decisions = fl.smart_filter(spark.createDataFrame(rows, SCHEMA))
    for r in fl.filter_counters(decisions).collect():
        assert r.kept + r.skipped_blank + r.skipped_duplicate == 40
        assert r.skipped_duplicate == r.duplicates + r.low_change


def test_image_features_match_direct_sampling(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i, (h, w, c) in enumerate([(50, 70, 3), (64, 64, 4), (33, 91, 1), (9, 5, 3)]):
        data = rng.integers(0, 256, h * w * c, dtype=np.uint8)
        rows.append((i, (f"p/{i}.png", h, w, c, 0, bytearray(data.tobytes()))))
    rows.append((98, ("bad.png", -1, -1, -1, -1, bytearray())))
    rows.append((99, ("grey.png", 40, 40, 3, 0, bytearray(bytes([120] * 4800)))))
    image = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    df = spark.createDataFrame(rows, f"k int, image {image}")
    got = {r.k: r.f for r in df.select("k", ff.image_features("image").alias("f")).collect()}
    assert got[98].blank is None and got[98].phash is None
    assert got[99].blank is True
    for k, (_, h, w, c, _, data) in rows[:4]:
        px = np.frombuffer(bytes(data), np.uint8).reshape(h, w, c).astype(int)
        def luma(x, y):
            p = px[y, x]
            return 299 * int(p[2]) + 587 * int(p[1]) + 114 * int(p[0]) if c >= 3 else 1000 * int(p[0])
        cells = [luma(min(w - 1, x * w // 8), min(h - 1, y * h // 8)) for y in range(8) for x in range(8)]
        bits = 0
        for v in cells:
            bits = bits * 2 + (v * 64 >= sum(cells))
        assert got[k].phash & (2**64 - 1) == bits
        x0, y0 = int(w * 0.08), int(h * 0.12)
        rw, rh = max(1, max(x0 + 1, int(w * 0.92)) - x0), max(1, max(y0 + 1, int(h * 0.88)) - y0)
        roi = [luma(min(w - 1, x0 + x * rw // 64), min(h - 1, y0 + y * rh // 64)) for y in range(64) for x in range(64)]
        assert got[k].roi == roi


def test_frame_index_and_seconds(spark):
    df = spark.createDataFrame([("a/frame_000012.png",), ("b/none.png",), ("c/frame_0.png",)], "p string")
    rows = df.select(ff.frame_index("p").alias("i"), ff.frame_seconds("p").alias("s"),
                     ff.frame_seconds("p", 2.5, "timeline").alias("t")).collect()
    assert [(r.i, r.s, r.t) for r in rows] == [(12, 11.0, 27.5), (None, 0.0, 0.0), (0, 0.0, 0.0)]
