"""Image folder to decisions, and stream = batch."""

import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quizlake.operators import events as event_ops
from quizlake.operators import frame_filters as fl
from quizlake.sources import banks, images, jobs, ocr
from quizlake.streaming import frames as stream_frames
from quizlake.streaming import progress
from tests.test_frames import SCHEMA, make_frames


def png(width, height, pixel):
    rows = b"".join(b"\0" + b"".join(bytes(pixel(x, y)) for x in range(width)) for y in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_image_folder(spark, tmp_path):
    job = tmp_path / "job7"
    job.mkdir()
    stripes = lambda x, y: (255, 255, 255) if (x // 8) % 2 else (0, 0, 0)
    checks = lambda x, y: (250, 20, 20) if (x // 16 + y // 16) % 2 else (10, 10, 200)
    files = {"frame_2.png": stripes, "frame_10.png": checks, "frame_3.png": stripes, "frame_1.png": lambda x, y: (0, 0, 0)}
    for name, pixel in files.items():
        (job / name).write_bytes(png(64, 64, pixel))
    (job / "frame_11.png").write_bytes(b"broken")
    (job / "notes.txt").write_text("x")
    frames = images.read_frames(spark, str(tmp_path))
    got = {r.frame_idx: (r.accepted, r.blank, r.duplicate) for r in fl.smart_filter(fl.image_frame_features(frames)).collect()}
    assert got == {1: (False, True, False), 2: (True, False, False), 3: (False, False, True),
                   10: (True, False, False), 11: (True, False, False)}
    assert images.list_images(spark, str(tmp_path)).count() == 5


@pytest.fixture(scope="module")
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def run_stream(df, tmp_path, mode="append"):
    query = (df.writeStream.format("memory").queryName("out").outputMode(mode)
             .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start())
    query.awaitTermination(240)
    return df.sparkSession.table("out").collect()


def test_frame_stream_equals_batch(rocks, tmp_path):
    rows = make_frames(21, 30)
    for part in range(3):  # three files, in time order: three micro-batches
        df = rocks.createDataFrame([r for r in rows if (r[1] - 1) // 10 == part], SCHEMA)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = {(r.job_id, r.frame_idx): (r.accepted, r.blank, r.duplicate, r.change_ratio)
            for r in fl.smart_filter(rocks.createDataFrame(rows, SCHEMA)).collect()}
    stream = rocks.readStream.schema(rocks.createDataFrame(rows[:1], SCHEMA).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.job_id, r.frame_idx): (r.accepted, r.blank, r.duplicate, r.change_ratio)
           for r in run_stream(stream_frames.filter_stream(stream), tmp_path) if not r.late}
    assert got == want


def test_outcome_stream_equals_batch(rocks, tmp_path):
    lines = ['{"type":"progress","stage":"ocr"}', "garbage", '{"type":"done"}', '{"type":"error"}', '{"type":"other"}']
    rows = [(f"r{i % 3}", i, lines[i % 5]) for i in range(40)]
    df = rocks.createDataFrame(rows, "run_id string, seq bigint, value string")
    df.write.parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, event_ops.run_outcomes(jobs.worker_events(df)).collect()))
    stream = rocks.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = run_stream(progress.outcome_stream(jobs.worker_events(stream)), tmp_path, "complete")
    assert sorted(map(tuple, got)) == want


def test_throttle_stream_emits_closed_buckets(rocks, tmp_path):
    rows = [("j", i, f"s{i % 4}") for i in range(200)]
    df = rocks.createDataFrame(rows, "job_id string, seq bigint, stage string").withColumn(
        "ts", F.timestamp_millis(F.col("seq") * 100))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = {r.bucket * 380: (r.seq, r.stage) for r in event_ops.throttled(df).collect()}
    stream = rocks.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = run_stream(progress.throttle_stream(stream, watermark="1 seconds"), tmp_path)
    assert got
    for r in got:
        assert batch[round(r.bucket_start.timestamp() * 1000)] == (r.seq, r.stage)


def sent(events, millis, wait):
    """One job's events in order, as a timer and a listener would handle them."""
    out, last, held = [], None, None
    for ts, seq, stage in events:
        if held and last + millis <= ts:
            last += millis
            out.append((*held, last))
            held = None
        if last is None or ts - last >= millis:
            last = ts
            out.append((seq, stage, ts))
        elif wait:
            held = (seq, stage)
    return out + ([(*held, last + millis)] if held else [])


@pytest.mark.parametrize("wait", [True, False])
def test_timed_throttle_equals_the_loop(rocks, tmp_path, wait):
    rng = random.Random(5)
    rows, clock = [], 0
    for seq in range(240):
        clock += rng.choice([5, 40, 90, 300, 1500])
        rows.append((rng.choice("abc"), seq, f"s{seq % 7}", clock))
    rows += [(job, 900, "end", clock + 10_000) for job in "abc"]
    rows += [("z", 901, "later", clock + 40_000)]  # moves the watermark past all of them
    for part in range(4):
        some = rows[part * 61 : (part + 1) * 61]
        df = rocks.createDataFrame(some, "job_id string, seq bigint, stage string, ms bigint")
        df.select("job_id", "seq", "stage", F.timestamp_millis("ms").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = rocks.readStream.schema("job_id string, seq bigint, stage string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    timed = progress.throttle_timed(stream) if wait else progress.broadcast_stream(stream)
    got = run_stream(timed, tmp_path)
    millis = event_ops.PROGRESS_MILLIS if wait else event_ops.PIPELINE_MILLIS
    for job in "abc":
        want = sent([(ms, seq, stage) for j, seq, stage, ms in rows if j == job], millis, wait)
        assert sorted((r.seq, r.stage, r.sent_ms) for r in got if r.job_id == job) == sorted(want)


def test_text_files_of_jobs(spark, tmp_path):
    """Bundles, word tables and polish caches, one folder per job."""
    for job in ("j1", "j2"):
        (tmp_path / job).mkdir()
        (tmp_path / job / "bundle.json").write_text(json.dumps([{"name": "a.png", "text": f"text of {job}"}, "odd", {"meanConfidence": "12.5"}]))
        cache = {"v": 1, "polishByHash": {"h": {"stem": f"s {job}", "options": {"A": "x"}}}}
        (tmp_path / job / "cache.json").write_text(json.dumps(cache if job == "j1" else cache | {"v": 2}))
        words = ["\t".join(["level"] + ["0"] * 9 + ["conf", "text"]), "\t".join(["5"] + ["0"] * 9 + ["90.5", "Hello"]), "short\trow",
                 "\t".join(["5"] + ["0"] * 9 + ["-1", "ghost"]), "\t".join(["4"] + ["0"] * 9 + ["80", ""])]
        (tmp_path / job / "frame_1.tsv").write_text("\n".join(words))
    got = {(r.job_id, r.frame_idx): (r.name, r.ocr_text, r.ocr_confidence) for r in ocr.read_bundles(spark, str(tmp_path / "*" / "bundle.json")).collect()}
    assert got == {(j, i): v for j in ("j1", "j2") for i, v in enumerate([("a.png", f"text of {j}", 70.0), ("frame_1", "", 12.5)])}
    rows = banks.read_cache(spark, str(tmp_path / "*" / "cache.json")).collect()
    assert [(r.job_id, r.content_hash, r.stem, r.options) for r in rows] == [("j1", "h", "s j1", {"A": "x"})]
    words = ocr.read_word_tables(spark, str(tmp_path / "*" / "frame_1.tsv"))
    text = ocr.words_to_text(words, ("path",)).collect()
    assert sorted((r.text, r.mean_confidence) for r in text) == [("Hello", 90.5), ("Hello", 90.5)]
