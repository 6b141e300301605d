"""Ordered frame filters: last-kept dedupe, the smart filter, counters and capture settings.

Both filters remember the last *kept* frame, so a frame's fate depends on all before it.
What follows a kept frame depends on that frame alone, so a long job is cut into chunks of
consecutive frames that are folded in parallel:

1. every chunk is folded from scratch;
2. a chunk is folded again wherever its entry state is not the one it was folded with. The
   entry state is what the nearest chunk before it has left that kept a frame of its own;
   chunks that kept none pass on what they were given, so a run of them, however long, gets
   its correction at once. Chunks that keep a frame mostly keep the same one from there on,
   so this settles after two or three rounds.

The first chunk of every job is right from the start and each round settles at least one
more, so the fixed point is the sequential result. No task ever holds more than one chunk.
Features are stored once, before the first fold; between chunks only numbers are compared,
and the grid of a kept frame is fetched for the chunks that are folded again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizlake.functions import frames as ff
from quizlake.functions.events import micros
from quizlake.operators.ranking import ordinal, span, top_n
from quizlake.session import cut

CHUNK = 4096
STATE = "kept_idx bigint, kept_hash bigint, kept_sec double, kept_roi array<double>"
DECISION = "accepted boolean, blank boolean, duplicate boolean, change_ratio double"


class FrameFold:
    """The per-frame rule, shared by the batch and the streaming form. Held between frames:
    index, hash, second and centre grid of the last kept frame."""

    def __init__(self, smart: bool, threshold: float = ff.DEFAULT_CHANGE_THRESHOLD,
                 cooldown: float = ff.DEFAULT_COOLDOWN):
        self.smart, self.threshold, self.cooldown = smart, threshold, cooldown
        self.idx = self.hash = self.sec = self.roi = None

    def load(self, idx, hash_, sec, roi) -> None:
        none = lambda v: None if v is None or (np.isscalar(v) and pd.isna(v)) else v
        self.idx, self.hash, self.sec = none(idx), none(hash_), none(sec)
        self.hash = None if self.hash is None else int(self.hash)
        self.roi = None if roi is None or np.isscalar(roi) else np.asarray(roi, dtype="float64")

    def keep(self, idx, hash_, sec, roi) -> None:
        self.idx, self.hash, self.sec, self.roi = idx, hash_, sec, roi

    def decide(self, idx, sec, decoded, blank, hash_, roi):
        """(accepted, blank, duplicate, change_ratio) and the state change."""
        if not decoded:
            self.keep(idx, None, sec, None)
            return True, False, False, 1.0
        if blank:
            return False, True, False, 0.0
        if self.hash is not None and (int(hash_ ^ self.hash) & (2**64 - 1)).bit_count() <= ff.DUPLICATE_BITS_MAX:
            return False, False, True, 0.0
        ratio = 1.0
        if self.smart:
            if self.roi is not None:
                n = min(len(roi), len(self.roi))
                moved = np.abs(roi[:n] - self.roi[:n]) >= ff.CELL_CHANGE_MIN
                ratio = float(moved.sum()) / n if n else 1.0
            cooling = self.sec is not None and sec - self.sec < self.cooldown
            if cooling or ratio < self.threshold:
                return False, False, False, ratio
        self.keep(idx, hash_, sec, roi)
        return True, False, False, ratio


def fold_rows(fold: FrameFold, pdf: pd.DataFrame) -> pd.DataFrame:
    """Apply the rule to frames already sorted by index."""
    out = [
        fold.decide(
            int(i), float(s), bool(d), bool(b) if d else False, int(h) if d and not b else None,
            np.asarray(r, dtype="float64") if r is not None else None,
        )
        for i, s, d, b, h, r in zip(
            pdf["frame_idx"], pdf["seconds"], pdf["decoded"], pdf["blank"], pdf["phash"], pdf["roi"]
        )
    ]
    return pd.DataFrame(out, columns=["accepted", "blank", "duplicate", "change_ratio"], index=pdf.index)


def _with_params(features: DataFrame, threshold, cooldown) -> DataFrame:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return features.withColumn("_threshold", as_col(threshold)).withColumn("_cooldown", as_col(cooldown))


def _fold_for(pdf: pd.DataFrame, smart: bool) -> FrameFold:
    first = pdf.iloc[0]
    fold = FrameFold(smart, float(first["_threshold"]), float(first["_cooldown"]))
    fold.load(first["kept_idx"], first["kept_hash"], first["kept_sec"], first["kept_roi"])
    return fold


def sequential_filter(
    features: DataFrame,
    smart: bool = True,
    threshold: Column | float = ff.DEFAULT_CHANGE_THRESHOLD,
    cooldown: Column | float = ff.DEFAULT_COOLDOWN,
    chunk: int = CHUNK,
) -> DataFrame:
    """Decisions for (job_id, frame_idx, seconds, decoded, blank, phash, roi). Threshold and
    cooldown may be columns that are constant per job."""
    features = _with_params(features, threshold, cooldown).withColumn("chunk", span("frame_idx", chunk))
    # A NULL in a 64-bit column would turn the pandas column into floats and lose bits.
    features = cut(features.withColumn("phash", F.coalesce("phash", F.lit(0).cast("bigint"))))
    key = ["job_id", "chunk"]
    job_type = features.schema["job_id"].dataType.simpleString()

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx")
        fold = _fold_for(pdf, smart)
        given = fold.idx
        fold_rows(fold, pdf)
        return pd.DataFrame(
            {
                "job_id": [pdf["job_id"].iloc[0]],
                "chunk": [pdf["chunk"].iloc[0]],
                "given_idx": pd.array([given], dtype="Int64"),
                "own": [fold.idx != given],
                "kept_idx": pd.array([fold.idx], dtype="Int64"),
                "kept_hash": pd.array([fold.hash], dtype="Int64"),
                "kept_sec": pd.array([fold.sec], dtype="Float64"),
                "kept_roi": pd.Series([fold.roi], dtype="object"),
            }
        )

    def decisions(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx")
        out = fold_rows(_fold_for(pdf, smart), pdf)
        texts = [
            "" if not d or b else format(int(h) & (2**64 - 1), "016x")
            for d, b, h in zip(pdf["decoded"], out["blank"], pdf["phash"])
        ]
        return pd.concat([pdf[["job_id", "frame_idx", "seconds"]], out], axis=1).assign(phash=texts)

    def run(entry: DataFrame, fn, schema: str) -> DataFrame:
        return features.join(entry, key).groupBy(*key).applyInPandas(fn, schema)

    empty = [F.lit(None).cast(t).alias(n) for n, t in (f.split(" ") for f in STATE.split(", "))]
    chunks = features.select(*key).distinct()
    entry = chunks.select(*key, *empty)
    if chunks.groupBy("job_id").count().filter("count > 1").limit(1).count():
        entry = _entries(run, entry, exits, f"job_id {job_type}, chunk bigint, given_idx bigint, own boolean, {STATE}")
    return run(
        entry,
        decisions,
        f"job_id {job_type}, frame_idx bigint, seconds double, {DECISION}, phash string",
    )


def _entries(run, entry: DataFrame, exits, schema: str) -> DataFrame:
    """The entry state of every chunk (see above)."""
    key = ["job_id", "chunk"]
    left = cut(run(entry, exits, schema))
    before = Window.partitionBy("job_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    state = [F.col(c.split(" ")[0]) for c in STATE.split(", ")]
    while True:
        # The last kept index identifies a state.
        own = F.when(F.col("own"), F.struct("chunk", "kept_idx"))
        found = left.select(*key, "given_idx", F.last(own, ignorenulls=True).over(before).alias("_from"))
        changed = cut(found.filter(~F.col("_from.kept_idx").eqNullSafe(F.col("given_idx"))).select(*key, F.col("_from.chunk").alias("_chunk")))
        grids = left.select(F.col("job_id"), F.col("chunk").alias("_chunk"), *state)
        if not changed.limit(1).count():
            entry = found.select(*key, F.col("_from.chunk").alias("_chunk"))
            return entry.join(grids, ["job_id", "_chunk"], "left").drop("_chunk")
        redone = run(changed.join(grids, ["job_id", "_chunk"]).drop("_chunk"), exits, schema)
        left = cut(left.join(changed.select(*key), key, "left_anti").unionByName(redone))


def grid_features(grids: DataFrame) -> DataFrame:
    """Features of stored luma grids; a missing grid stands for an undecodable image."""
    mean, std = ff.grid_mean("grid"), ff.grid_std("grid")
    stats = grids.select("job_id", "frame_idx", "grid", mean.alias("_mean"), std.alias("_std"))
    blank = ff.is_blank(F.col("_mean"), F.col("_std"))
    return stats.select(
        "job_id",
        F.col("frame_idx").cast("bigint").alias("frame_idx"),
        F.col("frame_idx").cast("double").alias("seconds"),
        F.col("grid").isNotNull().alias("decoded"),
        F.coalesce(blank, F.lit(False)).alias("blank"),
        ff.average_hash("grid", F.col("_mean")).alias("phash"),
        F.col("grid").alias("roi"),
    )


def image_frame_features(images: DataFrame, mode: str = "sample_index", interval: float = 1.0) -> DataFrame:
    """Features of decoded images: (job_id, frame_idx, path, image). Pixels never enter a
    shuffle: only the features do."""
    return images.withColumn("_f", ff.image_features("image")).select(
        "job_id",
        "frame_idx",
        ff.frame_seconds("path", interval, mode).alias("seconds"),
        F.col("_f.blank").isNotNull().alias("decoded"),
        F.coalesce("_f.blank", F.lit(False)).alias("blank"),
        F.col("_f.phash").alias("phash"),
        F.transform("_f.roi", lambda x: x.cast("double") / 1000.0).alias("roi"),
    )


def last_kept_dedupe(features: DataFrame, chunk: int = CHUNK) -> DataFrame:
    return sequential_filter(features, smart=False, chunk=chunk)


def smart_filter(features: DataFrame, threshold=ff.DEFAULT_CHANGE_THRESHOLD, cooldown=ff.DEFAULT_COOLDOWN,
                 chunk: int = CHUNK) -> DataFrame:
    return sequential_filter(features, True, threshold, cooldown, chunk)


def filter_counters(decisions: DataFrame) -> DataFrame:
    low = ~F.col("accepted") & ~F.col("blank") & ~F.col("duplicate")
    return decisions.groupBy("job_id").agg(
        F.count_if("accepted").alias("kept"),
        F.count_if("blank").alias("skipped_blank"),
        F.count_if("duplicate").alias("duplicates"),
        F.count_if(low).alias("low_change"),
        F.count_if(F.col("duplicate") | low).alias("skipped_duplicate"),
    )


def accepted_manifest(decisions: DataFrame) -> DataFrame:
    """Accepted frames renumbered 1..n per job under their new file names."""
    kept = decisions.filter("accepted")
    out = ordinal(kept, ["job_id"], [F.col("frame_idx")], span("frame_idx"), name="frame_no")
    return out.withColumn("name", F.format_string("frame_%06d.png", "frame_no"))


def sample_interval(events: DataFrame, seconds: float, keys: list[str], ts: str, order: str) -> DataFrame:
    """First row per key and time bucket."""
    bucket = F.floor(micros(events, ts) / F.lit(int(seconds * 1_000_000)))
    first = F.struct(ts, order)
    return (
        events.withColumn("bucket", bucket)
        .groupBy(*keys, "bucket")
        .agg(F.min_by(F.struct(*events.columns), first).alias("_row"), F.count(F.lit(1)).alias("in_bucket"))
        .select("bucket", "in_bucket", "_row.*")
    )


# --- fixed values: preset, sampling interval, cooldown, change threshold --------------
PRESETS = (
    ("fast_notes", 3.0, 2.5, 0.22),
    ("mcq_hunter", 0.5, 1.0, 0.1),
    ("full_lecture", 1.0, 2.0, 0.15),
    ("exam_revision", 2.0, 2.5, 0.18),
)
DEFAULT_PRESET = "full_lecture"
LONG_SECONDS, VERY_LONG_SECONDS = 600, 3600
LONG_FACTOR, VERY_LONG_FACTOR, COOLDOWN_FACTOR = 1.15, 1.35, 1.1
SAMPLE_RANGE, COOLDOWN_RANGE, INTERVAL_RANGE = (0.25, 120.0), (0.0, 300.0), (1, 600)
SAMPLE_DEFAULT, COOLDOWN_DEFAULT, INTERVAL_DEFAULT = 1.0, 2.0, 5
# -----------------------------------------------------------------------------------


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def _clamped(c: Column, limits: tuple[float, float], default: float) -> Column:
    low, high = limits
    return F.when(_finite(c), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), c))).otherwise(
        F.lit(float(default))
    )


def clamp_interval(c: Column) -> Column:
    low, high = INTERVAL_RANGE
    return F.when(
        _finite(c), F.greatest(F.lit(low), F.least(F.lit(high), F.floor(c)))
    ).otherwise(F.lit(INTERVAL_DEFAULT)).cast("int")


def resolve_capture(jobs: DataFrame) -> DataFrame:
    """Capture settings of (job_id, preset, duration_sec, adv_interval, adv_cooldown,
    adv_threshold): preset, then duration rule (unless anything is overridden), overrides,
    clamps."""
    spark = jobs.sparkSession
    presets = spark.createDataFrame(
        list(PRESETS), "preset string, p_interval double, p_cooldown double, p_threshold double"
    )
    known = [name for name, *_ in PRESETS]
    named = jobs.withColumn(
        "preset", F.when(F.col("preset").isin(known), F.col("preset")).otherwise(F.lit(DEFAULT_PRESET))
    )
    joined = named.join(F.broadcast(presets), "preset")  # four fixed rows
    adv = ["adv_interval", "adv_cooldown", "adv_threshold"]
    untouched = F.coalesce(*adv).isNull()
    duration = F.col("duration_sec")
    long = untouched & _finite(duration) & (duration >= LONG_SECONDS)
    factor = F.when(duration > VERY_LONG_SECONDS, VERY_LONG_FACTOR).otherwise(LONG_FACTOR)
    interval = F.when(long, F.least(F.lit(SAMPLE_RANGE[1]), F.col("p_interval") * factor)).otherwise(F.col("p_interval"))
    cooldown = F.when(long, F.least(F.lit(COOLDOWN_RANGE[1]), F.col("p_cooldown") * COOLDOWN_FACTOR)).otherwise(
        F.col("p_cooldown")
    )
    return joined.select(
        *[c for c in jobs.columns if c not in ("preset", "duration_sec", *adv)],
        "preset",
        _clamped(F.coalesce("adv_interval", interval), SAMPLE_RANGE, SAMPLE_DEFAULT).alias("interval_sec"),
        _clamped(F.coalesce("adv_cooldown", cooldown), COOLDOWN_RANGE, COOLDOWN_DEFAULT).alias("cooldown_sec"),
        F.coalesce("adv_threshold", "p_threshold").alias("change_threshold"),
    )


def raw_preview(frames: DataFrame, jobs: DataFrame, cap: int = 120) -> DataFrame:
    """Last frames (120) of jobs that are extracting or filtering, or paused while doing so."""
    paused_at = F.lower(F.regexp_extract(F.coalesce("progress_message", F.lit("")), r"(?i)Paused at ([a-z_]+)", 1))
    busy = ("extracting", "filtering")
    running = jobs.filter(F.col("state").isin(*busy) | ((F.col("state") == "paused") & paused_at.isin(*busy)))
    mine = frames.join(running.select("job_id"), "job_id", "left_semi")
    return top_n(mine, ["job_id"], [F.desc("frame_idx")], cap, F.col("frame_idx"))
