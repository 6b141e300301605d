"""Progress throttle and run outcomes over streams of worker events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quizlake.operators.events import PIPELINE_MILLIS, PROGRESS_MILLIS

SENT = "job_id string, seq bigint, stage string, sent_ms bigint"
HELD = "last_ms bigint, seq bigint, stage string"


def throttle_stream(events: DataFrame, millis: int = PROGRESS_MILLIS, watermark: str = "10 seconds") -> DataFrame:
    """Latest event per job and event-time bucket; a bucket is emitted once the watermark
    has passed it."""
    return (
        events.withWatermark("ts", watermark)
        .groupBy("job_id", F.window("ts", f"{millis} milliseconds"))
        .agg(F.max_by(F.struct("seq", "stage"), F.struct("ts", "seq")).alias("_last"), F.count(F.lit(1)).alias("events"))
        .select("job_id", F.col("window.start").alias("bucket_start"), "events", "_last.seq", "_last.stage")
    )


def outcome_stream(events: DataFrame) -> DataFrame:
    """First terminal event per run so far (update mode)."""
    return (
        events.filter(F.col("type").isin("done", "error"))
        .groupBy("run_id")
        .agg(F.min("seq").alias("seq"), F.min_by("type", "seq").alias("outcome"))
    )


class Throttle(StatefulProcessor):
    """Per job: an event is sent at once if the last one was sent an interval ago or more; else
    it waits, in place of one that waits already, until the interval is over. The state is one
    row: when something was sent last, and what waits (stage null: nothing). `wait` False
    drops what comes too early instead of holding it."""

    def __init__(self, millis: int, wait: bool):
        self.millis, self.wait = millis, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", HELD)

    def _sent(self, key, rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["seq", "stage", "sent_ms"])
        out.insert(0, "job_id", key[0])
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, seq, stage = self.held.get() if self.held.exists() else (None, None, None)
        waited = last is not None and stage is not None
        out = []
        events = pd.concat([r[["ts", "seq", "stage"]] for r in rows]).sort_values(["ts", "seq"])
        for ts, number, name in events.itertuples(index=False):
            now = int(ts.value // 1_000_000)
            if stage is not None and last + self.millis <= now:  # its time came before this event
                last += self.millis
                out.append((seq, stage, last))
                seq = stage = None
            if last is None or now - last >= self.millis:
                last = now
                out.append((number, name, now))
            elif self.wait and (seq is None or number > seq):
                seq, stage = int(number), name
        for timer in list(self.handle.listTimers()) if waited else []:
            self.handle.deleteTimer(timer)
        if stage is not None:
            self.handle.registerTimer(last + self.millis)
        self.held.update((int(last), seq, stage))
        yield self._sent(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, seq, stage = self.held.get()
        due = last + self.millis
        if stage is not None:
            self.held.update((due, None, None))
            yield self._sent(key, [(seq, stage, due)])

    def close(self) -> None:
        pass


def throttle_timed(events: DataFrame, millis: int = PROGRESS_MILLIS, wait: bool = True, watermark: str = "1 seconds") -> DataFrame:
    """Progress of each job (job_id, ts, seq, stage) as a listener gets it: the first event at
    once, then the newest one per interval; `sent_ms` is when it is sent, in event time. A
    waiting event leaves once the watermark has passed its time. Needs the RocksDB state store."""
    rows = events.withWatermark("ts", watermark).select("job_id", "ts", "seq", "stage")
    return rows.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=Throttle(millis, wait), outputStructType=SENT, outputMode="Append", timeMode="EventTime"
    )


def broadcast_stream(events: DataFrame, millis: int = PIPELINE_MILLIS, watermark: str = "1 seconds") -> DataFrame:
    """Pipeline progress: events within an interval of the last one sent are dropped."""
    return throttle_timed(events, millis, wait=False, watermark=watermark)
