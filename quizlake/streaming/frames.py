"""Smart frame filter over a stream of frame features.

Per job the state is one row: the last kept frame. Frames are ordered inside a micro-batch;
one that arrives with an index at or below the last seen one is reported late, not decided.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quizlake.functions import frames as ff
from quizlake.operators.frame_filters import FrameFold, fold_rows

STATE = "seen bigint, kept_idx bigint, kept_hash bigint, kept_sec double, kept_roi array<double>"
OUTPUT = (
    "job_id string, frame_idx bigint, seconds double, accepted boolean, blank boolean, duplicate boolean, "
    "change_ratio double, late boolean"
)


class FrameFilter(StatefulProcessor):
    def __init__(self, smart: bool, threshold: float, cooldown: float, ttl_ms: int | None):
        self.smart, self.threshold, self.cooldown, self.ttl_ms = smart, threshold, cooldown, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", STATE, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("frame_idx")
        fold, seen = FrameFold(self.smart, self.threshold, self.cooldown), -1
        held = self.last.get() if self.last.exists() else None
        if held is not None:
            seen = held[0]
            fold.load(*held[1:])
        late = (pdf["frame_idx"] <= seen) | pdf["frame_idx"].duplicated()
        fresh = pdf[~late]
        out = pd.concat([fresh[["job_id", "frame_idx", "seconds"]], fold_rows(fold, fresh)], axis=1).assign(late=False)
        if len(fresh):
            roi = None if fold.roi is None else [float(x) for x in np.asarray(fold.roi)]
            self.last.update((int(fresh["frame_idx"].max()), fold.idx, fold.hash, fold.sec, roi))
        if late.any():
            missed = pdf[late][["job_id", "frame_idx", "seconds"]].assign(
                accepted=False, blank=False, duplicate=False, change_ratio=0.0, late=True
            )
            out = pd.concat([out, missed]) if len(out) else missed
        yield out

    def close(self) -> None:
        pass


def filter_stream(features: DataFrame, smart: bool = True, threshold: float = ff.DEFAULT_CHANGE_THRESHOLD,
                  cooldown: float = ff.DEFAULT_COOLDOWN, ttl_ms: int | None = None) -> DataFrame:
    """Decisions as frames arrive. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass)."""
    from pyspark.sql import functions as F

    ready = features.withColumn("phash", F.coalesce("phash", F.lit(0).cast("bigint")))
    return ready.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=FrameFilter(smart, threshold, cooldown, ttl_ms),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None",
    )
