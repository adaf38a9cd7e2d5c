"""Streaming forms: inactivity sessions with watermarks, and the activity builder as keyed state."""
from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from opweave.operators.activity_builder import ACTIVITY, NAMES
from opweave.operators.text_engine import Builder, event_order, normalize


def streaming_gap_sessions(events: DataFrame, entity: str, time: str, gap: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """session_window over a stream: (entity, start, end, n); rows later than the watermark are dropped by Spark."""
    s = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    g = s.groupBy(entity, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(entity, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def streaming_counts(events: DataFrame, time: str, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Tumbling or sliding window counts with a watermark."""
    s = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return s.groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    builder: Builder = pickle.loads(state.get[0]) if state.exists else Builder(key[0])
    done: list[dict] = []
    if state.hasTimedOut:
        done += builder.finish()
        state.remove()
    else:
        rows = pd.concat(list(frames))
        events = [
            {"event_id": r.event_id, "session_id": key[0], "timestamp_ms": int(r.timestamp_ms), "timestamp_iso": r.timestamp_iso, "event_type": r.event_type, **{k: json.loads(getattr(r, k) or "{}") for k in ("payload", "context", "correlation")}}
            for r in rows.itertuples(index=False)
        ]
        for op in normalize(sorted(events, key=event_order)):
            done += builder.feed(op)
        builder.recent = None  # a later batch cannot change what is already out
        state.update((pickle.dumps(builder),))
        state.setTimeoutDuration(60_000)
    if done:
        yield pd.DataFrame([{k: a[k] for k in NAMES} for a in done], columns=NAMES)


def streaming_activities(events: DataFrame) -> DataFrame:
    """Activities as they complete; open runs live in the state store and end by a minute's processing-time silence."""
    cols = ["event_id", "session_id", "timestamp_ms", "timestamp_iso", "event_type", "payload", "context", "correlation"]
    return events.select(*cols).groupBy("session_id").applyInPandasWithState(_step, ACTIVITY, "builder binary", "append", GroupStateTimeout.ProcessingTimeTimeout)
