"""Rebuilds activities from raw recorder events, one ordered stream per session."""
from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from opweave.operators.text_engine import OCR_MS, Builder, normalize

ACTIVITY = (
    "activity_id string, session_id string, start string, `end` string, type string, app string, window string, browser_tab string, browser_url string, target_field string, text string, screen_text string, "
    "entities array<struct<type:string,value:string>>, source_event_ids array<string>, triggered_by array<string>, source_event_types array<string>, chunk_ids array<string>, browser_value string, screen_value string, input_complete_value string, verification_status string, undo_used boolean, paste_content_unknown boolean, input_complete_count int"
)
NAMES = [c.strip().split(" ")[0].strip("`") for c in ACTIVITY.replace("struct<type:string,value:string>", "struct").split(",")]
QUIET_MS = 1_000  # no echo reaches across such a pause: events are normalised pause by pause


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    builder: Builder | None = None
    burst: list[dict] = []
    held: list[dict] = []  # finished, but a late screen text may still change the last ones

    def frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame([{k: r[k] for k in NAMES} for r in rows], columns=NAMES)

    def flush() -> None:
        for op in normalize(burst):
            held.extend(builder.feed(op))
        burst.clear()

    for b in batches:
        done: list[dict] = []
        for r in b.itertuples(index=False):
            if builder is None or r.session_id != builder.session:
                if builder is not None:
                    flush()
                    held.extend(builder.finish())
                    done += held
                    held = []
                builder = Builder(r.session_id)
            if burst and r.timestamp_ms - burst[-1]["timestamp_ms"] > QUIET_MS:
                flush()
                safe = [a for a in held if r.timestamp_ms - a["start_ms"] > 100 * OCR_MS and (builder.recent is None or a is not builder.recent["activity"])]
                done += safe
                held = [a for a in held if not any(a is s for s in safe)]
            burst.append({"event_id": r.event_id, "session_id": r.session_id, "timestamp_ms": int(r.timestamp_ms), "timestamp_iso": r.timestamp_iso, "event_type": r.event_type, **{k: json.loads(getattr(r, k) or "{}") for k in ("payload", "context", "correlation")}})
        if done:
            yield frame(done)
    if builder is not None:
        flush()
        held.extend(builder.finish())
        yield frame(held)


def build_activities(events: DataFrame) -> DataFrame:
    """Activities of raw events.

    events: event_id, session_id, timestamp_ms, timestamp_iso, event_type and the JSON texts payload,
    context and correlation (null or empty: no fields).  Rows without id, session or time are left out.
    Sessions stream through their task in order; the state is the open run, a burst of events without a pause and
    the activities a late screen text may still reach."""
    seq = F.coalesce(F.get_json_object("correlation", "$.sequence_number").cast("long"), F.lit(0))
    cols = ["event_id", "session_id", "timestamp_ms", "timestamp_iso", "event_type", "payload", "context", "correlation"]
    e = events.select(*cols).dropna(subset=["event_id", "session_id", "timestamp_ms"]).withColumn("__s", seq)
    e = e.repartition("session_id").sortWithinPartitions("session_id", "timestamp_ms", "__s", "event_id").drop("__s")
    return e.mapInPandas(_fold, ACTIVITY)


def mark_echoes(events: DataFrame) -> DataFrame:
    """Adds echo: keystrokes within 10 ms of a command keystroke of the same key and target, declaratively.

    events: session_id, event_id, timestamp_ms, seq, event_type, key, target, command (boolean)."""
    from opweave.plans.sequence import sequence

    x = events.filter("event_type <> 'shortcut'").withColumn("time", F.timestamp_millis("timestamp_ms"))
    x = x.withColumn("id", F.concat_ws(":", F.lpad(F.coalesce(F.col("seq"), F.lit(0)).cast("string"), 12, "0"), "event_id"))
    y, w = sequence(x, "session_id", "time", "id")
    prev: dict[str, Column] = {c: F.lag(c).over(w) for c in ("key", "target", "command", "timestamp_ms", "event_type")}
    echo = (F.col("event_type") == "keystroke") & (prev["event_type"] == "keystroke") & prev["command"] & ~F.col("command") & (prev["key"] == F.col("key")) & prev["target"].eqNullSafe(F.col("target")) & ((F.col("timestamp_ms") - prev["timestamp_ms"]).between(0, 10))
    return y.withColumn("echo", F.coalesce(echo, F.lit(False))).filter("own").select("session_id", "event_id", "echo")
