"""Driver queries of the activity builder, state machines and grouping."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opweave.operators import grouping as G, sequences as S
from opweave.operators.activity_builder import build_activities
from opweave.operators.text_engine import EVENT_OPS
from opweave.plans.catalogue import query
from opweave.plans.interval_queries import PRED, SEGS, segment_code, segs
from opweave.plans.positions import with_positions
from opweave.plans.session_queries import ACTS, SEQ, acts
from opweave.session import micros, table


@query("activity_rebuild", f"""WITH {ACTS} SELECT activity_id, text FROM acts WHERE type = 'TEXT_ENTRY' AND regexp_full_match(text, '[!-~]([ -~]*[!-~])?')""")
def activity_rebuild(spark, d):
    """Round trip: the text of every text entry, typed key by key into the builder, comes back."""
    a = acts(spark, d).filter((F.col("type") == "TEXT_ENTRY") & F.col("text").rlike(r"\A[!-~]([ -~]*[!-~])?\z"))
    a = with_positions(a.select("session_id", "start", "activity_id", "text"), "session_id", "start", "activity_id")
    k = a.select("session_id", "activity_id", "pos", F.posexplode(F.split("text", "")).alias("i", "c"))
    ms = F.col("pos") * 1_000_000 + F.col("i") * 20
    e = k.select(
        F.concat_ws(":", "activity_id", "i").alias("event_id"), "session_id", ms.cast("long").alias("timestamp_ms"), F.lpad(ms.cast("string"), 16, "0").alias("timestamp_iso"), F.lit("keystroke").alias("event_type"),
        F.to_json(F.struct(F.col("c").alias("key"), F.col("c").alias("character"), F.col("activity_id").alias("target_field"))).alias("payload"), F.lit("{}").alias("context"), F.lit("{}").alias("correlation"),
    )
    return build_activities(e).select(F.col("target_field").alias("activity_id"), "text")


@query("activity_rebuild_all", f"""WITH {ACTS} SELECT activity_id, text FROM acts WHERE type = 'TEXT_ENTRY' AND text <> ''""")
def activity_rebuild_all(spark, d):
    """Round trip of every text entry: printable characters are typed, all others (line breaks, tabs, wide blanks, format characters) put on the clipboard and pasted."""
    a = acts(spark, d).filter((F.col("type") == "TEXT_ENTRY") & (F.col("text") != ""))
    a = with_positions(a.select("session_id", "start", "activity_id", "text"), "session_id", "start", "activity_id")
    k = a.select("session_id", "activity_id", "pos", F.posexplode(F.split("text", "")).alias("i", "c")).withColumn("pasted", F.col("c").rlike(r"\A[\p{C}\p{Z}&&[^ ]]\z"))
    event = lambda kind, at, **p: F.struct(F.lit(kind).alias("kind"), F.lit(at).alias("at"), F.to_json(F.struct(*[v.alias(n) for n, v in p.items()], F.col("activity_id").alias("target_field"))).alias("payload"))
    typed = event("keystroke", 0, key=F.col("c"), character=F.col("c"))
    paste = event("keystroke", 20, key=F.lit("v"), modifiers=F.array(F.lit("ctrl")))
    k = k.select("session_id", "activity_id", "pos", "i", F.explode(F.when(F.col("pasted"), F.array(event("clipboard_change", 0, content=F.col("c")), paste)).otherwise(F.array(typed))).alias("e"))
    # 100 ms a character: beyond the reach of an echo
    ms = F.col("pos") * 10_000_000 + F.col("i") * 100 + F.col("e.at")
    e = k.select(
        F.concat_ws(":", "activity_id", "i", "e.at").alias("event_id"), "session_id", ms.cast("long").alias("timestamp_ms"), F.lpad(ms.cast("string"), 16, "0").alias("timestamp_iso"), F.col("e.kind").alias("event_type"),
        F.col("e.payload").alias("payload"), F.lit("{}").alias("context"), F.lit("{}").alias("correlation"),
    )
    return build_activities(e).filter("type = 'TEXT_ENTRY'").select(F.col("target_field").alias("activity_id"), "text")


_MAP = {"view": "NAVIGATE", "click": "CLICK"}


@query("event_operations", "SELECT CASE event_type WHEN 'click' THEN 'CLICK' ELSE 'OTHER_EVENT' END AS operation, count(*) AS n FROM events GROUP BY 1")
def event_operations(spark, d):
    """Event types mapped to operations; unknown types are OTHER_EVENT."""
    m = F.create_map(*[F.lit(x) for kv in EVENT_OPS.items() for x in kv])
    return table(spark, d, "events").groupBy(F.coalesce(m[F.col("event_type")], F.lit("OTHER_EVENT")).alias("operation")).agg(F.count("*").alias("n"))


_LOG = """log AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'view' THEN 'process_started' WHEN 'signup' THEN 'process_started' WHEN 'click' THEN 'process_resumed' WHEN 'purchase' THEN 'process_suspended' WHEN 'error' THEN 'session_ended' END AS event, CASE event_type WHEN 'signup' THEN 'P1' ELSE 'P2' END AS process, CASE WHEN value > 20 THEN 'A' ELSE 'B' END AS case_id FROM events)"""


def process_log(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    m = F.create_map(*[F.lit(x) for x in ("view", "process_started", "signup", "process_started", "click", "process_resumed", "purchase", "process_suspended", "error", "session_ended")])
    return e.select("user_id", "ts", "event_id", m[F.col("event_type")].alias("event"), F.when(F.col("event_type") == "signup", "P1").otherwise("P2").alias("process"), F.when(F.col("value") > 20, "A").otherwise("B").alias("case_id"))


@query("process_segments", f"""WITH {_LOG}, st AS (SELECT *, CASE WHEN event LIKE 'process_started' THEN process || '/' || case_id WHEN event = 'process_resumed' THEN process || '/-' END AS state FROM log),
lg AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM st), kp AS (SELECT * FROM lg WHERE NOT (event = 'process_started' AND coalesce(b = state, false))),
nx AS (SELECT *, lead(epoch_us(ts)) OVER w AS end_us, lead(event) OVER w AS end_event FROM kp WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, process, CASE WHEN event = 'process_started' THEN case_id END AS case_id, epoch_us(ts) AS start_us, end_us, end_event FROM nx WHERE state IS NOT NULL AND end_us > epoch_us(ts)""")
def process_segments(spark, d):
    return G.process_segments(process_log(spark, d), "user_id", "ts", "event_id")


@query("process_totals", f"""WITH {_LOG} SELECT count(*) AS n_events, count(DISTINCT user_id) AS n_sessions, count(DISTINCT process) AS n_processes, count(*) FILTER (event = 'process_started') AS n_starts FROM log""")
def process_totals(spark, d):
    return process_log(spark, d).agg(F.count("*").alias("n_events"), F.count_distinct("user_id").alias("n_sessions"), F.count_distinct("process").alias("n_processes"), F.count_if(F.col("event") == "process_started").alias("n_starts"))


@query("segment_execution_match", f"""WITH {PRED}, {SEGS}, j AS (SELECT p.session_id, p.pred, g.label, g.seg, CASE WHEN pe > ps THEN least(pe, e) - greatest(ps, s) ELSE 1 END AS score FROM preds p JOIN segs g ON p.session_id = g.session_id AND ps <= e AND s <= pe),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, pred ORDER BY score DESC, seg) AS rn FROM j WHERE score > 0), a AS (SELECT session_id, label, seg, row_number() OVER (PARTITION BY session_id, label ORDER BY s, e) AS k FROM segs), b AS (SELECT session_id, label, pred, row_number() OVER (PARTITION BY session_id, label ORDER BY pred) AS k FROM r WHERE rn = 1)
SELECT coalesce(a.session_id, b.session_id) AS session_id, coalesce(a.label, b.label) AS label, coalesce(a.k, b.k) AS k, seg, pred::BIGINT AS pred FROM a FULL JOIN b ON a.session_id = b.session_id AND a.label = b.label AND a.k = b.k""")
def segment_execution_match(spark, d):
    return G.match_one_to_one(segs(spark, d), segment_code(spark, d), ["session_id", "label"], ["s", "e"], ["pred"]).select("session_id", "label", "k", "seg", "pred")


@query("key_equality", f"WITH {SEGS}, a AS (SELECT DISTINCT label FROM segs), b AS (SELECT DISTINCT label FROM vs) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b WHERE label IS NOT NULL EXCEPT SELECT * FROM a)) AS only_right")
def key_equality(spark, d):
    """Both key sets must match: what either side has alone."""
    from opweave.sources.tables import valid_segments

    a, b = segs(spark, d).select("label").distinct(), valid_segments(table(spark, d, "segments")).filter("label is not null").select(F.col("label").alias("bl")).distinct()
    n = lambda df, c: df.agg(F.count("*").alias(c)).withColumn("k", F.lit(1))
    left = n(a.join(b, F.col("label") == F.col("bl"), "left_anti"), "only_left")
    return left.join(n(b.join(a, F.col("label") == F.col("bl"), "left_anti"), "only_right"), "k").drop("k")


CUES = ("invoice", "claim", "report", "approve", "経費", "請求")


@query("cue_coverage", f"""WITH {SEQ}, cues AS (SELECT unnest(['invoice', 'claim', 'report', 'approve', '経費', '請求']) AS cue), ev AS (SELECT type, session_id, lower(concat_ws(' ', "window", browser_tab, text)) AS t FROM acts),
g AS (SELECT type, cue, count(*) FILTER (contains(t, cue)) AS matches, count(DISTINCT session_id) FILTER (contains(t, cue)) AS hit, any_value(n) AS n FROM ev JOIN (SELECT type, count(DISTINCT session_id) AS n FROM acts GROUP BY 1) USING (type), cues GROUP BY 1, 2)
SELECT type, cue, matches, hit, round(hit / n, 6) AS coverage FROM g WHERE hit >= 2 AND hit / n >= 0.05""")
def cue_coverage(spark, d):
    """Share of a type's sessions whose evidence holds a cue; the cues are a fixed list exploded beside each text once."""
    t = F.lower(F.concat_ws(" ", "window", "browser_tab", "text"))
    a = acts(spark, d).select("type", "session_id", t.alias("t"))
    n = a.groupBy(F.col("type").alias("nt")).agg(F.count_distinct("session_id").alias("n"))
    hits = F.filter(F.array(*map(F.lit, CUES)), lambda c: F.contains(F.col("t"), c))
    h = a.select("type", "session_id", F.explode(hits).alias("cue")).groupBy("type", "cue").agg(F.count("*").alias("matches"), F.count_distinct("session_id").alias("hit"))
    x = h.join(n, F.col("type") == F.col("nt")).withColumn("coverage", F.round(F.col("hit") / F.col("n"), 6))
    return x.filter((F.col("hit") >= 2) & (F.col("hit") / F.col("n") >= 0.05)).select("type", "cue", "matches", "hit", "coverage")


@query("activity_groups")
def activity_groups(spark, d):
    """Greedy grouping of activities into executions by scored links."""
    return G.linked_groups(acts(spark, d))
