"""Driver queries over sessions and sequences."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from opweave.functions import text as T
from opweave.operators import sequences as S
from opweave.plans.catalogue import query
from opweave.plans.sequence import sequence
from opweave.session import cut, micros, table
from opweave.sources.tables import activities_once, activity_violations

ACTS = """acts AS (SELECT activity_id, session_id, start, "end", upper(trim(type)) AS type, lower(trim(app)) AS app, "window", browser_tab, browser_url, target_field, text, screen_text, entities, source_event_ids, triggered_by, verification_status, epoch_us(start) AS start_us, epoch_us("end") AS end_us
  FROM (SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY received_at) AS rn FROM activities) WHERE rn = 1)"""
SEQ = ACTS + """, seq AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start, activity_id) - 1 AS pos FROM acts)"""


def acts(spark: SparkSession, d: str) -> DataFrame:
    return activities_once(table(spark, d, "activities")).withColumn("start_us", micros("start")).withColumn("end_us", micros("end"))


@query("activity_checks", """SELECT 'missing_id' AS rule, count(*) FILTER (activity_id IS NULL) AS n FROM activities UNION ALL SELECT 'missing_session', count(*) FILTER (session_id IS NULL) FROM activities
UNION ALL SELECT 'missing_start', count(*) FILTER (start IS NULL) FROM activities UNION ALL SELECT 'end_before_start', count(*) FILTER ("end" < start) FROM activities
UNION ALL SELECT 'repeated_id', count(activity_id) - count(DISTINCT activity_id) FROM activities""")
def activity_checks(spark, d):
    return activity_violations(table(spark, d, "activities"))


@query("session_inventory", f"""WITH {ACTS}, h AS (SELECT session_id, type, count(*) AS n FROM acts GROUP BY ALL),
hist AS (SELECT session_id, string_agg(type || ':' || n, ',' ORDER BY type) AS types FROM h GROUP BY 1)
SELECT a.session_id, count(*) AS n_activities, min(start_us) AS first_us, max(start_us) AS last_us, count(DISTINCT app) AS n_apps, count(*) FILTER (app IS NULL) AS no_app, any_value(types) AS types
FROM acts a JOIN hist USING (session_id) GROUP BY 1""")
def session_inventory(spark, d):
    a = acts(spark, d).select("session_id", "type", "app", "start_us")
    by_type = a.groupBy("session_id", "type").agg(F.count("*").alias("n"), F.min("start_us").alias("f"), F.max("start_us").alias("l"), F.count_if(F.col("app").isNull()).alias("z"), F.collect_set("app").alias("apps"))
    return by_type.groupBy("session_id").agg(
        F.sum("n").alias("n_activities"), F.min("f").alias("first_us"), F.max("l").alias("last_us"), F.size(F.array_distinct(F.flatten(F.collect_list("apps")))).cast("long").alias("n_apps"), F.sum("z").alias("no_app"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "n"))), lambda s: F.concat(s["type"], F.lit(":"), s["n"].cast("string"))), ",").alias("types"),
    )


@query("dataset_rollup", f"""WITH {ACTS}, s AS (SELECT session_id, count(*) AS n FROM acts GROUP BY 1)
SELECT count(*) AS n_sessions, sum(n)::BIGINT AS n_activities, round(avg(n), 6) AS mean_per_session, min(n) AS least, max(n) AS most FROM s""")
def dataset_rollup(spark, d):
    s = acts(spark, d).groupBy("session_id").agg(F.count("*").alias("n"))
    return s.agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_activities"), F.round(F.avg("n"), 6).alias("mean_per_session"), F.min("n").alias("least"), F.max("n").alias("most"))


@query("gap_sessions", """WITH m AS (SELECT user_id, epoch_us(ts) AS us, event_id, lag(epoch_us(ts)) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR us - p > 21600e6 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM m)
SELECT user_id, session_no::BIGINT AS session_no, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM s GROUP BY 1, 2""")
def gap_sessions(spark, d):
    return S.gap_sessions(table(spark, d, "events"), "user_id", "ts", "event_id", 21600)


WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _low(x: str) -> str:
    return f"replace(replace(lower({x}), 'ς', 'σ'), 'ß', 'ss')"


def _fold(x: str) -> str:
    return f"trim(regexp_replace({_low(x)}, '{WS}', ' ', 'g'))"


def _jaccard(x: str, y: str) -> str:
    g = lambda c: f"list_distinct([{c}[i:i+1] for i in range(1, len({c}))])"
    n = f"len(list_intersect({g(x)}, {g(y)}))"
    return f"round(CASE WHEN {x} = '' OR {y} = '' THEN 0.0 WHEN {x} = {y} THEN 1.0 WHEN len({x}) < 2 OR len({y}) < 2 THEN 0.0 ELSE {n} / (len({g(x)}) + len({g(y)}) - {n}) END, 6)"


_PAIR_TYPES = ", ".join(f"'{t}'" for t in S.PAIR_ENTITIES)
_PAIR_SQL = f"""WITH {SEQ}, f AS (SELECT session_id, activity_id, pos, start_us / 1e6 AS t0, coalesce(end_us, start_us) / 1e6 AS t1, {", ".join(f"coalesce({_fold(c)}, '') AS {n}" for c, n in (("app", "app"), ('"window"', "win"), ("browser_tab", "tab"), ("type", "typ"), ("text", "txt"), ("screen_text", "scr")))},
 coalesce(split_part(split_part(regexp_replace({_fold("browser_url")}, '^[a-z]+://', ''), '/', 1), ':', 1), '') AS host, coalesce(list_filter(entities, lambda e: upper({_fold("e.type")}) IN ({_PAIR_TYPES})), []) AS ents, coalesce(list_distinct(list_filter(triggered_by, lambda x: x <> '')), []) AS links FROM seq),
k AS (SELECT *, list_distinct(list_transform(list_filter(ents, lambda e: {_fold("e.value")} <> ''), lambda e: upper({_fold("e.type")}) || ':' || {_fold("e.value")})) AS keys, list_distinct(list_transform(ents, lambda e: upper({_fold("e.type")}))) AS types FROM f),
p AS (SELECT b.session_id, b.activity_id, a.activity_id AS prev_activity_id, a.t0 AS a0, a.t1 AS a1, b.t0 AS b0, b.t1 AS b1, greatest(a.t1 - a.t0, 0.001) AS ad, greatest(b.t1 - b.t0, 0.001) AS bd, a AS x, b AS y FROM k a JOIN k b ON a.session_id = b.session_id AND b.pos = a.pos + 1)
SELECT session_id, activity_id, prev_activity_id, round(ln(1 + greatest(b0 - a1, 0)), 6) AS log_gap_seconds, round(greatest(least(a1, b1) - greatest(a0, b0), 0) / least(ad, bd), 6) AS overlap_ratio, round(ln(greatest(ad, bd) / least(ad, bd)), 6) AS duration_ratio_log,
 len(list_intersect(x.keys, y.keys))::DOUBLE AS shared_entity_count, len(list_intersect(x.types, y.types))::DOUBLE AS shared_entity_type_count, {_jaccard("x.txt", "y.txt")} AS text_similarity, {_jaccard("x.scr", "y.scr")} AS screen_similarity,
 len(x.keys)::DOUBLE AS entity_a_count, len(y.keys)::DOUBLE AS entity_b_count, (x.app <> '' AND x.app = y.app)::INT AS same_app, (x.win <> '' AND x.win = y.win)::INT AS same_window, (x.tab <> '' AND x.tab = y.tab)::INT AS same_browser_tab, (x.host <> '' AND x.host = y.host)::INT AS same_browser_domain,
 (x.typ = y.typ)::INT AS same_activity_type, (len(list_intersect(x.links, y.links)) > 0)::INT AS triggered_by, (len(list_intersect(x.keys, y.keys)) > 0)::INT AS has_shared_entity, (a0 <= b0)::INT AS a_before_b, x.typ || '|' || y.typ AS activity_type_pair FROM p"""


@query("pair_features", _PAIR_SQL)
def pair_features(spark, d):
    p = S.pair_features(S.consecutive_pairs(S.pair_columns(acts(spark, d)), "session_id", "start", "activity_id", S.PAIR_COLS))
    return p.select("session_id", "activity_id", "prev_activity_id", *S.PAIR_FEATURES)


@query("boundary_cuts", f"""WITH {SEQ}, p AS (SELECT *, lag(start_us) OVER w AS ps, lag(end_us) OVER w AS pe FROM seq WINDOW w AS (PARTITION BY session_id ORDER BY pos))
SELECT session_id, activity_id, floor((coalesce(pe, ps) + start_us) / 2)::BIGINT AS cut_us FROM p WHERE pos > 0 AND start_us - coalesce(pe, ps) > 12e6""")
def boundary_cuts(spark, d):
    p = S.consecutive_pairs(acts(spark, d), "session_id", "start", "activity_id", ["start_us", "end_us"])
    p = S.boundary_times(p).filter((F.col("start_us") - F.coalesce("prev_end_us", "prev_start_us")) > 12e6)
    return p.select("session_id", "activity_id", "cut_us")


@query("app_switches", f"""WITH {ACTS}, p AS (SELECT session_id, app, lag(app) OVER (PARTITION BY session_id ORDER BY start, activity_id) AS q FROM acts WHERE app IS NOT NULL)
SELECT session_id, count(*) FILTER (q <> app) AS n_switches FROM p GROUP BY 1""")
def app_switches(spark, d):
    return S.switches(acts(spark, d), "session_id", "start", "activity_id", "app")


@query("type_runs", f"""WITH {SEQ}, p AS (SELECT *, lag(type) OVER (PARTITION BY session_id ORDER BY pos) AS q FROM seq),
r AS (SELECT *, sum(CASE WHEN pos = 0 OR q IS DISTINCT FROM type THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run_no FROM p)
SELECT session_id, run_no::BIGINT AS run_no, min(type) AS type, count(*) AS n FROM r GROUP BY 1, 2""")
def type_runs(spark, d):
    return S.runs(acts(spark, d), "session_id", "start", "activity_id", "type")


@query("type_ngrams", f"""WITH {SEQ}, p AS (SELECT *, lag(type, 1) OVER w AS b, lag(type, 2) OVER w AS a FROM seq WINDOW w AS (PARTITION BY session_id ORDER BY pos))
SELECT a || '>' || b || '>' || type AS gram, count(*) AS n_occurrences, count(DISTINCT session_id) AS n_entities FROM p WHERE pos >= 2 GROUP BY 1""")
def type_ngrams(spark, d):
    return S.ngrams(acts(spark, d), "session_id", "start", "activity_id", "type", 3)


@query("relation_tokens", f"""WITH {SEQ}, p AS (SELECT *, lag(app) OVER w AS pa, lag("window") OVER w AS pw, lag(browser_tab) OVER w AS pb, lag(start_us) OVER w AS ps FROM seq WINDOW w AS (PARTITION BY session_id ORDER BY pos)),
t AS (SELECT 'REL::' || coalesce(app = pa, false)::INT || '::' || coalesce("window" = pw, false)::INT || '::' || coalesce(browser_tab = pb, false)::INT || '::G' || CASE WHEN start_us - ps <= 1e6 THEN 0 WHEN start_us - ps <= 3e6 THEN 1 WHEN start_us - ps <= 10e6 THEN 2 WHEN start_us - ps <= 30e6 THEN 3 ELSE 4 END AS token FROM p WHERE pos > 0)
SELECT token, count(*) AS n FROM t GROUP BY 1""")
def relation_tokens(spark, d):
    p = S.consecutive_pairs(acts(spark, d), "session_id", "start", "activity_id", ["app", "window", "browser_tab", "start_us"])
    same = lambda c: F.coalesce(F.col(c) == F.col(f"prev_{c}"), F.lit(False)).cast("int").cast("string")
    gap = S.gap_bucket((F.col("start_us") - F.col("prev_start_us")) / 1e6)
    token = F.concat(F.lit("REL::"), same("app"), F.lit("::"), same("window"), F.lit("::"), same("browser_tab"), F.lit("::G"), gap.cast("string"))
    return p.groupBy(token.alias("token")).agg(F.count("*").alias("n"))


_NEAR = """near AS (SELECT x.session_id, x.activity_id AS a, y.activity_id AS b, (y.start_us - x.start_us) / 1e6 AS gap_s FROM seq x JOIN seq y ON x.session_id = y.session_id AND y.pos BETWEEN x.pos + 1 AND x.pos + 20 WHERE y.start_us - x.start_us <= 45e6)"""


@query("near_pairs", f"WITH {SEQ}, {_NEAR} SELECT session_id, a, b, gap_s FROM near")
def near_pairs(spark, d):
    return S.near_pairs(acts(spark, d), "session_id", "start", "activity_id", 45, 20)


_LINKABLE = ", ".join(f"'{t}'" for t in T.LINKABLE)
_ENTS = f"""coalesce(list_distinct(list_transform(list_filter(entities, lambda e: {_low("trim(e.value)")} <> '' AND (upper(trim(e.type)) IN ({_LINKABLE}) OR upper(trim(e.type)) = 'URL' AND contains(regexp_replace({_low("trim(e.value)")}, '(?s)^.*?://', ''), '/'))), lambda e: upper(trim(e.type)) || chr(31) || {_low("trim(e.value)")})), [])"""
_SHARED = f"""ent AS (SELECT DISTINCT session_id, activity_id, start, v AS value FROM (SELECT session_id, activity_id, start, unnest({_ENTS}) AS v FROM acts)),
few AS (SELECT session_id, value FROM ent GROUP BY ALL HAVING count(*) BETWEEN 2 AND 200),
holders AS (SELECT ent.*, row_number() OVER (PARTITION BY session_id, value ORDER BY start, activity_id) AS k FROM ent SEMI JOIN few USING (session_id, value)),
shared AS (SELECT x.session_id, x.value, x.activity_id AS a, y.activity_id AS b FROM holders x JOIN holders y ON x.session_id = y.session_id AND x.value = y.value AND y.k BETWEEN x.k + 1 AND x.k + 5)"""


def _shared(a: DataFrame) -> DataFrame:
    a = a.select("session_id", "start", "activity_id", F.explode(T.linkable(F.col("entities"))).alias("value"))
    return S.shared_key_pairs(a, "session_id", "start", "activity_id", "value", 5, 200)


@query("shared_key_pairs", f"WITH {ACTS}, {_SHARED} SELECT session_id, value, a, b FROM shared")
def shared_key_pairs(spark, d):
    """Activities of a session that name the same object, each with its next five; more than 200 holders are context, not evidence."""
    return _shared(acts(spark, d))


_TRIG = """trig AS (SELECT DISTINCT t.session_id, s.a, t.b FROM (SELECT session_id, activity_id AS b, unnest(triggered_by) AS ref FROM acts) t
 JOIN (SELECT session_id, activity_id AS a, activity_id AS id FROM acts UNION SELECT session_id, activity_id, unnest(source_event_ids) FROM acts) s ON t.ref = s.id AND t.session_id = s.session_id WHERE s.a <> t.b)"""


@query("trigger_pairs", f"WITH {ACTS}, {_TRIG} SELECT session_id, a, b FROM trig")
def trigger_pairs(spark, d):
    return S.trigger_pairs(acts(spark, d))


def _edge_acts(spark: SparkSession, d: str) -> DataFrame:
    """What edges need of the activities, without repeats, written once for its seven readers."""
    return cut(acts(spark, d).select("session_id", "activity_id", "start", "start_us", "app", "window", "browser_tab", "text", "entities", "source_event_ids", "triggered_by"))


def _candidates(a: DataFrame) -> DataFrame:
    n = S.near_pairs(a, "session_id", "start", "activity_id", 45, 20).select("session_id", "a", "b", F.lit("nearby").alias("reason"))
    s = _shared(a).select("session_id", "a", "b", F.lit("shared_entity").alias("reason"))
    t = S.trigger_pairs(a).select("session_id", "a", "b", F.lit("triggered_by").alias("reason"))
    x = S.canonical(n.unionByName(s).unionByName(t))
    return x.groupBy("session_id", "a", "b").agg(F.array_join(F.array_sort(F.collect_set("reason")), "+").alias("reasons"))


def candidates(spark, d):
    return _candidates(_edge_acts(spark, d))


_CAND = _NEAR + ", " + _SHARED + ", " + _TRIG + """, cand AS (SELECT session_id, least(a, b) AS a, greatest(a, b) AS b, string_agg(DISTINCT reason, '+' ORDER BY reason) AS reasons FROM (
 SELECT session_id, a, b, 'nearby' AS reason FROM near UNION ALL SELECT session_id, a, b, 'shared_entity' FROM shared UNION ALL SELECT session_id, a, b, 'triggered_by' FROM trig) WHERE a <> b GROUP BY ALL)"""


@query("candidate_union", f"WITH {SEQ}, {_CAND} SELECT session_id, a, b, reasons FROM cand")
def candidate_union(spark, d):
    return candidates(spark, d)


@query("edge_scores", f"""WITH {SEQ}, {_CAND}, n AS (SELECT activity_id, start_us, {", ".join(f"coalesce({_low(f'trim({c})')}, '') AS {k}" for c, k in (("app", "app"), ('"window"', "win"), ("browser_tab", "tab"), ("text", "txt")))}, {_ENTS} AS ents FROM acts),
f AS (SELECT c.*, abs(x.start_us - y.start_us) / 1e6 AS gap_s, len(list_intersect(x.ents, y.ents))::INT AS n_shared, reasons LIKE '%triggered_by%' AS trig, x.win <> '' AND x.win = y.win AS sw, x.app <> '' AND x.app = y.app AS sa, x.tab <> '' AND x.tab = y.tab AS st,
 len(x.txt) >= 4 AND len(y.txt) >= 4 AND (contains(x.txt, y.txt) OR contains(y.txt, x.txt)) AS sem FROM cand c JOIN n x ON c.a = x.activity_id JOIN n y ON c.b = y.activity_id),
s AS (SELECT *, 5 * (n_shared > 0)::INT + 5 * trig::INT + 2 * sw::INT + 2 * sa::INT + st::INT + sem::INT + (gap_s <= 30)::INT - (gap_s > 120)::INT AS score FROM f)
SELECT session_id, a, b, reasons, gap_s, n_shared, concat_ws(',', CASE WHEN n_shared > 0 THEN 'same_entity' END, CASE WHEN trig THEN 'triggered_by' END, CASE WHEN sw THEN 'same_window' END, CASE WHEN sa THEN 'same_app' END, CASE WHEN st THEN 'same_browser_tab' END, CASE WHEN sem THEN 'semantic_match' END, CASE WHEN gap_s <= 30 THEN 'close_in_time' END, CASE WHEN gap_s > 120 THEN 'large_time_gap' END) AS evidence,
 score, CASE WHEN n_shared > 0 OR trig THEN 'STRONG' WHEN score >= 3 THEN 'MODERATE' ELSE 'WEAK' END AS strength FROM s""")
def edge_scores(spark, d):
    return scored_edges(spark, d)


def scored_edges(spark, d):
    a = _edge_acts(spark, d)
    return S.score_edges(_candidates(a), a)


@query("edge_checks", f"""WITH {SEQ}, {_CAND} SELECT count(*) AS n_edges, count(*) FILTER (a >= b) AS not_canonical, count(*) - count(DISTINCT (a, b)) AS repeated, count(*) FILTER (reasons = '') AS no_reason FROM cand""")
def edge_checks(spark, d):
    c = candidates(spark, d)
    return c.agg(F.count("*").alias("n_edges"), F.count_if(F.col("a") >= F.col("b")).alias("not_canonical"), (F.count("*") - F.count_distinct("a", "b")).alias("repeated"), F.count_if(F.col("reasons") == "").alias("no_reason"))


@query("bigram_jaccard", f"""WITH {SEQ}, p AS (SELECT session_id, activity_id, pos, lower("window") AS x, lag(lower("window")) OVER (PARTITION BY session_id ORDER BY pos) AS y FROM seq),
g AS (SELECT *, list_distinct([x[i:i+1] for i in range(1, len(x))]) AS gx, list_distinct([y[i:i+1] for i in range(1, len(y))]) AS gy FROM p WHERE pos > 0)
SELECT session_id, activity_id, round(CASE WHEN coalesce(x, '') = '' OR coalesce(y, '') = '' THEN 0.0 WHEN x = y THEN 1.0 WHEN len(x) < 2 OR len(y) < 2 THEN 0.0 ELSE len(list_intersect(gx, gy)) / (len(gx) + len(gy) - len(list_intersect(gx, gy))) END, 6) AS similarity FROM g""")
def bigram_jaccard(spark, d):
    p = S.consecutive_pairs(acts(spark, d), "session_id", "start", "activity_id", ["window"])
    return p.select("session_id", "activity_id", F.round(S.char_bigram_jaccard(F.lower("window"), F.lower("prev_window")), 6).alias("similarity"))


@query("clipboard_external", f"""WITH {SEQ}, c AS (SELECT *, max(CASE WHEN type = 'SHORTCUT' AND text = 'ctrl+c' THEN start_us END) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_copy FROM seq)
SELECT session_id, activity_id, start_us FROM c WHERE type = 'COPY' AND (last_copy IS NULL OR start_us - last_copy > 1000000)""")
def clipboard_external(spark, d):
    """COPY activities with no copy shortcut in the second before: the shortcuts' times are equi-joined by second, not scanned per session."""
    a = acts(spark, d).select("session_id", "activity_id", "type", "text", "start", "start_us")
    keys = a.filter("type = 'SHORTCUT' and text = 'ctrl+c'")
    sec = F.floor(F.col("start_us") / 1_000_000)
    k = keys.select(F.col("session_id").alias("ks"), F.explode(F.array(sec, sec + 1)).alias("sec"), F.col("start_us").alias("kus"), F.col("activity_id").alias("kid"))
    c = a.filter("type = 'COPY'").withColumn("csec", sec)
    on = (F.col("session_id") == F.col("ks")) & (F.col("csec") == F.col("sec")) & (F.col("start_us") - F.col("kus") <= 1_000_000) & ((F.col("kus") < F.col("start_us")) | (F.col("kus") == F.col("start_us")) & (F.col("kid") < F.col("activity_id")))
    return c.join(k, on, "left_anti").select("session_id", "activity_id", "start_us")
