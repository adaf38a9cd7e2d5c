"""Driver queries over segments, ownership and boundaries."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from opweave.operators import intervals as I, sequences as S
from opweave.operators.interval_periods import interval_periods, parse_ms
from opweave.plans.catalogue import query
from opweave.plans.session_queries import ACTS, SEQ, acts
from opweave.session import table
from opweave.sources.tables import labelled_segments, valid_segments

_MS = """epoch_ms(try_cast(trim(start) AS TIMESTAMPTZ)) AS s, epoch_ms(try_cast(trim("end") AS TIMESTAMPTZ)) AS e"""
SEGS = f"""vs AS (SELECT DISTINCT session_id, s, e, label FROM (SELECT session_id, {_MS}, label FROM segments) WHERE e > s),
segs AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY s, e) AS seg FROM (SELECT session_id, s, e, min(label) AS label FROM vs WHERE trim(label) <> '' GROUP BY ALL))"""
# predicted sessions: gaps of more than 60 s between starts
PRED = f"""{SEQ}, pm AS (SELECT *, lag(start_us) OVER (PARTITION BY session_id ORDER BY pos) AS ps FROM seq),
pg AS (SELECT *, sum(CASE WHEN ps IS NULL OR start_us - ps > 60e6 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS pred FROM pm),
preds AS (SELECT session_id, pred, (min(start_us) // 1000)::BIGINT AS ps, (max(start_us) // 1000)::BIGINT AS pe FROM pg GROUP BY 1, 2)"""
_AIV = """(a.start_us // 1000) AS a_s, (coalesce(a.end_us, a.start_us) // 1000) AS a_e"""


def segs(spark: SparkSession, d: str) -> DataFrame:
    return labelled_segments(table(spark, d, "segments"))


def preds(spark: SparkSession, d: str) -> DataFrame:
    p = S.gap_sessions(table(spark, d, "activities"), "session_id", "start", "activity_id", 60)
    return p.select("session_id", F.col("session_no").alias("pred"), F.floor(F.col("start_us") / 1000).cast("long").alias("ps"), F.floor(F.col("end_us") / 1000).cast("long").alias("pe"))


def act_seg(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    a = acts(spark, d).withColumn("a_s", F.floor(F.col("start_us") / 1000).cast("long")).withColumn("a_e", F.floor(F.coalesce("end_us", "start_us") / 1000).cast("long"))
    s = segs(spark, d).withColumnsRenamed({"s": "b_s", "e": "b_e"})
    return I.overlap_join(a, s, "session_id", ["activity_id", *cols], ["seg", "label"])


_J = f"""j AS (SELECT a.session_id, a.activity_id, a.type, a.app, a.start, {_AIV}, g.seg, g.label, g.s AS b_s, g.e AS b_e, least(a_e, g.e) - greatest(a_s, g.s) AS ov, a_e <= a_s AS point
 FROM acts a JOIN segs g ON a.session_id = g.session_id AND (a.start_us // 1000) <= g.e AND g.s <= (coalesce(a.end_us, a.start_us) // 1000))"""


def _own_sql(order: str) -> str:
    return f"""WITH {ACTS}, {SEGS}, {_J}, r AS (SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY {order}) AS rn FROM j WHERE point OR ov > 0) SELECT session_id, activity_id, seg, label FROM r WHERE rn = 1"""


_ORDERS = {
    "boundary": "CASE WHEN point THEN (b_s = a_s)::BIGINT ELSE ov END DESC, CASE WHEN point THEN 0 ELSE abs((a_s + a_e) - (b_s + b_e)) END, b_s DESC, seg",
    "earliest": "ov DESC, b_s, seg",
    "previous": "CASE WHEN point THEN (b_e = a_s)::BIGINT ELSE ov END DESC, seg",
}
for _rule, _order in _ORDERS.items():

    @query(f"own_{_rule}", _own_sql(_order))
    def _own(spark, d, rule=_rule):
        return I.own(act_seg(spark, d), "activity_id", "seg", rule).select("session_id", "activity_id", "seg", "label")


@query("own_evidence", f"WITH {ACTS}, {SEGS}, {_J} SELECT session_id, seg, activity_id FROM j")
def own_evidence(spark, d):
    """Every activity in every segment it touches, bounds included."""
    return act_seg(spark, d).select("session_id", "seg", "activity_id")


@query("own_counters", f"""WITH {ACTS}, {SEGS}, {_J}, k AS (SELECT activity_id, count(*) AS n, bool_or(point) AS point, bool_or(b_e = a_s) AS ends, count(*) FILTER (ov > 0) AS over FROM j WHERE point OR ov > 0 GROUP BY 1)
SELECT (SELECT count(*) FROM acts) AS n_activities, count(*) AS assigned, count(*) FILTER (point AND n > 1 AND ends) AS boundary_ties, count(*) FILTER (NOT point AND over > 1) AS multi_overlap FROM k""")
def own_counters(spark, d):
    x = act_seg(spark, d).withColumn("ov", F.least("a_e", "b_e") - F.greatest("a_s", "b_s")).withColumn("point", F.col("a_e") <= F.col("a_s")).filter("point or ov > 0")
    k = x.groupBy("activity_id").agg(F.count("*").alias("n"), F.max("point").alias("point"), F.max(F.col("b_e") == F.col("a_s")).alias("ends"), F.count_if(F.col("ov") > 0).alias("over"))
    k = k.agg(F.count("*").alias("assigned"), F.count_if(F.expr("point and n > 1 and ends")).alias("boundary_ties"), F.count_if(F.expr("not point and over > 1")).alias("multi_overlap"))
    n = table(spark, d, "activities").agg(F.count_distinct("activity_id").alias("n_activities"))
    return n.withColumn("k", F.lit(1)).join(k.withColumn("k", F.lit(1)), "k").drop("k")  # one row beside one row


@query("segment_code", f"""WITH {PRED}, {SEGS}, j AS (SELECT p.session_id, p.pred, g.label, g.seg, CASE WHEN pe > ps THEN least(pe, e) - greatest(ps, s) ELSE 1 END AS score FROM preds p JOIN segs g ON p.session_id = g.session_id AND ps <= e AND s <= pe),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, pred ORDER BY score DESC, seg) AS rn FROM j WHERE score > 0) SELECT session_id, pred::BIGINT AS pred, label FROM r WHERE rn = 1""")
def segment_code(spark, d):
    p = preds(spark, d).withColumnsRenamed({"ps": "a_s", "pe": "a_e"})
    j = I.overlap_join(p, segs(spark, d).withColumnsRenamed({"s": "b_s", "e": "b_e"}), "session_id", ["pred"], ["seg", "label"])
    j = j.withColumn("score", F.when(F.col("a_e") > F.col("a_s"), F.least("a_e", "b_e") - F.greatest("a_s", "b_s")).otherwise(1)).filter("score > 0")
    w = Window.partitionBy("session_id", "pred").orderBy(F.desc("score"), "seg")
    return j.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("session_id", "pred", "label")


@query("session_bounds", f"""WITH p AS (SELECT session_id, start, "end", {_MS} FROM segments), v AS (SELECT * FROM p WHERE s IS NOT NULL AND e IS NOT NULL)
SELECT session_id, min(s) AS first_ms, max(e) AS last_ms FROM v GROUP BY 1 HAVING max(e) > min(s)""")
def session_bounds(spark, d):
    x = table(spark, d, "segments").select("session_id", parse_ms(F.col("start")).alias("s"), parse_ms(F.col("end")).alias("e")).dropna(subset=["s", "e"])
    return x.groupBy("session_id").agg(F.min("s").alias("first_ms"), F.max("e").alias("last_ms")).filter("last_ms > first_ms")


@query("overlap_check", f"""WITH {SEGS}, l AS (SELECT *, lag(e) OVER (PARTITION BY session_id ORDER BY s, e) AS pe FROM segs) SELECT session_id, seg, pe - s AS overlap_ms FROM l WHERE s < pe""")
def overlap_check(spark, d):
    """Strictly adjacent comparison: the next segment starts before the one before it ends."""
    x = segs(spark, d).withColumn("pe", F.lag("e").over(Window.partitionBy("session_id").orderBy("s", "e")))
    return x.filter("s < pe").select("session_id", "seg", (F.col("pe") - F.col("s")).alias("overlap_ms"))


@query("segment_violations", f"""WITH p AS (SELECT *, {_MS} FROM segments)
SELECT 'label_empty' AS rule, count(*) FILTER (coalesce(trim(label), '') = '') AS n FROM p UNION ALL SELECT 'start_unreadable', count(*) FILTER (s IS NULL) FROM p UNION ALL SELECT 'end_unreadable', count(*) FILTER (e IS NULL) FROM p
UNION ALL SELECT 'end_not_after_start', count(*) FILTER (e <= s) FROM p UNION ALL SELECT 'label_unresolved', count(*) FILTER (upper(label) LIKE '%UNRESOLVED%' OR upper(label) LIKE '%UNKNOWN%') FROM p
UNION ALL SELECT 'repeated', count(*) - count(DISTINCT (coalesce(session_id, ''), coalesce(start, ''), coalesce("end", ''), coalesce(label, ''))) FROM p
UNION ALL SELECT 'label_explosion', (count(DISTINCT label) >= greatest(10, floor(0.5 * count(*))))::BIGINT FROM p""")
def segment_violations(spark, d):
    p = table(spark, d, "segments").withColumn("s", parse_ms(F.col("start"))).withColumn("e", parse_ms(F.col("end")))
    up = F.upper("label")
    row = F.struct(*[F.coalesce(c, F.lit("")) for c in ("session_id", "start", "end", "label")])
    c = p.agg(
        F.count_if(F.coalesce(F.trim("label"), F.lit("")) == "").alias("a"), F.count_if(F.col("s").isNull()).alias("b"), F.count_if(F.col("e").isNull()).alias("c"), F.count_if(F.col("e") <= F.col("s")).alias("d"),
        F.count_if(up.contains("UNRESOLVED") | up.contains("UNKNOWN")).alias("e"), (F.count("*") - F.count_distinct(row)).alias("f"), (F.count_distinct("label") >= F.greatest(F.lit(10), F.floor(F.count("*") * 0.5))).cast("long").alias("g"),
    )
    return c.selectExpr("stack(7, 'label_empty', a, 'start_unreadable', b, 'end_unreadable', c, 'end_not_after_start', d, 'label_unresolved', e, 'repeated', f, 'label_explosion', g) AS (rule, n)")


_ISL = """mk AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY session_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM segs),
gr AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM mk), isl AS (SELECT session_id, g, min(s) AS s, max(e) AS e FROM gr GROUP BY 1, 2)"""


def islands(spark, d):
    return interval_periods(segs(spark, d), "session_id", F.col("s"), F.col("e")).filter("kind = 'period'").select("session_id", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))


@query("union_duration", f"WITH {SEGS}, {_ISL} SELECT session_id, count(*) AS n_periods, sum(e - s)::BIGINT AS union_ms FROM isl GROUP BY 1")
def union_duration(spark, d):
    return islands(spark, d).groupBy("session_id").agg(F.count("*").alias("n_periods"), F.sum(F.col("e") - F.col("s")).alias("union_ms"))


@query("intersection_duration", f"WITH {PRED}, {SEGS}, {_ISL} SELECT p.session_id, sum(least(pe, e) - greatest(ps, s))::BIGINT AS shared_ms FROM preds p JOIN isl i ON p.session_id = i.session_id AND ps <= e AND s <= pe GROUP BY 1")
def intersection_duration(spark, d):
    p = preds(spark, d).withColumnsRenamed({"ps": "a_s", "pe": "a_e"})
    j = I.overlap_join(p, islands(spark, d).withColumnsRenamed({"s": "b_s", "e": "b_e"}), "session_id", ["pred"], [])
    return j.groupBy("session_id").agg(F.sum(F.least("a_e", "b_e") - F.greatest("a_s", "b_s")).alias("shared_ms"))


_PG = """pgj AS (SELECT p.session_id, p.pred, g.seg, ps, pe, s, e FROM preds p JOIN segs g ON p.session_id = g.session_id AND ps < e AND s < pe)"""


def pred_gt(spark, d):
    p = preds(spark, d).withColumnsRenamed({"ps": "a_s", "pe": "a_e"})
    return I.overlap_join(p, segs(spark, d).withColumnsRenamed({"s": "b_s", "e": "b_e"}), "session_id", ["pred"], ["seg"]).filter("a_s < b_e and b_s < a_e")


@query("fragmentation", f"""WITH {PRED}, {SEGS}, {_PG}, a AS (SELECT session_id, seg, count(*) AS n FROM pgj GROUP BY 1, 2), b AS (SELECT session_id, pred, count(*) AS n FROM pgj GROUP BY 1, 2)
SELECT 'gt_split' AS measure, count(*) FILTER (n >= 2) AS n, max(n) AS most FROM a UNION ALL SELECT 'pred_merged', count(*) FILTER (n >= 2), max(n) FROM b""")
def fragmentation(spark, d):
    j = pred_gt(spark, d)
    side = lambda k, name: j.groupBy("session_id", k).agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") >= 2).alias("n"), F.max("c").alias("most")).select(F.lit(name).alias("measure"), "n", "most")
    return side("seg", "gt_split").unionByName(side("pred", "pred_merged"))


@query("iou_summary", f"""WITH {PRED}, {SEGS}, {_PG}, i AS (SELECT session_id, seg, max((least(pe, e) - greatest(ps, s)) / (greatest(pe, e) - least(ps, s))) AS iou FROM pgj GROUP BY 1, 2)
SELECT count(*) AS n, round(avg(iou), 6) AS mean_iou, round(median(iou), 6) AS median_iou, round(quantile_cont(iou, 0.25), 6) AS p25, round(quantile_cont(iou, 0.75), 6) AS p75, count(*) FILTER (iou >= 0.25) AS ge25, count(*) FILTER (iou >= 0.5) AS ge50, count(*) FILTER (iou >= 0.75) AS ge75 FROM i""")
def iou_summary(spark, d):
    best = I.greedy_iou(pred_gt(spark, d).withColumn("g", F.struct("session_id", "seg")), "pred", "g").groupBy("g").agg(F.max("iou").alias("iou"))
    q = lambda x: F.round(F.percentile("iou", F.lit(x)), 6)
    return best.agg(F.count("*").alias("n"), F.round(F.avg("iou"), 6).alias("mean_iou"), q(0.5).alias("median_iou"), q(0.25).alias("p25"), q(0.75).alias("p75"), *[F.count_if(F.col("iou") >= x).alias(f"ge{int(x * 100)}") for x in (0.25, 0.5, 0.75)])


def boundary_points(spark, d):
    p, g = preds(spark, d), segs(spark, d)
    side = lambda df, s, a, b: df.select(F.col("session_id").alias("entity"), F.lit(s).alias("side"), F.explode(F.array(a, b)).alias("t"))
    return side(p, "p", "ps", "pe").unionByName(side(g, "g", "s", "e"))


@query("boundary_union", f"""WITH {PRED}, {SEGS} SELECT DISTINCT session_id, t FROM (SELECT session_id, ps AS t FROM preds UNION ALL SELECT session_id, pe FROM preds UNION ALL SELECT session_id, s FROM segs UNION ALL SELECT session_id, e FROM segs)""")
def boundary_union(spark, d):
    return boundary_points(spark, d).select(F.col("entity").alias("session_id"), "t").distinct()


_TP = """
b AS (SELECT session_id AS entity, t, side FROM (SELECT DISTINCT session_id, t, 'p' AS side FROM (SELECT session_id, ps AS t FROM preds UNION ALL SELECT session_id, pe FROM preds) UNION ALL SELECT DISTINCT session_id, t, 'g' FROM (SELECT session_id, s AS t FROM segs UNION ALL SELECT session_id, e FROM segs))),
l AS (SELECT entity, list(t ORDER BY t) FILTER (side = 'p') AS p, list(t ORDER BY t) FILTER (side = 'g') AS g FROM b GROUP BY 1),
walk(entity, p, g, i, j, tp) AS (SELECT entity, coalesce(p, []), coalesce(g, []), 1, 1, 0 FROM l UNION ALL
 SELECT entity, p, g, CASE WHEN abs(p[i] - g[j]) <= 2000 OR p[i] < g[j] THEN i + 1 ELSE i END, CASE WHEN abs(p[i] - g[j]) <= 2000 OR p[i] >= g[j] THEN j + 1 ELSE j END, tp + (abs(p[i] - g[j]) <= 2000)::INT FROM walk WHERE i <= len(p) AND j <= len(g)),
m AS (SELECT entity, max(tp) AS tp, any_value(len(p)) AS n_pred, any_value(len(g)) AS n_gt FROM walk GROUP BY 1)"""


@query("boundary_match", f"""WITH RECURSIVE {PRED}, {SEGS}, {_TP} SELECT entity, tp::BIGINT AS tp, n_pred::BIGINT AS n_pred, n_gt::BIGINT AS n_gt FROM m""")
def boundary_match(spark, d):
    return I.match_boundaries(boundary_points(spark, d), 2000, "two_pointer")


@query("boundary_metrics", f"""WITH RECURSIVE {PRED}, {SEGS}, {_TP}, t AS (SELECT sum(tp) AS tp, sum(n_pred) AS np, sum(n_gt) AS ng FROM m) SELECT tp::BIGINT AS tp, (np - tp)::BIGINT AS fp, (ng - tp)::BIGINT AS fn, round(tp / np, 6) AS precision, round(tp / ng, 6) AS recall, round(2 * tp / (np + ng), 6) AS f1 FROM t""")
def boundary_metrics(spark, d):
    """Micro average over sessions; a session on one side only counts as false positives or negatives."""
    t = I.match_boundaries(boundary_points(spark, d), 2000, "two_pointer").agg(F.sum("tp").alias("tp"), F.sum("n_pred").alias("np"), F.sum("n_gt").alias("ng"))
    return t.select("tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("ng") - F.col("tp")).alias("fn"), *I.precision_recall(F.col("tp"), F.col("np"), F.col("ng")))


@query("boundary_nearest")
def boundary_nearest(spark, d):
    return I.match_boundaries(boundary_points(spark, d), 5000, "nearest")


@query("run_merge")
def run_merge(spark, d):
    p = S.gap_sessions(table(spark, d, "activities"), "session_id", "start", "activity_id", 15)
    w = Window.partitionBy("entity").orderBy("run_no")
    runs = p.select(F.col("session_id").alias("entity"), F.col("session_no").alias("run_no"), "start_us", "end_us")
    from opweave.plans.sequence import sequence

    x, w = sequence(runs.withColumn("time", F.timestamp_micros("start_us")), "entity", "time", "run_no")
    gap = (F.col("start_us") - F.lag("end_us").over(w)) / 1e6
    x = x.withColumn("p_left", F.round(1 / (1 + gap / 60), 6)).filter("own").select("entity", "run_no", "start_us", "end_us", "p_left")
    return I.merge_short_runs(x, 12)
