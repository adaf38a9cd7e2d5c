"""Driver queries that summarise workflows and evaluate groupings."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from opweave.operators import intervals as I, sequences as S
from opweave.plans.catalogue import query
from opweave.plans.interval_queries import PRED, SEGS, _J, act_seg, preds, pred_gt, segs
from opweave.plans.session_queries import ACTS, SEQ, acts, scored_edges, _CAND
from opweave.session import cut, micros, table

# fixed value: the form of a session id
ACTOR = r"^ses_(\d{8}-\d{6})-(.+)$"
_OWNED = f"""{_J}, owned AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY CASE WHEN point THEN (b_e = a_s)::BIGINT ELSE ov END DESC, seg) AS rn FROM j WHERE point OR ov > 0) WHERE rn = 1)"""


def owned(spark: SparkSession, d: str) -> DataFrame:
    """Activities with their segment (rule 'previous')."""
    return I.own(act_seg(spark, d, "type", "app", "start"), "activity_id", "seg", "previous")


def actor(session: Column) -> Column:
    """Second part of ses_<date>-<actor>, else the whole id."""
    return F.coalesce(F.nullif(F.regexp_extract(session, ACTOR, 2), F.lit("")), session)


@query("actors", r"SELECT DISTINCT session_id, coalesce(nullif(regexp_extract(session_id, '^ses_(\d{8}-\d{6})-(.+)$', 2), ''), session_id) AS actor FROM activities")
def actors(spark, d):
    return table(spark, d, "activities").select("session_id").distinct().select("session_id", actor(F.col("session_id")).alias("actor"))


@query("occurrence_ids", f"""WITH {SEGS} SELECT session_id, seg, label || '_EXEC_' || lpad((row_number() OVER (PARTITION BY label ORDER BY session_id, s, e))::VARCHAR, 4, '0') AS execution FROM segs""")
def occurrence_ids(spark, d):
    """Number of the execution inside its label, counted over sorted blocks so that no label is sorted in one task."""
    x = segs(spark, d).withColumn("block", F.col("session_id"))
    inner = F.row_number().over(Window.partitionBy("label", "block").orderBy("s", "e"))
    sizes = x.groupBy(F.col("label").alias("l"), F.col("block").alias("b")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("l").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("k", inner).join(sizes.select("l", "b", before.alias("off")), (F.col("label") == F.col("l")) & (F.col("block") == F.col("b")))
    no = (F.col("off") + F.col("k")).cast("string")
    return x.select("session_id", "seg", F.concat("label", F.lit("_EXEC_"), F.when(F.length(no) >= 4, no).otherwise(F.lpad(no, 4, "0"))).alias("execution"))


@query("execution_stats", f"""WITH {ACTS}, {SEGS}, {_OWNED}, h AS (SELECT session_id, seg, type, count(*) AS n FROM owned GROUP BY ALL), hh AS (SELECT session_id, seg, string_agg(type || ':' || n, ',' ORDER BY type) AS types FROM h GROUP BY ALL)
SELECT o.session_id, o.seg, any_value(o.label) AS label, count(*) AS n_activities, array_to_string(list_sort(list_distinct(list(app) FILTER (app IS NOT NULL))), ',') AS apps, any_value(types) AS types FROM owned o JOIN hh USING (session_id, seg) GROUP BY 1, 2""")
def execution_stats(spark, d):
    t = owned(spark, d).groupBy("session_id", "seg", "type").agg(F.min("label").alias("label"), F.count("*").alias("n"), F.collect_set("app").alias("apps"))
    hist = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "n"))), lambda s: F.concat(s["type"], F.lit(":"), s["n"].cast("string"))), ",")
    return t.groupBy("session_id", "seg").agg(F.min("label").alias("label"), F.sum("n").alias("n_activities"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("apps")))), ",").alias("apps"), hist.alias("types"))


_VAR = f"""sig AS (SELECT session_id, seg, any_value(label) AS label, string_agg(type, ' > ' ORDER BY start, activity_id) AS variant FROM owned GROUP BY 1, 2)"""


def variants(spark, d):
    return _variants(owned(spark, d))


def _variants(o: DataFrame) -> DataFrame:
    """Step types of each execution, in order."""
    o = o.groupBy("session_id", "seg").agg(F.min("label").alias("label"), F.array_sort(F.collect_list(F.struct("start", "activity_id", "type"))).alias("x"))
    return o.select("session_id", "seg", "label", F.col("x.type").alias("types"))


def compressed(types: Column) -> Column:
    """Runs of equal steps as 'A x3 > B'."""
    n = F.size(types)
    at = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & ((i == 1) | ~F.element_at(types, F.greatest(i - 1, F.lit(1))).eqNullSafe(F.element_at(types, i))))
    ends = F.concat(F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), F.array((n + 1).cast("int")))
    runs = F.zip_with(at, ends, lambda a, b: F.struct(F.element_at(types, a).alias("t"), (b - a).alias("n")))
    return F.array_join(F.transform(runs, lambda r: F.when(r["n"] > 1, F.concat(r["t"], F.lit("x"), r["n"].cast("string"))).otherwise(r["t"])), " > ")


@query("variant_signatures", f"WITH {ACTS}, {SEGS}, {_OWNED}, {_VAR} SELECT variant, count(*) AS n_executions, count(DISTINCT session_id) AS n_sessions FROM sig GROUP BY 1")
def variant_signatures(spark, d):
    v = variants(spark, d).withColumn("variant", F.array_join("types", " > "))
    return v.groupBy("variant").agg(F.count("*").alias("n_executions"), F.count_distinct("session_id").alias("n_sessions"))


@query("compressed_variants", f"""WITH {ACTS}, {SEGS}, {_OWNED}, p AS (SELECT *, lag(type) OVER w AS q, row_number() OVER w AS k FROM owned WINDOW w AS (PARTITION BY session_id, seg ORDER BY start, activity_id)),
r AS (SELECT *, sum(CASE WHEN q IS DISTINCT FROM type THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, seg ORDER BY k ROWS UNBOUNDED PRECEDING) AS g FROM p), c AS (SELECT session_id, seg, g, any_value(type) AS type, count(*) AS n FROM r GROUP BY 1, 2, 3)
SELECT session_id, seg, string_agg(CASE WHEN n > 1 THEN type || 'x' || n ELSE type END, ' > ' ORDER BY g) AS compressed FROM c GROUP BY 1, 2""")
def compressed_variants(spark, d):
    return variants(spark, d).select("session_id", "seg", compressed(F.col("types")).alias("compressed"))


@query("workflow_summary", f"""WITH {ACTS}, {SEGS}, {_OWNED}, {_VAR}, dv AS (SELECT label, max(n) AS top, count(*) AS k FROM (SELECT label, variant, count(*) AS n FROM sig GROUP BY ALL) GROUP BY 1),
ac AS (SELECT label, count(*) AS n, count(DISTINCT app) AS apps FROM owned GROUP BY 1),
w AS (SELECT label, count(*) AS execution_count, count(DISTINCT session_id) AS session_count, count(DISTINCT coalesce(nullif(regexp_extract(session_id, '^ses_(\\d{{8}}-\\d{{6}})-(.+)$', 2), ''), session_id)) AS actor_count, sum(e - s)::BIGINT AS total_ms, quantile_disc(e - s, 0.5) AS median_ms FROM segs GROUP BY 1),
x AS (SELECT label, execution_count, session_count, actor_count, total_ms, median_ms, round(total_ms / execution_count, 3) AS mean_ms, round(total_ms / sum(total_ms) OVER (), 6) AS duration_share, coalesce(ac.n, 0) AS total_activity_count, round(coalesce(ac.n, 0) / execution_count, 2) AS mean_activity_count, coalesce(apps, 0) AS unique_apps,
 coalesce(k, 0) AS unique_variants, coalesce(top, 0) AS dominant_variant_count, round(coalesce(top, 0) / execution_count, 6) AS dominant_variant_share, round(ln(1 + execution_count), 4) AS screening_volume_score, round(ln(1 + total_ms / 1000), 4) AS screening_time_score, round(coalesce(top, 0) / execution_count, 4) AS screening_repeatability_score
 FROM w LEFT JOIN dv USING (label) LEFT JOIN ac USING (label)) SELECT *, row_number() OVER (ORDER BY execution_count DESC, total_ms DESC, dominant_variant_share DESC, label) AS rank FROM x""")
def workflow_summary(spark, d):
    """One row for each workflow: executions, time, activities, variants and the three screening scores, in the order of the four keys."""
    s = segs(spark, d).withColumn("ms", F.col("e") - F.col("s"))
    w = s.groupBy("label").agg(
        F.count("*").alias("execution_count"), F.count_distinct("session_id").alias("session_count"), F.count_distinct(actor(F.col("session_id"))).alias("actor_count"),
        F.sum("ms").alias("total_ms"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY ms)").cast("long").alias("median_ms"),
    )
    o = cut(owned(spark, d).select("session_id", "seg", "label", "app", "type", "start", "activity_id"))
    v = _variants(o).groupBy("label", F.array_join("types", " > ").alias("v")).agg(F.count("*").alias("n"))
    v = v.groupBy(F.col("label").alias("vl")).agg(F.max("n").alias("top"), F.count("*").alias("k"))
    a = o.groupBy(F.col("label").alias("al")).agg(F.count("*").alias("acts"), F.count_distinct("app").alias("apps"))
    x = w.join(v, F.col("label") == F.col("vl"), "left").join(a, F.col("label") == F.col("al"), "left").fillna(0, ["top", "k", "acts", "apps"])
    n = F.col("execution_count")
    # one row per workflow label: the windows below hold label rows, not executions
    total = F.sum("total_ms").over(Window.partitionBy())
    x = x.select(
        "label", "execution_count", "session_count", "actor_count", "total_ms", "median_ms", F.round(F.col("total_ms") / n, 3).alias("mean_ms"), F.round(F.col("total_ms") / total, 6).alias("duration_share"),
        F.col("acts").alias("total_activity_count"), F.round(F.col("acts") / n, 2).alias("mean_activity_count"), F.col("apps").alias("unique_apps"), F.col("k").alias("unique_variants"), F.col("top").alias("dominant_variant_count"), F.round(F.col("top") / n, 6).alias("dominant_variant_share"),
        F.round(F.log1p(n), 4).alias("screening_volume_score"), F.round(F.log1p(F.col("total_ms") / 1000), 4).alias("screening_time_score"), F.round(F.col("top") / n, 4).alias("screening_repeatability_score"),
    )
    return x.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("execution_count"), F.desc("total_ms"), F.desc("dominant_variant_share"), "label")).cast("long"))


@query("top_evidence", f"""WITH {ACTS}, {SEGS}, {_OWNED}, c AS (SELECT label, app, count(*) AS n, min((start, activity_id)) AS first FROM owned WHERE app IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, first) AS k FROM c) SELECT label, app, n, k FROM r WHERE k <= 3""")
def top_evidence(spark, d):
    """Most common apps of a workflow; ties keep the first seen."""
    c = owned(spark, d).filter("app is not null").groupBy("label", "app").agg(F.count("*").alias("n"), F.min(F.struct("start", "activity_id")).alias("first"))
    return c.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "first")).cast("long")).filter("k <= 3").select("label", "app", "n", "k")


@query("representatives", f"""WITH {ACTS}, {SEGS}, {_OWNED}, c AS (SELECT session_id, seg, any_value(label) AS label, count(*) AS n, any_value(b_e - b_s) AS ms, any_value(b_s) AS s FROM owned GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, ms DESC, session_id, s, seg) AS k FROM c) SELECT label, session_id, seg, n, ms, k FROM r WHERE k <= 3""")
def representatives(spark, d):
    c = owned(spark, d).groupBy("session_id", "seg").agg(F.min("label").alias("label"), F.count("*").alias("n"), F.min(F.col("b_e") - F.col("b_s")).alias("ms"), F.min("b_s").alias("s"))
    w = Window.partitionBy("label").orderBy(F.desc("n"), F.desc("ms"), "session_id", "s", "seg")
    return c.withColumn("k", F.row_number().over(w).cast("long")).filter("k <= 3").select("label", "session_id", "seg", "n", "ms", "k")


@query("top_sessions", f"WITH {ACTS} SELECT session_id, count(*) AS n FROM acts GROUP BY 1 ORDER BY n DESC, session_id LIMIT 10")
def top_sessions(spark, d):
    return acts(spark, d).groupBy("session_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "session_id").limit(10)


# -- evaluation of groupings -------------------------------------------------------------------------------------------
# each owned activity: predicted group = its 60 s gap session, true group = its segment's label inside the session

_CT = f"""ct AS (SELECT o.session_id, p.pred AS p, o.seg AS g, count(*) AS n FROM owned o JOIN pg p USING (activity_id) GROUP BY ALL)"""
_EV = f"WITH {PRED}, {SEGS}, {_OWNED}, {_CT}"


def gap_groups(spark, d) -> DataFrame:
    """activity_id -> number of its 60 s gap session."""
    from opweave.plans.sequence import island_ids, sequence

    a = table(spark, d, "activities").select("session_id", "start", "activity_id", micros("start").alias("us"))
    x, w = sequence(a, "session_id", "start", "activity_id")
    x = x.withColumn("p", F.lag("us").over(w)).filter("own")
    return island_ids(x, "session_id", F.col("p").isNull() | (F.col("us") - F.col("p") > 60e6), "pred").select(F.col("activity_id").alias("pa"), "pred")


def contingency(spark, d) -> DataFrame:
    o = owned(spark, d).select("session_id", "activity_id", "seg")
    return o.join(gap_groups(spark, d), F.col("activity_id") == F.col("pa")).groupBy("session_id", F.col("pred").alias("p"), F.col("seg").alias("g")).agg(F.count("*").alias("n"))


def pair_counts(ct: DataFrame, by: list[str]) -> DataFrame:
    """tp, pred_pairs, gt_pairs per ``by`` from a contingency table read once, never materialising pairs."""
    none = F.lit(None).cast("string")
    sets = F.array(*[F.struct(F.lit(k).alias("kind"), p.alias("p"), g.alias("g")) for k, p, g in (("tp", F.col("p").cast("string"), F.col("g").cast("string")), ("pred_pairs", F.col("p").cast("string"), none), ("gt_pairs", none, F.col("g").cast("string")))])
    m = ct.select("session_id", "n", F.explode(sets).alias("s")).groupBy("session_id", "s.kind", "s.p", "s.g").agg(F.sum("n").alias("m"))
    c2 = (F.col("m") * (F.col("m") - 1) / 2).cast("long")
    return m.groupBy(*by).agg(*[F.sum(F.when(F.col("kind") == k, c2)).alias(k) for k in ("tp", "pred_pairs", "gt_pairs")])


_PC = """pc AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM ct) AS tp, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM ct GROUP BY session_id, p)) AS pp, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM ct GROUP BY session_id, g)) AS gp, (SELECT sum(n) FROM ct) AS total)"""


@query("pairwise_f1", f"{_EV}, {_PC} SELECT tp::BIGINT AS tp, pp::BIGINT AS pred_pairs, gp::BIGINT AS gt_pairs, round(tp / pp, 6) AS precision, round(tp / gp, 6) AS recall, round(2 * tp / (pp + gp), 6) AS f1, round(tp / (pp + gp - tp), 6) AS jaccard FROM pc")
def pairwise_f1(spark, d):
    p = pair_counts(contingency(spark, d), [])
    return p.select("tp", "pred_pairs", "gt_pairs", *I.precision_recall(F.col("tp"), F.col("pred_pairs"), F.col("gt_pairs")), F.round(F.try_divide(F.col("tp"), F.col("pred_pairs") + F.col("gt_pairs") - F.col("tp")), 6).alias("jaccard"))


@query("pairwise_by_session", f"""{_EV}, a AS (SELECT session_id, sum(n * (n - 1) / 2) AS tp FROM ct GROUP BY 1), b AS (SELECT session_id, sum(m * (m - 1) / 2) AS pp FROM (SELECT session_id, p, sum(n) AS m FROM ct GROUP BY 1, 2) GROUP BY 1), c AS (SELECT session_id, sum(m * (m - 1) / 2) AS gp FROM (SELECT session_id, g, sum(n) AS m FROM ct GROUP BY 1, 2) GROUP BY 1)
SELECT session_id, tp::BIGINT AS tp, pp::BIGINT AS pred_pairs, gp::BIGINT AS gt_pairs, round(CASE WHEN pp + gp > 0 THEN 2 * tp / (pp + gp) ELSE 0 END, 6) AS f1 FROM a JOIN b USING (session_id) JOIN c USING (session_id)""")
def pairwise_by_session(spark, d):
    p = pair_counts(contingency(spark, d), ["session_id"])
    return p.select("session_id", "tp", "pred_pairs", "gt_pairs", F.round(F.coalesce(F.try_divide(2 * F.col("tp"), F.col("pred_pairs") + F.col("gt_pairs")), F.lit(0.0)), 6).alias("f1"))


@query("session_metrics", f"""{_EV}, a AS (SELECT session_id, sum(n * (n - 1) / 2) AS tp FROM ct GROUP BY 1), b AS (SELECT session_id, sum(m * (m - 1) / 2) AS pp FROM (SELECT session_id, p, sum(n) AS m FROM ct GROUP BY 1, 2) GROUP BY 1), c AS (SELECT session_id, sum(m * (m - 1) / 2) AS gp FROM (SELECT session_id, g, sum(n) AS m FROM ct GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT round(CASE WHEN pp + gp > 0 THEN 2 * tp / (pp + gp) ELSE 0 END, 6) AS f1 FROM a JOIN b USING (session_id) JOIN c USING (session_id))
SELECT count(*) AS n, round(avg(f1), 6) AS mean_f1, round(median(f1), 6) AS median_f1, min(f1) AS min_f1, max(f1) AS max_f1, count(*) FILTER (f1 >= 0.5) AS ge50 FROM f""")
def session_metrics(spark, d):
    f = pairwise_by_session(spark, d)
    return f.agg(F.count("*").alias("n"), F.round(F.avg("f1"), 6).alias("mean_f1"), F.round(F.median("f1"), 6).alias("median_f1"), F.min("f1").alias("min_f1"), F.max("f1").alias("max_f1"), F.count_if(F.col("f1") >= 0.5).alias("ge50"))


@query("rand_index", f"{_EV}, {_PC} SELECT round((tp - pp * gp / (total * (total - 1) / 2)) / (0.5 * (pp + gp) - pp * gp / (total * (total - 1) / 2)), 6) AS adjusted_rand FROM pc")
def rand_index(spark, d):
    ct = contingency(spark, d)
    p = pair_counts(ct, []).withColumn("k", F.lit(1)).join(ct.agg(F.sum("n").alias("total")).withColumn("k", F.lit(1)), "k")
    e = F.col("pred_pairs") * F.col("gt_pairs") / (F.col("total") * (F.col("total") - 1) / 2)
    return p.select(F.round((F.col("tp") - e) / (0.5 * (F.col("pred_pairs") + F.col("gt_pairs")) - e), 6).alias("adjusted_rand"))


@query("purity", f"{_EV}, m AS (SELECT session_id, p, max(n) AS top, sum(n) AS n FROM ct GROUP BY 1, 2) SELECT sum(top)::BIGINT AS majority, sum(n)::BIGINT AS usable, round(sum(top) / sum(n), 6) AS purity FROM m")
def purity(spark, d):
    m = contingency(spark, d).groupBy("session_id", "p").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return m.agg(F.sum("top").alias("majority"), F.sum("n").alias("usable"), F.round(F.sum("top") / F.sum("n"), 6).alias("purity"))


@query("contamination", f"{_EV}, m AS (SELECT session_id, p, max(n) / sum(n) AS pur, sum(n) - max(n) AS strays, sum(n) AS n FROM ct GROUP BY 1, 2) SELECT round(avg(pur), 6) AS mean_purity, round(median(pur), 6) AS median_purity, round(sum(strays) / sum(n), 6) AS stray_share FROM m")
def contamination(spark, d):
    m = contingency(spark, d).groupBy("session_id", "p").agg((F.max("n") / F.sum("n")).alias("pur"), (F.sum("n") - F.max("n")).alias("strays"), F.sum("n").alias("n"))
    return m.agg(F.round(F.avg("pur"), 6).alias("mean_purity"), F.round(F.median("pur"), 6).alias("median_purity"), F.round(F.sum("strays") / F.sum("n"), 6).alias("stray_share"))


@query("cluster_stats", f"WITH {SEGS}, c AS (SELECT label, count(*) AS n FROM segs GROUP BY 1) SELECT count(*) AS k, round(avg((n = 1)::INT), 6) AS singleton_share, round(max(n) / sum(n), 6) AS largest_share FROM c")
def cluster_stats(spark, d):
    c = segs(spark, d).groupBy("label").agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("k"), F.round(F.avg((F.col("n") == 1).cast("int")), 6).alias("singleton_share"), F.round(F.max("n") / F.sum("n"), 6).alias("largest_share"))


@query("cluster_report", f"""WITH {SEGS} SELECT label, count(*) AS size, count(DISTINCT session_id) AS n_sessions, round(median(e - s), 3) AS median_ms, arg_max(session_id, (e - s, -s, session_id)) AS representative FROM segs GROUP BY 1""")
def cluster_report(spark, d):
    ms = F.col("e") - F.col("s")
    return segs(spark, d).groupBy("label").agg(F.count("*").alias("size"), F.count_distinct("session_id").alias("n_sessions"), F.round(F.median(ms), 3).alias("median_ms"), F.max_by("session_id", F.struct(ms, -F.col("s"), F.col("session_id"))).alias("representative"))


@query("stable_relabel", f"""WITH {SEGS}, c AS (SELECT label, min(session_id) AS ms, min(s) AS st, count(*) AS n FROM segs GROUP BY 1) SELECT label, 'WORKFLOW_' || lpad((row_number() OVER (ORDER BY ms, st, n DESC, label))::VARCHAR, 3, '0') AS stable FROM c""")
def stable_relabel(spark, d):
    """Least session and least start are taken independently."""
    c = segs(spark, d).groupBy("label").agg(F.min("session_id").alias("ms"), F.min("s").alias("st"), F.count("*").alias("n"))
    k = F.row_number().over(Window.orderBy("ms", "st", F.desc("n"), "label"))  # one row per label
    return c.select("label", F.concat(F.lit("WORKFLOW_"), F.lpad(k.cast("string"), 3, "0")).alias("stable"))


@query("error_signatures", f"""WITH {PRED}, {SEGS}, {_OWNED}, {_CAND}, e AS (SELECT c.*, oa.seg AS sa, ob.seg AS sb, pa.pred AS pa, pb.pred AS pb FROM cand c JOIN owned oa ON c.a = oa.activity_id JOIN owned ob ON c.b = ob.activity_id JOIN pg pa ON c.a = pa.activity_id JOIN pg pb ON c.b = pb.activity_id)
SELECT CASE WHEN pa = pb AND sa = sb THEN 'TP' WHEN pa = pb THEN 'FP' ELSE 'FN' END AS outcome, reasons AS signature, count(*) AS n FROM e WHERE pa = pb OR sa = sb GROUP BY ALL""")
def error_signatures(spark, d):
    """Evidence behind right and wrong pairs: edge reasons by outcome."""
    g = owned(spark, d).select("activity_id", "seg").join(gap_groups(spark, d), F.col("activity_id") == F.col("pa")).select("activity_id", "seg", "pred")
    side = lambda p: g.select(*[F.col(c).alias(p + c) for c in g.columns])
    from opweave.plans.session_queries import candidates

    e = candidates(spark, d).join(side("x_"), F.col("a") == F.col("x_activity_id")).join(side("y_"), F.col("b") == F.col("y_activity_id"))
    p, s = F.col("x_pred") == F.col("y_pred"), F.col("x_seg") == F.col("y_seg")
    outcome = F.when(p & s, "TP").when(p, "FP").otherwise("FN")
    return e.filter(p | s).groupBy(outcome.alias("outcome"), F.col("reasons").alias("signature")).agg(F.count("*").alias("n"))


@query("session_sets", """WITH a AS (SELECT DISTINCT session_id FROM activities), s AS (SELECT DISTINCT session_id FROM segments)
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM s) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM s)
UNION ALL SELECT 'activities_only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM s) UNION ALL SELECT 'segments_only', count(*) FROM (SELECT * FROM s EXCEPT SELECT * FROM a)""")
def session_sets(spark, d):
    a, s = (table(spark, d, t).select("session_id").distinct() for t in ("activities", "segments"))
    n = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return n(a.union(s).distinct(), "union").unionByName(n(a.intersect(s), "intersect")).unionByName(n(a.subtract(s), "activities_only")).unionByName(n(s.subtract(a), "segments_only"))


@query("session_full_outer", f"""WITH {ACTS}, {SEGS}, a AS (SELECT session_id, count(*) AS n FROM acts GROUP BY 1), s AS (SELECT session_id, count(*) AS n FROM segs GROUP BY 1)
SELECT coalesce(a.session_id, s.session_id) AS session_id, coalesce(a.n, 0) AS n_activities, coalesce(s.n, 0) AS n_segments FROM a FULL JOIN s ON a.session_id = s.session_id""")
def session_full_outer(spark, d):
    a = acts(spark, d).groupBy("session_id").agg(F.count("*").alias("n_activities"))
    s = segs(spark, d).groupBy("session_id").agg(F.count("*").alias("n_segments"))
    return a.join(s, "session_id", "full_outer").fillna(0, ["n_activities", "n_segments"])


@query("coverage_anti", """SELECT DISTINCT doc_id, session_id FROM documents d WHERE session_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM segments s WHERE s.session_id = d.session_id)""")
def coverage_anti(spark, d):
    s = table(spark, d, "segments").select(F.col("session_id").alias("sid"))
    return table(spark, d, "documents").filter("session_id is not null").select("doc_id", "session_id").join(s, F.col("session_id") == F.col("sid"), "left_anti").distinct()
