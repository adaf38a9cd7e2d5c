"""Driver queries that complete the catalogue: grids, ceilings, blocks, explicit entities, unlinked pairs."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from opweave.operators import intervals as I, sequences as S, vectors as V
from opweave.operators.interval_periods import parse_ms
from opweave.plans.catalogue import query
from opweave.plans.interval_queries import PRED, SEGS, _MS, preds, segs
from opweave.plans.session_queries import ACTS, SEQ, _CAND, acts, candidates
from opweave.plans.text_queries import _clean, _clean_sql
from opweave.plans.vector_queries import _SCORED, _TFIDF, scored_pairs
from opweave.plans.workflow_queries import _CT, _EV, _OWNED, contingency, gap_groups, owned
from opweave.session import micros, table


@query("session_bounds_text", f"""WITH p AS (SELECT session_id, start, "end", {_MS} FROM segments), v AS (SELECT * FROM p WHERE s IS NOT NULL AND e IS NOT NULL)
SELECT session_id, arg_min(start, (s, start)) AS first_text, arg_max("end", (e, "end")) AS last_text FROM v GROUP BY 1 HAVING max(e) > min(s)""")
def session_bounds_text(spark, d):
    """First start and last end by time, returned as written."""
    x = table(spark, d, "segments").withColumn("s", parse_ms(F.col("start"))).withColumn("e", parse_ms(F.col("end"))).dropna(subset=["s", "e"])
    g = x.groupBy("session_id").agg(F.min_by("start", F.struct("s", "start")).alias("first_text"), F.max_by("end", F.struct("e", "end")).alias("last_text"), F.min("s").alias("a"), F.max("e").alias("b"))
    return g.filter("b > a").select("session_id", "first_text", "last_text")


_EXPLICIT = f"""SELECT DISTINCT activity_id, coalesce(nullif(k, ''), 'UNSPECIFIED') AS type, v AS value FROM (SELECT activity_id, coalesce({_clean_sql("e.type")}, '') AS k, {_clean_sql("e.value")} AS v FROM (SELECT activity_id, unnest(entities) AS e FROM acts))
 WHERE v <> '' AND NOT (lower(k) IN ('', 'id', 'identifier') AND regexp_matches(v, '^(act_|evt_|event_)'))"""


@query("explicit_entities", f"WITH {ACTS} {_EXPLICIT}")
def explicit_entities(spark, d):
    """Entities an activity names, with their kind; ids of activities and events under no kind are provenance, not entities."""
    e = acts(spark, d).select("activity_id", F.explode("entities").alias("e")).select("activity_id", F.coalesce(_clean("e.type"), F.lit("")).alias("k"), _clean("e.value").alias("value"))
    e = e.filter((F.col("value") != "") & ~(F.lower("k").isin("", "id", "identifier") & F.col("value").rlike("^(act_|evt_|event_)")))
    return e.select("activity_id", F.coalesce(F.nullif("k", F.lit("")), F.lit("UNSPECIFIED")).alias("type"), "value").distinct()


@query("unlinked_pairs", f"""{_EV}, {_CAND}, same AS (SELECT sum(n * (n - 1) / 2)::BIGINT AS n FROM (SELECT session_id, p, sum(n) AS n FROM ct GROUP BY 1, 2)),
lk AS (SELECT count(*) AS n FROM cand c JOIN owned oa ON c.a = oa.activity_id JOIN owned ob ON c.b = ob.activity_id JOIN pg pa ON c.a = pa.activity_id JOIN pg pb ON c.b = pb.activity_id WHERE pa.pred = pb.pred)
SELECT same.n AS group_pairs, lk.n AS linked, same.n - lk.n AS no_relation FROM same, lk""")
def unlinked_pairs(spark, d):
    """Pairs of one group without any edge, counted by subtraction: no pair is formed that has none."""
    ct = contingency(spark, d).groupBy("session_id", "p").agg(F.sum("n").alias("n")).agg(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")).alias("group_pairs")).withColumn("k", F.lit(1))
    g = owned(spark, d).select("activity_id").join(gap_groups(spark, d), F.col("activity_id") == F.col("pa")).select("activity_id", "pred")
    side = lambda p: g.select(*[F.col(c).alias(p + c) for c in g.columns])
    e = candidates(spark, d).join(side("x_"), F.col("a") == F.col("x_activity_id")).join(side("y_"), F.col("b") == F.col("y_activity_id")).filter("x_pred = y_pred")
    return ct.join(e.agg(F.count("*").alias("linked")).withColumn("k", F.lit(1)), "k").select("group_pairs", "linked", (F.col("group_pairs") - F.col("linked")).alias("no_relation"))


@query("grid_choice", f"""WITH {_SCORED}, t AS (SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.5]) AS threshold), m AS (SELECT threshold, round(2 * count(*) FILTER (score >= threshold AND same) / (count(*) FILTER (score >= threshold) + count(*) FILTER (same)), 6) AS f1 FROM sc, t GROUP BY 1)
SELECT threshold::DOUBLE AS threshold, f1 FROM m ORDER BY f1 DESC, threshold LIMIT 1""")
def grid_choice(spark, d):
    """Best threshold of the grid; the first wins ties."""
    from opweave.plans.vector_queries import threshold_grid

    return threshold_grid(spark, d).select("threshold", "f1").orderBy(F.desc("f1"), "threshold").limit(1)


@query("oracle_ceiling", f"""WITH {SEQ}, {SEGS}, {_OWNED}, b AS (SELECT session_id, pos, seg, lag(seg) OVER (PARTITION BY session_id ORDER BY pos) AS q FROM (SELECT s.session_id, s.pos, o.seg FROM seq s LEFT JOIN owned o USING (activity_id)))
SELECT session_id, count(*) FILTER (pos > 0 AND q IS DISTINCT FROM seg) AS n_cuts FROM b GROUP BY 1""")
def oracle_ceiling(spark, d):
    """Cuts that ideal link probabilities, taken from the true segments, would make."""
    from opweave.plans.sequence import sequence

    o = owned(spark, d).select(F.col("activity_id").alias("oa"), "seg")
    a = acts(spark, d).select("session_id", "start", "activity_id")
    x = a.join(o, F.col("activity_id") == F.col("oa"), "left").drop("oa")
    y, w = sequence(x, "session_id", "start", "activity_id")
    y = y.withColumn("q", F.lag("seg").over(w)).filter("own")
    return y.groupBy("session_id").agg(F.count_if((F.col("pos") > 0) & ~F.col("q").eqNullSafe(F.col("seg"))).alias("n_cuts"))


_BLOCK = """{p}tf AS (SELECT doc, term, count(*) AS tf FROM {p}terms GROUP BY ALL), {p}nd AS (SELECT count(DISTINCT doc) AS n FROM {p}tf), {p}df AS (SELECT term, count(*) AS df FROM {p}tf GROUP BY 1),
{p}w AS (SELECT doc, {p}tf.term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM {p}tf JOIN {p}df USING (term), {p}nd WHERE df >= 2 AND df <= 0.7 * n), {p}n AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM {p}w GROUP BY 1), {p}v AS (SELECT doc, '{p}' || term AS term, w / norm AS weight FROM {p}w JOIN {p}n USING (doc))"""


@query("block_vectors", f"""WITH names AS (SELECT DISTINCT lower(display_name) AS doc FROM partners WHERE display_name IS NOT NULL), wterms AS (SELECT doc, unnest(regexp_extract_all(doc, '[a-z]+')) AS term FROM names), cterms AS (SELECT doc, doc[i:i+2] AS term FROM names, (SELECT unnest(range(1, 200)) AS i) WHERE i + 2 <= len(doc)),
{_BLOCK.format(p='w')}, {_BLOCK.format(p='c')}, b AS (SELECT doc, term, 0.7 * weight AS x FROM wv UNION ALL SELECT doc, term, 0.3 * weight FROM cv), n AS (SELECT doc, sqrt(sum(x * x)) AS n FROM b GROUP BY 1) SELECT doc, term, round(x / n, 6) AS weight FROM b JOIN n USING (doc)""")
def block_vectors(spark, d):
    """Weighted word and character blocks, brought to unit length together."""
    n = table(spark, d, "partners").filter("display_name is not null").select(F.lower("display_name").alias("doc")).distinct()
    block = lambda terms, p, w: V.tfidf(n.select("doc", F.explode(terms).alias("term")), "doc", "term").select("doc", F.concat(F.lit(p), "term").alias("term"), (w * F.col("weight")).alias("x"))
    b = block(F.regexp_extract_all("doc", F.lit("([a-z]+)"), F.lit(1)), "w", 0.7).unionByName(block(V.char_ngrams(F.col("doc"), 3, 3), "c", 0.3))
    norm = b.groupBy(F.col("doc").alias("nd")).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return b.join(norm, F.col("doc") == F.col("nd")).select("doc", "term", F.round(F.col("x") / F.col("n"), 6).alias("weight"))


@query("switch_sequence", f"""WITH {SEQ}, f AS (SELECT session_id, pos, 0 AS k, app AS v FROM seq WHERE app IS NOT NULL UNION ALL SELECT session_id, pos, 1, 'browser:' || browser_tab FROM seq WHERE browser_tab <> ''),
l AS (SELECT session_id, v, lag(v) OVER (PARTITION BY session_id ORDER BY pos, k) AS q FROM f) SELECT session_id, count(*) FILTER (q <> v) AS n_switches FROM l GROUP BY 1""")
def switch_sequence(spark, d):
    """Changes over the flattened [app, browser:tab] sequence: an activity with both already counts one."""
    tab = F.when(F.col("browser_tab") != "", F.concat(F.lit("browser:"), "browser_tab"))
    a = acts(spark, d).select("session_id", "start", "activity_id", F.posexplode(F.array_compact(F.array("app", tab))).alias("k", "v"))
    return S.switches(a.withColumn("key", F.concat_ws(":", "activity_id", "k")), "session_id", "start", "key", "v")


@query("relative_rates", f"""WITH {PRED}, {SEGS}, a AS (SELECT session_id, count(*) AS n FROM preds GROUP BY 1), b AS (SELECT session_id, count(*) AS n FROM segs GROUP BY 1)
SELECT count(*) AS n_sessions, round(sum(a.n) / sum(b.n), 6) AS segment_ratio, round(quantile_cont(a.n / b.n, 0.5), 6) AS median_ratio FROM a JOIN b USING (session_id)""")
def relative_rates(spark, d):
    """Predicted segments for each true one."""
    n = lambda df, c: df.groupBy("session_id").agg(F.count("*").alias(c))
    x = n(preds(spark, d), "a").join(n(segs(spark, d), "b"), "session_id")
    return x.agg(F.count("*").alias("n_sessions"), F.round(F.sum("a") / F.sum("b"), 6).alias("segment_ratio"), F.round(F.median(F.col("a") / F.col("b")), 6).alias("median_ratio"))
