"""Driver queries on terms, vectors, clusters and scores."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from opweave.functions import text as T
from opweave.operators import sequences as S, vectors as V
from opweave.plans.catalogue import query
from opweave.plans.interval_queries import SEGS, _J
from opweave.plans.session_queries import ACTS, SEQ, acts
from opweave.plans.workflow_queries import _OWNED, owned, variants
from opweave.session import cut, table

_TFIDF = """tf AS (SELECT doc, term, count(*) AS tf FROM terms GROUP BY ALL), nd AS (SELECT count(DISTINCT doc) AS n FROM tf), dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
wq AS (SELECT doc, tf.term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN dfq USING (term), nd WHERE df >= 2 AND df <= {max_df} * n), nq AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM wq GROUP BY 1)"""


@query("tfidf_char", """WITH names AS (SELECT DISTINCT lower(display_name) AS doc FROM partners WHERE display_name IS NOT NULL), terms AS (SELECT doc, doc[i:i+n-1] AS term FROM names, (SELECT unnest(range(2, 7)) AS n) l, (SELECT unnest(range(1, 200)) AS i) p WHERE i + n - 1 <= len(doc)), """
       + _TFIDF.format(max_df=0.7) + " SELECT doc, term, round(w / norm, 6) AS weight FROM wq JOIN nq USING (doc)")
def tfidf_char(spark, d):
    n = table(spark, d, "partners").filter("display_name is not null").select(F.lower("display_name").alias("doc")).distinct()
    t = V.tfidf(n.select("doc", F.explode(V.char_ngrams(F.col("doc"), 2, 6)).alias("term")), "doc", "term")
    return t.withColumn("weight", F.round("weight", 6))


@query("tfidf_words", """WITH terms AS (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents), """
       + _TFIDF.format(max_df=0.7) + """, r AS (SELECT doc, term, round(w / norm, 6) AS weight, row_number() OVER (PARTITION BY doc ORDER BY round(w / norm, 6) DESC, term) AS k FROM wq JOIN nq USING (doc)) SELECT doc, term, weight, k FROM r WHERE k <= 5""")
def tfidf_words(spark, d):
    """The five heaviest words of each document."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1))).alias("term"))
    t = V.tfidf(t, "doc", "term").withColumn("weight", F.round("weight", 6))
    k = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("weight"), "term")).cast("long")
    return t.withColumn("k", k).filter("k <= 5")


@query("semantic_documents", f"""WITH {ACTS}, {SEGS}, {_OWNED}, x AS (SELECT o.session_id, o.seg, o.start, o.activity_id, b_s, b_e, concat_ws(' ', repeat('WIN:' || lower(a."window") || ' ', 4), repeat('TARGET:' || lower(a.target_field) || ' ', 3), 'TYPE:' || a.type) AS t FROM owned o JOIN acts a USING (activity_id)),
y AS (SELECT session_id, seg, string_agg(t, ' ' ORDER BY start, activity_id) AS doc, any_value(b_e - b_s) AS ms FROM x GROUP BY 1, 2) SELECT session_id, seg, md5(doc || ' DUR:' || CASE WHEN ms < 15000 THEN 'SHORT' WHEN ms < 45000 THEN 'MEDIUM' ELSE 'LONG' END) AS doc FROM y""")
def semantic_documents(spark, d):
    """Channel-weighted text of a segment: window four times, target three times, type, duration class."""
    from opweave.operators.intervals import own
    from opweave.plans.interval_queries import act_seg

    o = own(act_seg(spark, d, "type", "window", "target_field", "start"), "activity_id", "seg", "previous")
    t = F.concat_ws(" ", F.repeat(F.concat(F.lit("WIN:"), F.lower("window"), F.lit(" ")), F.lit(4)), F.repeat(F.concat(F.lit("TARGET:"), F.lower("target_field"), F.lit(" ")), F.lit(3)), F.concat(F.lit("TYPE:"), F.col("type")))
    g = o.withColumn("t", t).groupBy("session_id", "seg").agg(F.array_sort(F.collect_list(F.struct("start", "activity_id", "t"))).alias("x"), F.min(F.col("b_e") - F.col("b_s")).alias("ms"))
    dur = F.when(F.col("ms") < 15000, "SHORT").when(F.col("ms") < 45000, "MEDIUM").otherwise("LONG")
    return g.select("session_id", "seg", F.md5(F.concat(F.array_join("x.t", " "), F.lit(" DUR:"), dur)).alias("doc"))


@query("segment_documents")
def segment_documents(spark, d):
    """Semantic document of a segment: window four times, target three times, text twice, clipped screen text once, the pairs of consecutive types, duration class."""
    from opweave.operators.intervals import own
    from opweave.plans.interval_queries import act_seg

    o = own(act_seg(spark, d), "activity_id", "seg", "previous").select(F.col("activity_id").alias("oid"), "seg")
    # the long texts join the owners last: they pass two shuffles, not those of the overlap join
    a = acts(spark, d).select("session_id", "activity_id", "start_us", F.coalesce("end_us", "start_us").alias("end_us"), F.coalesce(F.nullif("type", F.lit("")), F.lit("UNKNOWN")).alias("type"), "window", "target_field", "text", "screen_text")
    o = a.join(o, F.col("activity_id") == F.col("oid")).withColumns({c: T.semantic_text(F.col(c)) for c in ("window", "target_field", "text", "screen_text")}).withColumn("screen_text", T.clip(F.col("screen_text")))
    part = lambda tag, c, n: F.when(c != "", F.array_repeat(F.concat(F.lit(tag + "::"), c), n)).otherwise(F.array().cast("array<string>"))
    g = o.groupBy("session_id", "seg").agg(F.array_sort(F.collect_list(F.struct("start_us", "end_us", "activity_id", "type", "window", "target_field", "text", "screen_text"))).alias("x"))
    parts = F.transform("x", lambda a: F.concat(part("WIN", a["window"], 4), part("TARGET", a["target_field"], 3), part("TEXT", a["text"], 2), part("SCREEN", a["screen_text"], 1)))
    types = F.col("x.type")
    pairs = F.transform(F.slice(types, 2, F.size("x")), lambda t, i: F.concat(F.lit("ACTIONPAIR::"), types[i], F.lit(">"), t))
    s = (F.element_at("x", -1)["end_us"] - F.col("x")[0]["start_us"]) / 1e6
    dur = F.when(s < 15, "DUR::SHORT").when(s < 45, "DUR::MEDIUM").otherwise("DUR::LONG")
    return g.select("session_id", "seg", F.md5(F.array_join(F.concat(F.flatten(parts), pairs, F.array(dur)), " ")).alias("doc"))


_E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL)"


@query("cosine_knn", f"""WITH {_E}, p AS (SELECT q.vec_id AS query, r.vec_id AS neighbour, round(list_cosine_similarity(q.v, r.v), 6) AS similarity FROM e q JOIN e r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS rn FROM p) SELECT query, neighbour, round(similarity, 5) AS similarity FROM k WHERE rn <= 3""")
def cosine_knn(spark, d):
    e = table(spark, d, "embeddings")
    return V.cosine_knn(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 3).withColumn("similarity", F.round("similarity", 5))


@query("nearest_class", f"""WITH {_E}, p AS (SELECT q.vec_id AS query, q.label AS own, r.label AS near, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, r.v), 6) DESC, r.vec_id) AS rn FROM e q JOIN e r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0)
SELECT own, near, count(*) AS n FROM p WHERE rn = 1 GROUP BY 1, 2""")
def nearest_class(spark, d):
    """Leave-one-out nearest neighbour: own and found class."""
    e = table(spark, d, "embeddings")
    k = V.cosine_knn(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 1)
    a, b = e.select(F.col("vec_id").alias("qi"), F.col("label").alias("own")), e.select(F.col("vec_id").alias("ri"), F.col("label").alias("near"))
    return k.join(a, F.col("query") == F.col("qi")).join(b, F.col("neighbour") == F.col("ri")).groupBy("own", "near").agg(F.count("*").alias("n"))


_SIL = f"""WITH {_E}, u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM e),
c AS (SELECT label, count(*) AS n FROM u GROUP BY 1), s AS (SELECT label, i, sum(u[i]) AS x FROM u, (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM e))) AS i) GROUP BY 1, 2), t AS (SELECT label, list(x ORDER BY i) AS t FROM s GROUP BY 1),
d AS (SELECT u.vec_id, u.label, t.label AS cl, CASE WHEN u.label = t.label THEN CASE WHEN n > 1 THEN 1 - (list_dot_product(u.u, t.t) - 1) / (n - 1) END ELSE 1 - list_dot_product(u.u, t.t) / n END AS d FROM u, t JOIN c ON c.label = t.label),
ab AS (SELECT vec_id, label, max(d) FILTER (label = cl) AS a, min(d) FILTER (label <> cl) AS b FROM d GROUP BY 1, 2)"""


@query("silhouette", f"{_SIL} SELECT label, count(*) AS n, round(avg(coalesce((b - a) / greatest(a, b), 0)), 5) AS silhouette FROM ab GROUP BY 1")
def silhouette(spark, d):
    u = V.unit_vectors(table(spark, d, "embeddings"), "vec_id", "embedding", "label")
    s = V.silhouette(u, "vec_id", "label").withColumnRenamed("vec_id", "k")
    return u.join(s, F.col("vec_id") == F.col("k")).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("silhouette"), 5).alias("silhouette"))


@query("similarity_margin", f"""WITH {_E}, p AS (SELECT a.label = b.label AS same, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.vec_id < b.vec_id) SELECT round(avg(s) FILTER (same), 5) AS mean_same, round(avg(s) FILTER (NOT same), 5) AS mean_other, round(avg(s) FILTER (same) - avg(s) FILTER (NOT same), 5) AS margin FROM p""")
def similarity_margin(spark, d):
    """Exact means over all pairs, from class sums: |sum|^2 holds every pair twice and each vector with itself."""
    c = V.class_sums(V.unit_vectors(table(spark, d, "embeddings"), "vec_id", "embedding", "label"), "label")
    own = c.agg(F.sum((V.dot("total", "total") - F.col("n")) / 2).alias("s"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("m"), F.sum("n").alias("n")).withColumn("k", F.lit(1))
    all_ = c.select(F.posexplode("total").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias("t")).withColumn("k", F.lit(1))
    x = own.join(all_, "k")
    same = F.col("s") / F.col("m")
    other = ((F.col("t") - F.col("n")) / 2 - F.col("s")) / (F.col("n") * (F.col("n") - 1) / 2 - F.col("m"))
    return x.select(F.round(same, 5).alias("mean_same"), F.round(other, 5).alias("mean_other"), F.round(same - other, 5).alias("margin"))


@query("seq_edit_distance", f"""WITH {ACTS}, {SEGS}, {_OWNED}, sg AS (SELECT session_id, seg, any_value(label) AS label, list(type ORDER BY start, activity_id) AS ts FROM owned GROUP BY 1, 2), c AS (SELECT label, ts, count(*) AS n FROM sg GROUP BY 1, 2),
ids AS (SELECT type, row_number() OVER (ORDER BY type) + 64 AS cp FROM (SELECT DISTINCT type FROM owned)), m AS (SELECT map_from_entries(list((type, chr(cp::INT)))) AS m FROM ids), w AS (SELECT label, array_to_string(ts, '>') AS variant, array_to_string(list_transform(ts, lambda t: m[t]), '') AS code, n FROM c, m),
dom AS (SELECT label, arg_max(code, (n, code)) AS dom FROM w GROUP BY 1) SELECT label, variant, round(levenshtein(code, dom) / greatest(len(code), len(dom)), 6) AS distance FROM w JOIN dom USING (label)""")
def seq_edit_distance(spark, d):
    """Normalised edit distance of each variant to its workflow's dominant one; every step is mapped to one character."""
    v = variants(spark, d).groupBy("label", "types").agg(F.count("*").alias("n"))
    ids = [r[0] for r in acts(spark, d).select("type").distinct().orderBy("type").limit(6001).collect()]
    if len(ids) > 6000:
        raise ValueError("more than 6000 step types: map them to numbers first")
    m = F.create_map(*[F.lit(x) for i, t in enumerate(ids) for x in (t, chr(65 + i) if len(ids) < 60000 else "")])
    v = v.withColumn("code", F.array_join(F.transform("types", lambda t: m[t]), ""))
    dom = v.groupBy(F.col("label").alias("dl")).agg(F.max_by("code", F.struct("n", "code")).alias("dom"))
    x = v.join(dom, F.col("label") == F.col("dl"))
    return x.select("label", F.array_join("types", ">").alias("variant"), F.round(F.levenshtein("code", "dom") / F.greatest(F.length("code"), F.length("dom")), 6).alias("distance"))


def label_profiles(spark, d) -> tuple[list[str], V.Profiles]:
    """Type and app profile of each workflow label, in the labels' order: a row for each term of a label goes to the driver."""
    terms = F.explode(F.array(F.col("type"), F.coalesce("app", F.lit("-")))).alias("term")
    n = owned(spark, d).select("label", terms).groupBy("label", "term").agg(F.count("*").alias("n")).toPandas()
    at, names = pd.factorize(n["label"], sort=True)
    term, kinds = pd.factorize(n["term"].fillna("\0"), sort=True)
    m = np.zeros((len(names), len(kinds)), np.int64)
    np.add.at(m, (at, term), n["n"].to_numpy(np.int64))
    return list(names), V.Profiles(m)


THRESHOLDS = [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6]


@query("avg_linkage")
def avg_linkage(spark, d):
    """Workflow labels clustered at distance 0.15, stably numbered."""
    names, p = label_profiles(spark, d)
    lab = V.cut_tree(V.cosine_linkage(p.unit, p.weight), len(p.weight), 0.15)[p.of]
    return spark.createDataFrame([(n, int(c)) for n, c in zip(names, lab)], "label string, cluster int")


@query("threshold_sweep")
def threshold_sweep(spark, d):
    s = V.cosine_sweep(label_profiles(spark, d)[1], THRESHOLDS)
    rows = [tuple(r) for r in s.astype(object).itertuples(index=False)]
    return spark.createDataFrame(rows, "threshold double, k bigint, silhouette double, singleton_share double, stability double, score double, eligible boolean")


@query("threshold_choice")
def threshold_choice(spark, d):
    """The eligible threshold with the best score; the first wins ties, 0.55 if none is eligible."""
    s = V.cosine_sweep(label_profiles(spark, d)[1], THRESHOLDS)
    s = s[s["eligible"].astype(bool) & (s["singleton_share"] <= 0.55)]
    best = float(s.loc[s["score"].idxmax(), "threshold"]) if len(s) else 0.55
    return spark.createDataFrame([(best,)], "threshold double")


_SCORED = f"""{SEQ}, {SEGS}, {_OWNED}, pr AS (SELECT activity_id, lag(activity_id) OVER w AS prev, round(1 / (1 + greatest((start_us - lag(coalesce(end_us, start_us)) OVER w) / 1e6, 0)), 3) AS score FROM seq WINDOW w AS (PARTITION BY session_id ORDER BY pos)),
sc AS (SELECT score, x.seg = y.seg AS same FROM pr JOIN owned x ON pr.activity_id = x.activity_id JOIN owned y ON pr.prev = y.activity_id)"""


def scored_pairs(spark, d) -> DataFrame:
    """Consecutive activities that both have a segment: features, score by gap, and whether the segment is the same."""
    p = S.pair_features(S.consecutive_pairs(S.pair_columns(acts(spark, d)), "session_id", "start", "activity_id", S.PAIR_COLS))
    gap = F.greatest((F.col("start_us") - F.coalesce("prev_end_us", "prev_start_us")) / 1e6, F.lit(0.0))
    p = p.select("session_id", "activity_id", "prev_activity_id", gap.alias("gap_s"), *S.PAIR_FEATURES)
    o = owned(spark, d).select("activity_id", "seg")
    x = p.join(o.select(F.col("activity_id").alias("oa"), F.col("seg").alias("s1")), F.col("activity_id") == F.col("oa"))
    x = x.join(o.select(F.col("activity_id").alias("ob"), F.col("seg").alias("s2")), F.col("prev_activity_id") == F.col("ob"))
    return x.withColumn("same", (F.col("s1") == F.col("s2")).cast("int")).withColumn("score", F.round(1 / (1 + F.col("gap_s")), 3))


@query("discrimination", f"""WITH {_SCORED}, g AS (SELECT score, count(*) AS n, sum(same::INT) AS p FROM sc GROUP BY 1), r AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS seen, sum(p) OVER () AS tot, sum(n) OVER () AS cnt FROM g)
SELECT max(cnt)::BIGINT AS n, max(tot)::BIGINT AS n_pos, round(sum((n - p) * (tp - p / 2)) / (max(tot) * (max(cnt) - max(tot))), 6) AS roc_auc, round(sum(p / tot * tp / seen), 6) AS average_precision FROM r""")
def discrimination(spark, d):
    return V.ranking_metrics(scored_pairs(spark, d), "score", "same")


@query("threshold_grid", f"""WITH {_SCORED}, t AS (SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.5]) AS threshold), m AS (SELECT threshold, count(*) FILTER (score >= threshold AND same) AS tp, count(*) FILTER (score >= threshold) AS pp, count(*) FILTER (same) AS gp FROM sc, t GROUP BY 1)
SELECT threshold::DOUBLE AS threshold, tp, round(tp / pp, 6) AS precision, round(tp / gp, 6) AS recall, round(2 * tp / (pp + gp), 6) AS f1 FROM m""")
def threshold_grid(spark, d):
    """Precision, recall and F1 for each threshold in one pass."""
    x = scored_pairs(spark, d).withColumn("threshold", F.explode(F.array(*map(F.lit, (0.05, 0.1, 0.2, 0.3, 0.5)))))
    hit = F.col("score") >= F.col("threshold")
    m = x.groupBy("threshold").agg(F.count_if(hit & (F.col("same") == 1)).alias("tp"), F.count_if(hit).alias("pp"), F.count_if(F.col("same") == 1).alias("gp"))
    from opweave.operators.intervals import precision_recall

    return m.select("threshold", "tp", *precision_recall(F.col("tp"), F.col("pp"), F.col("gp")))


def session_split(df: DataFrame, seed: int = 42, share: float = 0.2) -> DataFrame:
    """Adds held_out: whole sessions go to one side, by a seeded hash; exact copies of a session share a fingerprint and stay together."""
    f = df.groupBy("session_id").agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_set("activity_type_pair")), F.count("*").cast("string"), F.round(F.sum("gap_s"), 3).cast("string")), 256).alias("print"))
    f = f.select(F.col("session_id").alias("fs"), (F.pmod(F.xxhash64(F.lit(seed), "print"), F.lit(1000)) < share * 1000).alias("held_out"))
    return df.join(f, F.col("session_id") == F.col("fs")).drop("fs")


def boundary_model():
    """Pipeline: median imputation, standardisation, one-hot type pair, balanced logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler

    num, flags = S.PAIR_FEATURES[:9], S.PAIR_FEATURES[9:17]
    return Pipeline(
        stages=[
            Imputer(strategy="median", inputCols=num, outputCols=[f"{c}_i" for c in num]), VectorAssembler(inputCols=[f"{c}_i" for c in num], outputCol="num"), StandardScaler(withMean=True, inputCol="num", outputCol="scaled"),
            StringIndexer(inputCol="activity_type_pair", outputCol="pair_i", handleInvalid="keep"), OneHotEncoder(inputCol="pair_i", outputCol="pair_v"),
            VectorAssembler(inputCols=["scaled", *flags, "pair_v"], outputCol="features"), LogisticRegression(labelCol="same", weightCol="weight", regParam=0.001, maxIter=100),
        ]
    )


@query("boundary_model")
def boundary_model_metrics(spark, d):
    """Fits on 80 % of the sessions, scores the rest."""
    from pyspark.ml.functions import vector_to_array

    x = session_split(scored_pairs(spark, d)).withColumn("weight", F.lit(1.0))
    x = cut(x)  # read three times
    pos, n = x.filter("not held_out").agg(F.sum("same"), F.count("*")).first()
    if not n or not pos or pos == n:
        return spark.createDataFrame([], "n long, n_pos long, roc_auc double, average_precision double")
    train = x.filter("not held_out").withColumn("weight", F.when(F.col("same") == 1, F.lit(n / (2 * pos))).otherwise(F.lit(n / (2 * (n - pos)))))
    scored = boundary_model().fit(train).transform(x.filter("held_out")).withColumn("p", F.round(vector_to_array("probability")[1], 6))
    return V.ranking_metrics(scored, "p", "same")
