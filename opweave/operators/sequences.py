"""Pairs, runs, switches, n-grams and sessions over ordered activities."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opweave.functions import text as T
from opweave.plans.positions import with_positions
from opweave.plans.sequence import chunked, island_ids, sequence
from opweave.session import micros


def gap_sessions(df: DataFrame, entity: str, time: str, key: str, gap_s: float) -> DataFrame:
    """Inactivity sessions: a new one starts after more than ``gap_s`` seconds; (entity, session_no, start_us, end_us, n)."""
    x, w = sequence(df.select(entity, time, key, micros(time).alias("us")), entity, time, key)
    x = x.withColumn("prev", F.lag("us").over(w)).filter("own")
    new = F.col("prev").isNull() | (F.col("us") - F.col("prev") > gap_s * 1e6)
    x = island_ids(x.select(entity, "pos", "us", "prev", "chunk"), entity, new, "session_no")
    return x.groupBy(entity, "session_no").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("n"))


def consecutive_pairs(df: DataFrame, entity: str, time: str, key: str, cols: list[str]) -> DataFrame:
    """Each activity beside the one before it: pos, <col> and prev_<col>; first of an entity left out."""
    x, w = sequence(df.select(entity, time, key, *cols), entity, time, key)
    names = [key, *cols]
    for c in names:
        x = x.withColumn(f"prev_{c}", F.lag(c).over(w))
    return x.filter("own and pos > 0").select(entity, "pos", *names, *[f"prev_{c}" for c in names])


# fixed values: entity types that the boundary model counts
PAIR_ENTITIES = ("INVOICE_ID", "EMPLOYEE_ID", "CASE_ID", "DOCUMENT_ID", "CUSTOMER_ID", "ID_CANDIDATE", "EMAIL", "ORDER_ID", "PO_ID", "TRANSACTION_ID", "BANK_ID")


def pair_columns(df: DataFrame) -> DataFrame:
    """What ``pair_features`` compares, prepared once for each activity: folded texts, host, entity keys and types, links."""
    none = F.array().cast("array<string>")
    kind = lambda e: F.upper(T.collapse(e["type"]))
    ents = F.filter("entities", lambda e: F.coalesce(kind(e).isin(*PAIR_ENTITIES), F.lit(False)))
    keys = F.filter(ents, lambda e: F.coalesce(T.collapse(e["value"]) != "", F.lit(False)))
    host = F.split_part(F.split_part(F.regexp_replace(T.collapse(F.col("browser_url")), "^[a-z]+://", ""), F.lit("/"), F.lit(1)), F.lit(":"), F.lit(1))
    return df.withColumns(
        {
            **{f"f_{c}": F.coalesce(T.collapse(F.col(c)), F.lit("")) for c in ("app", "window", "browser_tab", "type", "text", "screen_text")},
            "f_host": F.coalesce(host, F.lit("")),
            "f_keys": F.coalesce(F.array_distinct(F.transform(keys, lambda e: F.concat(kind(e), F.lit(":"), T.collapse(e["value"])))), none),
            "f_types": F.coalesce(F.array_distinct(F.transform(ents, kind)), none),
            "f_links": F.coalesce(F.array_distinct(F.filter("triggered_by", lambda x: x != "")), none),
        }
    )


PAIR_COLS = ["start_us", "end_us", "f_app", "f_window", "f_browser_tab", "f_type", "f_text", "f_screen_text", "f_host", "f_keys", "f_types", "f_links"]


def pair_features(pairs: DataFrame) -> DataFrame:
    """The 9 numeric, 8 binary and one categorical features of consecutive activities (``pair_columns`` with PAIR_COLS).

    An end that is missing is the start; an empty value equals nothing but an empty type; durations count at least 1 ms."""
    c, p = F.col, lambda x: F.col(f"prev_{x}")
    a0, b0 = p("start_us") / 1e6, c("start_us") / 1e6
    a1, b1 = F.coalesce(p("end_us"), p("start_us")) / 1e6, F.coalesce(c("end_us"), c("start_us")) / 1e6
    least = F.lit(0.001)
    ad, bd = F.greatest(a1 - a0, least), F.greatest(b1 - b0, least)
    both = lambda x: F.size(F.array_intersect(c(x), p(x))).cast("double")
    same = lambda x: ((c(x) != "") & (c(x) == p(x))).cast("int")
    return pairs.withColumns(
        {
            "log_gap_seconds": F.round(F.log1p(F.greatest(b0 - a1, F.lit(0.0))), 6),
            "overlap_ratio": F.round(F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0)) / F.least(ad, bd), 6),
            "duration_ratio_log": F.round(F.log(F.greatest(ad, bd) / F.least(ad, bd)), 6),
            "shared_entity_count": both("f_keys"), "shared_entity_type_count": both("f_types"),
            "text_similarity": F.round(char_bigram_jaccard(p("f_text"), c("f_text")), 6), "screen_similarity": F.round(char_bigram_jaccard(p("f_screen_text"), c("f_screen_text")), 6),
            "entity_a_count": F.size(p("f_keys")).cast("double"), "entity_b_count": F.size(c("f_keys")).cast("double"),
            "same_app": same("f_app"), "same_window": same("f_window"), "same_browser_tab": same("f_browser_tab"), "same_browser_domain": same("f_host"),
            "same_activity_type": (c("f_type") == p("f_type")).cast("int"), "triggered_by": (both("f_links") > 0).cast("int"), "has_shared_entity": (both("f_keys") > 0).cast("int"),
            "a_before_b": (a0 <= b0).cast("int"), "activity_type_pair": F.concat(p("f_type"), F.lit("|"), c("f_type")),
        }
    )


PAIR_FEATURES = [
    "log_gap_seconds", "overlap_ratio", "duration_ratio_log", "shared_entity_count", "shared_entity_type_count", "text_similarity", "screen_similarity", "entity_a_count", "entity_b_count",
    "same_app", "same_window", "same_browser_tab", "same_browser_domain", "same_activity_type", "triggered_by", "has_shared_entity", "a_before_b", "activity_type_pair",
]


def char_bigram_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of character bigrams: 0 if either is empty, 1 if equal, 0 if one has no bigram.  Linear in the texts' length."""

    def grams(c: Column) -> Column:
        ch = F.regexp_extract_all(c, F.lit("(?s)(.)"), F.lit(1))
        return F.array_distinct(F.zip_with(F.slice(ch, 1, F.greatest(F.size(ch) - 1, F.lit(0))), F.slice(ch, 2, F.greatest(F.size(ch) - 1, F.lit(0))), lambda x, y: F.concat(x, y)))

    either = F.coalesce(a, F.lit("")) == ""
    other = F.coalesce(b, F.lit("")) == ""
    shared = F.size(F.array_intersect(grams(a), grams(b)))
    sim = shared / (F.size(grams(a)) + F.size(grams(b)) - shared)
    return F.when(either | other, 0.0).when(a == b, 1.0).when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(sim)


def switches(df: DataFrame, entity: str, time: str, key: str, value: str) -> DataFrame:
    """(entity, n_switches): changes of a non-null value between consecutive rows that have one."""
    x, w = sequence(df.filter(F.col(value).isNotNull()).select(entity, time, key, value), entity, time, key)
    x = x.withColumn("p", F.lag(value).over(w)).filter("own")
    return x.groupBy(entity).agg(F.count_if(F.col("p") != F.col(value)).alias("n_switches"))


def runs(df: DataFrame, entity: str, time: str, key: str, value: str) -> DataFrame:
    """Maximal runs of equal values: (entity, run_no, value, n); null is a value of its own."""
    x, w = sequence(df.select(entity, time, key, value), entity, time, key)
    x = x.withColumn("p", F.lag(value).over(w)).filter("own")
    new = (F.col("pos") == 0) | ~F.col("p").eqNullSafe(F.col(value))
    x = island_ids(x, entity, new, "run_no")
    return x.groupBy(entity, "run_no").agg(F.min(value).alias(value), F.count("*").alias("n"))


def ngrams(df: DataFrame, entity: str, time: str, key: str, value: str, n: int) -> DataFrame:
    """(gram, n_occurrences, n_entities) of ``n`` consecutive values joined with '>'."""
    x, w = sequence(df.select(entity, time, key, value), entity, time, key, back=n - 1)
    parts = [F.lag(value, i).over(w) if i else F.col(value) for i in range(n - 1, -1, -1)]
    x = x.withColumn("parts", F.array(*parts)).filter(f"own and pos >= {n - 1}")
    return x.withColumn("gram", F.array_join("parts", ">", "-")).groupBy("gram").agg(F.count("*").alias("n_occurrences"), F.count_distinct(entity).alias("n_entities"))


def gap_bucket(gap_s: Column) -> Column:
    """0..4 by 1, 3, 10 and 30 seconds."""
    return F.when(gap_s <= 1, 0).when(gap_s <= 3, 1).when(gap_s <= 10, 2).when(gap_s <= 30, 3).otherwise(4)


def near_pairs(df: DataFrame, entity: str, time: str, key: str, max_gap_s: float, max_ahead: int) -> DataFrame:
    """Pairs (a, b) with 0 <= start_b - start_a <= max_gap_s, b one of the next ``max_ahead`` rows: linear, no range join."""
    x, w = sequence(df.select(entity, time, key, micros(time).alias("us")), entity, time, key, back=0, ahead=max_ahead)
    nxt = F.collect_list(F.struct(F.col(key).alias("b"), F.col("us").alias("b_us"))).over(w.rowsBetween(1, max_ahead))
    x = x.withColumn("nxt", nxt).filter("own").select(entity, F.col(key).alias("a"), F.col("us").alias("a_us"), F.explode("nxt").alias("n"))
    x = x.withColumn("gap_s", (F.col("n.b_us") - F.col("a_us")) / 1e6).filter(F.col("gap_s") <= max_gap_s)
    return x.select(entity, "a", F.col("n.b").alias("b"), "gap_s")


def canonical(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Undirected pairs with a < b; self pairs dropped."""
    return df.withColumn("__a", F.least(a, b)).withColumn(b, F.greatest(a, b)).withColumn(a, F.col("__a")).drop("__a").filter(F.col(a) < F.col(b))


def shared_key_pairs(df: DataFrame, entity: str, time: str, key: str, value: str, neighbours: int, max_group: int) -> DataFrame:
    """Pairs of rows with an equal key value inside an entity, each with its next ``neighbours`` holders; groups above ``max_group`` are no evidence."""
    g = df.filter(F.col(value).isNotNull()).select(F.concat_ws("\x1f", entity, value).alias("g"), entity, time, key, value).dropDuplicates(["g", key])
    few = g.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n").between(2, max_group)).select(F.col("g").alias("fg"))
    g = g.join(few, F.col("g") == F.col("fg"), "left_semi")
    w = Window.partitionBy("g").orderBy(time, key).rowsBetween(1, neighbours)
    x = g.withColumn("nxt", F.collect_list(key).over(w)).select(entity, value, F.col(key).alias("a"), F.explode("nxt").alias("b"))
    return x


def trigger_pairs(df: DataFrame) -> DataFrame:
    """(session_id, a, b): an activity and the one of its session whose activity_id or source event triggered it."""
    t = df.select("session_id", F.col("activity_id").alias("b"), F.explode("triggered_by").alias("ref")).distinct()
    by_id = df.select(F.col("session_id").alias("ts"), F.col("activity_id").alias("a"), F.col("activity_id").alias("id"))
    by_event = df.select(F.col("session_id").alias("ts"), F.col("activity_id").alias("a"), F.explode("source_event_ids").alias("id"))
    on = (F.col("ref") == F.col("id")) & (F.col("session_id") == F.col("ts"))
    return t.join(by_id.unionByName(by_event).distinct(), on).filter("a <> b").select("session_id", "a", "b").distinct()


# fixed values: weights and bounds in seconds of the evidence between two activities
EDGE_WEIGHTS = {"same_entity": 5, "triggered_by": 5, "same_window": 2, "same_app": 2, "same_browser_tab": 1, "semantic_match": 1, "close_in_time": 1, "large_time_gap": -1}
CLOSE_S, LARGE_GAP_S = 30, 120


def score_edges(pairs: DataFrame, acts: DataFrame) -> DataFrame:
    """Adds gap_s, n_shared, evidence, score and strength to candidate pairs (session_id, a, b, reasons).

    acts: activity_id, start_us, app, window, browser_tab, text, entities.  STRONG needs a shared entity or a
    trigger; else three points are MODERATE.  Each side is joined once."""
    text = lambda c: F.coalesce(T.casefold(F.trim(c)), F.lit(""))
    x = acts.select("activity_id", "start_us", *[text(c).alias(c) for c in ("app", "window", "browser_tab", "text")], T.linkable(F.col("entities")).alias("ents"))
    side = lambda p: x.select(*[F.col(c).alias(p + c) for c in x.columns])
    f = pairs.join(side("x_"), F.col("a") == F.col("x_activity_id")).join(side("y_"), F.col("b") == F.col("y_activity_id"))
    same = lambda c: (F.col(f"x_{c}") != "") & (F.col(f"x_{c}") == F.col(f"y_{c}"))
    f = f.withColumn("gap_s", F.abs(F.col("x_start_us") - F.col("y_start_us")) / 1e6).withColumn("n_shared", F.size(F.array_intersect("x_ents", "y_ents")))
    holds = {
        "same_entity": F.col("n_shared") > 0, "triggered_by": F.col("reasons").contains("triggered_by"), "same_window": same("window"), "same_app": same("app"), "same_browser_tab": same("browser_tab"),
        "semantic_match": T.contains_either(F.col("x_text"), F.col("y_text")), "close_in_time": F.col("gap_s") <= CLOSE_S, "large_time_gap": F.col("gap_s") > LARGE_GAP_S,
    }
    f = f.withColumn("evidence", F.array_join(F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in holds.items()])), ","))
    has = lambda k: F.contains(F.concat(F.lit(","), F.col("evidence"), F.lit(",")), F.lit(f",{k},"))
    f = f.withColumn("score", sum((w * has(k).cast("int") for k, w in EDGE_WEIGHTS.items()), F.lit(0)))
    f = f.withColumn("strength", F.when(has("same_entity") | has("triggered_by"), "STRONG").when(F.col("score") >= 3, "MODERATE").otherwise("WEAK"))
    return f.select("session_id", "a", "b", "reasons", "gap_s", "n_shared", "evidence", "score", "strength")


def boundary_times(df: DataFrame, mode: str = "mid") -> DataFrame:
    """Adds cut_us of a pair: prev_end, curr_start or mid."""
    end = F.coalesce("prev_end_us", "prev_start_us")
    at = {"prev_end": end, "curr_start": F.col("start_us"), "mid": F.floor((end + F.col("start_us")) / 2)}[mode]
    return df.withColumn("cut_us", at.cast("long"))
