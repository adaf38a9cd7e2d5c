"""Driver queries of the llm operators (problems 1, 2, 5 to 9)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from opweave.llm.lookalikes import consistent_form, deviating_fields, fit_lookalikes
from opweave.llm.mixing import mix_shares, mix_sources
from opweave.llm.pii import find_personal, redact_personal
from opweave.llm.runs import collapse_runs, window_key
from opweave.llm.sentences import learn_sentences, sentence_units
from opweave.llm.subsequences import frequent_subsequences, step_name
from opweave.llm.tokens import token_counts, token_ids
from opweave.session import cut, table

P2_SQL = r"""WITH once AS (SELECT DISTINCT session_id, start, activity_id, upper(regexp_replace(type, '^\s+|\s+$', '', 'g')) || '@' || coalesce(lower(regexp_replace(app, '^\s+|\s+$', '', 'g')), '-') AS step FROM activities WHERE session_id IS NOT NULL AND start IS NOT NULL AND activity_id IS NOT NULL),
s AS (SELECT session_id, step, row_number() OVER (PARTITION BY session_id ORDER BY start, activity_id) AS pos FROM once), need AS (SELECT greatest(5, ceil(0.15 * count(DISTINCT session_id))) AS n FROM activities),
common AS (SELECT step FROM s GROUP BY 1 HAVING count(DISTINCT session_id) >= (SELECT n FROM need)), f AS (SELECT s.* FROM s JOIN common USING (step)),
p2 AS (SELECT DISTINCT a.session_id, a.step || ' > ' || b.step AS p, b.pos FROM f a JOIN f b ON a.session_id = b.session_id AND b.pos - a.pos BETWEEN 1 AND 3),
p3 AS (SELECT DISTINCT a.session_id, a.p || ' > ' || b.step AS p, b.pos FROM p2 a JOIN f b ON a.session_id = b.session_id AND b.pos - a.pos BETWEEN 1 AND 3),
p4 AS (SELECT DISTINCT a.session_id, a.p || ' > ' || b.step AS p FROM p3 a JOIN f b ON a.session_id = b.session_id AND b.pos - a.pos BETWEEN 1 AND 3),
u AS (SELECT DISTINCT session_id, p, 3 AS k FROM p3 UNION ALL SELECT session_id, p, 4 FROM p4)
SELECT p AS pattern, k::INTEGER AS n_steps, count(*)::INTEGER AS support FROM u GROUP BY 1, 2 HAVING count(*) >= (SELECT n FROM need)"""

TEXT_FIELDS = ["window", "text", "screen_text"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "activities")
    return find_personal(a, table(spark, d, "staff"), fit_lookalikes(a, ["text", "screen_text"]), "activity_id", ["text", "screen_text"])


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "activities")
    r = redact_personal(a, table(spark, d, "staff"), fit_lookalikes(a, ["text", "screen_text"]), ["text", "screen_text"])
    return r.select("activity_id", "text_safe", "screen_text_safe")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "activities")
    return frequent_subsequences(a, "session_id", step_name("type", "app"), "start", "activity_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "activities")
    return deviating_fields(a, fit_lookalikes(a, TEXT_FIELDS), "activity_id", TEXT_FIELDS)


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "activities")
    r = consistent_form(a, fit_lookalikes(a, TEXT_FIELDS), TEXT_FIELDS)
    return r.select("activity_id", *[f"{c}_form" for c in TEXT_FIELDS])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "activities")
    win = window_key(F.col("window"), fit_lookalikes(a, ["window"]), spark)
    blank = r"(?U)^\s+|\s+$"
    same = F.to_json(F.array(*[F.lower(F.regexp_replace(c, blank, "")) for c in ("type", "app")], win), {"ignoreNullFields": "false"})
    r = collapse_runs(a, "session_id", "start", "end", "activity_id", same, "source_event_ids")
    return r.select(
        F.col("entity").alias("session_id"), F.col("first_key").alias("first_activity_id"), F.col("last_key").alias("last_activity_id"), F.col("n").cast("int").alias("n_activities"), F.col("n_ids").cast("int").alias("n_source_events"), "duration_ms"
    )


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(table(spark, d, "documents"), "doc_id", "text")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    sized = cut(token_counts(table(spark, d, "documents"), ["doc_id", "source"], "text"))
    return mix_sources(sized, table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    sized = cut(token_counts(table(spark, d, "documents"), ["doc_id", "source"], "text"))
    return mix_shares(sized, mix_sources(sized, table(spark, d, "mix_targets")), table(spark, d, "mix_targets"))


P8_SQL = """SELECT source, true AS within_cap, true AS known_documents, true AS met_or_exhausted FROM (SELECT DISTINCT source FROM mix_targets WHERE source IS NOT NULL)
UNION ALL SELECT '(all)', true, true, true"""


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """What the mix must hold, source by source: no document above its cap, every one of its source and once, the share met
    within half a percent or passed, or less than a block of the allowed tokens left; '(all)': shares add up to one."""
    targets = table(spark, d, "mix_targets")
    sized = cut(token_counts(table(spark, d, "documents"), ["doc_id", "source"], "text"))
    mix = cut(mix_sources(sized, targets))
    shares = mix_shares(sized, mix, targets)
    caps = targets.groupBy(F.col("source").alias("cs")).agg(F.max_by("max_repeats", "target_share").alias("cap"))
    seen = sized.select(F.col("doc_id").alias("sd"), F.col("source").alias("ss"), F.col("n_tokens").alias("sn"))
    odd = mix.join(seen, F.col("doc_id") == F.col("sd"), "left").join(caps, F.col("source") == F.col("cs"), "left")
    odd = odd.groupBy(F.col("source").alias("os")).agg(F.count_if(F.col("repeats") > F.col("cap")).alias("above"), F.count_if(~F.col("source").eqNullSafe(F.col("ss")) | ~F.col("n_tokens").eqNullSafe(F.col("sn"))).alias("unknown"), (F.count("*") - F.count_distinct("doc_id")).alias("again"))
    x = shares.join(odd, F.col("source") == F.col("os"), "left").fillna(0, ["above", "unknown", "again"])
    used = F.col("chosen_tokens") + 512 >= 0.995 * F.col("available_tokens") * F.col("max_repeats")  # less than a block is left
    rows = x.select("source", (F.col("above") == 0).alias("within_cap"), (F.col("unknown") + F.col("again") == 0).alias("known_documents"), (F.col("met") | used | (F.col("actual_share") > F.col("target_share"))).alias("met_or_exhausted"))
    total = F.abs(F.sum("actual_share") - 1) < 1e-4
    return rows.unionByName(x.agg(F.lit("(all)").alias("source"), total.alias("within_cap"), total.alias("known_documents"), total.alias("met_or_exhausted")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return sentence_units(docs, "doc_id", "text", "lang", learn_sentences(docs, "text", "lang"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_redacted": p1_redacted, "p2_found": p2_found, "p5_found": p5_found, "p5_forms": p5_forms, "p6_found": p6_found, "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_kept": p8_kept, "p9_found": p9_found}


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL, "p8_kept": P8_SQL}
