"""Driver queries on scalar functions and entities."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opweave.functions import text as T
from opweave.operators import sequences as S
from opweave.plans.catalogue import query
from opweave.plans.session_queries import ACTS, SEQ, WS, _ENTS, _fold, acts
from opweave.session import table

_URL, _MAIL, _ID = T.TYPED[0][1], T.TYPED[1][1], T.ENTITY[0][1]


def _docs(spark, d):
    return table(spark, d, "documents")


def _nest(sql: str, steps) -> str:
    for pat, tag in steps:
        sql = f"regexp_replace({sql}, '{pat}', '{tag}', 'g')"
    return sql


@query("mask_dynamic", f"SELECT doc_id, md5({_nest('text', [(p, '<DYN>') for p in T.DYNAMIC])}) AS masked FROM documents")
def mask_dynamic(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.mask_dynamic(F.col("text"))).alias("masked"))


@query("mask_typed", f"SELECT doc_id, md5({_nest('text', [(p, t) for t, p in T.TYPED])}) AS masked FROM documents")
def mask_typed(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.mask_typed(F.col("text"))).alias("masked"))


_ENT = (
    f"""e AS (SELECT doc_id, 'ID' AS type, unnest(regexp_extract_all(text, '{_ID}')) AS value FROM documents UNION SELECT doc_id, 'EMAIL', unnest(regexp_extract_all(text, '{_MAIL}')) FROM documents
 UNION SELECT doc_id, 'FILENAME', unnest(regexp_extract_all(text, '{T.ENTITY[2][1]}')) FROM documents UNION SELECT doc_id, 'URL', u FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_URL}')) AS u FROM documents) WHERE NOT regexp_matches(lower(u), '^[a-z]+://(www[.])?(localhost|127[.]|10[.]|192[.]168[.])')
 UNION SELECT doc_id, 'NUMBER', unnest(regexp_extract_all(regexp_replace(regexp_replace(text, '{_URL}', ' ', 'g'), '{_ID}', ' ', 'g'), '[0-9]{{4,}}')) FROM documents)"""
)


@query("entity_extract", f"WITH {_ENT} SELECT doc_id, type, value FROM e")
def entity_extract(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(T.entities(F.col("text"))).alias("e")).select("doc_id", "e.type", "e.value")


@query("entity_counts", f"WITH {_ENT} SELECT type, count(*) AS n, count(DISTINCT value) AS n_distinct, count(DISTINCT doc_id) AS n_docs FROM e GROUP BY 1")
def entity_counts(spark, d):
    e = entity_extract(spark, d)
    return e.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_distinct"), F.count_distinct("doc_id").alias("n_docs"))


@query("linkable_entities", f"WITH {ACTS}, x AS (SELECT activity_id, unnest({_ENTS}) AS e FROM acts) SELECT activity_id, split_part(e, chr(31), 1) AS type, split_part(e, chr(31), 2) AS value FROM x")
def linkable_entities(spark, d):
    """Entities that may link activities: eight types of objects, and URLs with more than a host."""
    e = acts(spark, d).select("activity_id", F.explode(T.linkable(F.col("entities"))).alias("e"))
    return e.select("activity_id", F.split_part("e", F.lit("\x1f"), F.lit(1)).alias("type"), F.split_part("e", F.lit("\x1f"), F.lit(2)).alias("value"))


@query("collapse_text", f"SELECT doc_id, md5({_fold('text')}) AS h FROM documents")
def collapse_text(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.collapse(F.col("text"))).alias("h"))


@query("collapse_documents", f"SELECT doc_id, md5({_fold('text')}) AS h FROM documents")
def collapse_documents(spark, d):
    return collapse_text(spark, d)


@query("nfkc_casefold")
def nfkc_casefold(spark, d):
    return acts(spark, d).select("activity_id", T.nfkc_casefold(F.col("window")).alias("folded"))


@query("header_slugs", "SELECT DISTINCT title, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM contracts WHERE title IS NOT NULL")
def header_slugs(spark, d):
    return table(spark, d, "contracts").filter("title is not null").select("title", T.slug(F.col("title")).alias("slug")).distinct()


@query("url_hosts", """WITH h AS (SELECT nullif(regexp_replace(regexp_extract(lower(browser_url), '^[a-z]+://([^/:?#]+)', 1), '^www[.]', ''), '') AS host FROM activities WHERE browser_url IS NOT NULL)
SELECT host, coalesce(regexp_matches(host, '^(localhost|127[.]|10[.]|192[.]168[.])'), false) AS private, count(*) AS n FROM h GROUP BY 1, 2""")
def url_hosts(spark, d):
    u = table(spark, d, "activities").filter("browser_url is not null")
    return u.groupBy(T.url_host(F.col("browser_url")).alias("host"), T.is_private(F.col("browser_url")).alias("private")).agg(F.count("*").alias("n"))


@query("contained_text", f"""WITH {SEQ}, p AS (SELECT activity_id, lower(text) AS a, lag(lower(text)) OVER (PARTITION BY session_id ORDER BY pos) AS b, pos FROM seq)
SELECT activity_id FROM p WHERE pos > 0 AND len(a) >= 4 AND len(b) >= 4 AND (contains(a, b) OR contains(b, a))""")
def contained_text(spark, d):
    p = S.consecutive_pairs(acts(spark, d), "session_id", "start", "activity_id", ["text"])
    return p.filter(T.contains_either(F.lower("text"), F.lower("prev_text"))).select("activity_id")


@query("clip_and_shorten", "SELECT doc_id, md5(CASE WHEN len(text) > 2000 THEN left(text, 1700) || ' ' || right(text, 300) ELSE text END) AS clipped, CASE WHEN len(text) > 60 THEN left(text, 57) || '...' ELSE text END AS short FROM documents")
def clip_and_shorten(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.clip(F.col("text"))).alias("clipped"), T.shorten(F.col("text"), 60).alias("short"))


_TEXT_FIELDS = ("text", "screen_text", "window", "browser_tab", "target_field")


def _clean_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}', ' ', 'g'))"


def _clean(c: str) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


@query("text_evidence", f"""WITH {ACTS}, e AS (SELECT activity_id, {", ".join(_clean_sql(chr(34) + c + chr(34)) + f" AS f{i}" for i, c in enumerate(_TEXT_FIELDS))} FROM acts)
SELECT activity_id, concat_ws(' ', {", ".join(f"CASE WHEN f{i} <> '' THEN '{c}=' || CASE WHEN len(f{i}) > 420 THEN left(f{i}, 417) || '...' ELSE f{i} END END" for i, c in enumerate(_TEXT_FIELDS))}) AS evidence FROM e""")
def text_evidence(spark, d):
    """field=value of the text fields that are not empty, white space collapsed, each clipped to 420 characters by itself."""
    parts = [F.when(_clean(c) != "", F.concat(F.lit(f"{c}="), T.shorten(_clean(c), 420))) for c in _TEXT_FIELDS]
    return acts(spark, d).select("activity_id", F.concat_ws(" ", *parts).alias("evidence"))


@query("stable_ids", "SELECT contract_id, upper(left(sha256(concat_ws('|', contract_id, partner_id, coalesce(title, ''))), 16)) AS id FROM contracts")
def stable_ids(spark, d):
    return table(spark, d, "contracts").select("contract_id", T.stable_id(F.col("contract_id"), F.col("partner_id"), F.coalesce("title", F.lit(""))).alias("id"))


@query("canonical_json", """SELECT contract_id, '{"currency":' || coalesce('"' || currency || '"', 'null') || ',"open_obligations":' || coalesce(open_obligations::VARCHAR, 'null') || ',"partner_id":' || coalesce('"' || partner_id || '"', 'null') || '}' AS doc FROM contracts""")
def canonical_json(spark, d):
    """Fields sorted by name, nulls kept: equal rows give equal text."""
    names = sorted(["partner_id", "currency", "open_obligations"])
    return table(spark, d, "contracts").select("contract_id", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("doc"))


@query("system_unassigned", f"WITH {ACTS} SELECT activity_id FROM acts WHERE type = 'OTHER' AND app IS NULL AND \"window\" IS NULL")
def system_unassigned(spark, d):
    return acts(spark, d).filter("type = 'OTHER' and app is null and window is null").select("activity_id")


@query("missing_fields", f"""WITH {ACTS} SELECT activity_id, array_to_string(list_filter([CASE WHEN coalesce(app, '') = '' THEN 'app' END, CASE WHEN coalesce("window", '') = '' THEN 'window' END, CASE WHEN coalesce(text, '') = '' THEN 'text' END, CASE WHEN "end" IS NULL THEN 'end' END], lambda x: x IS NOT NULL), ',') AS missing FROM acts""")
def missing_fields(spark, d):
    miss = F.filter(F.array(*[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(c)) for c in ("app", "window", "text", "end")]), lambda x: x.isNotNull())
    return acts(spark, d).select("activity_id", F.array_join(miss, ",").alias("missing"))


@query("events_display", "SELECT event_id, strftime(ts, '%H:%M:%S') AS at, event_type, left(props, 20) AS props FROM events")
def events_display(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "HH:mm:ss").alias("at"), "event_type", F.left("props", F.lit(20)).alias("props"))


@query("timeline", f"""WITH {ACTS}, m AS (SELECT session_id, min(start_us) AS t0 FROM acts GROUP BY 1), x AS (SELECT *, (start_us - t0) // 1000000 AS s FROM acts JOIN m USING (session_id))
SELECT activity_id, s::BIGINT AS rel_s, CASE WHEN s >= 360000 THEN (s // 3600)::VARCHAR ELSE lpad((s // 3600)::VARCHAR, 2, '0') END || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS elapsed FROM x WHERE s IS NOT NULL""")
def timeline(spark, d):
    """Relative seconds and elapsed text (hours of at least two digits) of each activity in its session."""
    a = acts(spark, d).select("session_id", "activity_id", "start_us")
    t0 = a.groupBy(F.col("session_id").alias("ts")).agg(F.min("start_us").alias("t0"))
    s = F.floor((F.col("start_us") - F.col("t0")) / 1_000_000).cast("long")
    two = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    x = a.join(t0, F.col("session_id") == F.col("ts")).withColumn("rel_s", s).filter("rel_s is not null")
    c = F.col("rel_s")
    hours = F.floor(c / 3600).cast("long").cast("string")
    return x.select("activity_id", "rel_s", F.concat(F.when(F.length(hours) >= 2, hours).otherwise(F.lpad(hours, 2, "0")), F.lit(":"), two(F.floor(c % 3600 / 60)), F.lit(":"), two(c % 60)).alias("elapsed"))
