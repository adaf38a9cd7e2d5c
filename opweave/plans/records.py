"""Driver queries of problems 3 and 4."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from opweave.operators.interval_periods import interval_periods, parse_ms
from opweave.plans.catalogue import query
from opweave.session import table
from opweave.sources.raw_records import bad_records, good_records

_SEG_MS = """
WITH parsed AS (
  SELECT session_id, epoch_ms(try_cast(trim(start) AS TIMESTAMPTZ)) AS s, epoch_ms(try_cast(trim("end") AS TIMESTAMPTZ)) AS e FROM segments),
good AS (SELECT DISTINCT * FROM parsed WHERE e > s),
marked AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY session_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM good),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM marked),
periods AS (SELECT session_id, g, min(s) AS s, max(e) AS e FROM grouped GROUP BY ALL),
gaps AS (SELECT session_id, lag(e) OVER (PARTITION BY session_id ORDER BY s) AS s, s AS e FROM periods)
"""


@query(
    "p3_found",
    _SEG_MS
    + """SELECT session_id, 'period' AS kind, s AS start_ms, e AS end_ms FROM periods
UNION ALL SELECT session_id, 'gap', s, e FROM gaps WHERE s IS NOT NULL AND e - s < 8 * 3600000""",
)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return interval_periods(table(spark, d, "segments"), "session_id", parse_ms(F.col("start")), parse_ms(F.col("end")))


_F = r"""(?:[ \t\r\n\f\v]*"(?:[^"]|"")*"[ \t\r\n\f\v]*|[^",]*)"""
_NUM = "[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
_BARE = r"""regexp_replace(regexp_replace({c}, '^[ \t\r\n\f\v]+|[ \t\r\n\f\v]+$', '', 'g'), '^"((?s:.*))"$', '\\1')""".replace("\\\\1", "\\1")
_P4_SQL = f"""WITH r AS (SELECT DISTINCT source_file, source_row, coalesce(raw_line, '') AS raw FROM expense_records),
q AS (SELECT *, regexp_full_match(raw, '{_F}(?:,{_F})*') AS quoted FROM r), f AS (SELECT *, CASE WHEN quoted THEN regexp_extract_all(',' || raw, ',({_F})', 1) END AS f FROM q),
v AS (SELECT *, CASE WHEN len(f) = 17 THEN trim({_BARE.format(c="f[11]")}) END AS qty, CASE WHEN len(f) = 17 THEN trim({_BARE.format(c="f[12]")}) END AS amt, CASE WHEN len(f) = 17 THEN trim({_BARE.format(c="f[4]")}) END AS d FROM f),
n AS (SELECT *, CASE WHEN regexp_full_match(qty, '{_NUM}') THEN try_cast(qty AS DOUBLE) END AS x, CASE WHEN regexp_full_match(amt, '{_NUM}') THEN try_cast(amt AS DOUBLE) END AS y,
 CASE WHEN regexp_full_match(d, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') THEN try_strptime(d, '%Y-%m-%d') WHEN regexp_full_match(d, '[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}') THEN try_strptime(d, '%Y/%m/%d') WHEN regexp_full_match(d, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') THEN try_strptime(d, '%d/%m/%Y')
  WHEN regexp_full_match(d, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[Tt ]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9]([.,][0-9]+)?)?([Zz]|[+-]([01][0-9]|2[0-3])(:?[0-5][0-9])?)?') THEN try_strptime(left(d, 10), '%Y-%m-%d') END AS day FROM v)
SELECT source_file, source_row, 'quoting' AS reason FROM n WHERE NOT quoted UNION ALL SELECT source_file, source_row, 'column_count' FROM n WHERE quoted AND len(f) <> 17
UNION ALL SELECT source_file, source_row, 'quantity' FROM n WHERE quoted AND len(f) = 17 AND NOT coalesce(x > 0 AND isfinite(x), false) UNION ALL SELECT source_file, source_row, 'unit_amount' FROM n WHERE quoted AND len(f) = 17 AND NOT coalesce(y >= 0 AND isfinite(y), false)
UNION ALL SELECT source_file, source_row, 'expense_date' FROM n WHERE quoted AND len(f) = 17 AND day IS NULL"""


@query("p4_found", _P4_SQL)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return bad_records(table(spark, d, "expense_records")).select("source_file", "source_row", "reason")


@query("p4_good")
def p4_good(spark: SparkSession, d: str) -> DataFrame:
    return good_records(table(spark, d, "expense_records"))
