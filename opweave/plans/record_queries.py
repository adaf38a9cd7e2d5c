"""Driver queries over partners, contracts, expense-like lines and versions."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from opweave.plans.catalogue import query
from opweave.plans.records import _BARE, _NUM, _P4_SQL
from opweave.session import cut, table
from opweave.sources.raw_records import FIELDS, NUMERIC, good_records, parse_records


@query("partner_search", """SELECT partner_id, display_name FROM partners WHERE contains(lower(display_name), 'tools') OR contains(lower(legal_name), 'tools') ORDER BY partner_id LIMIT 20""")
def partner_search(spark, d):
    """Literal, case-insensitive search in a stated order."""
    p = table(spark, d, "partners")
    return p.filter(F.contains(F.lower("display_name"), F.lit("tools")) | F.contains(F.lower("legal_name"), F.lit("tools"))).select("partner_id", "display_name").orderBy("partner_id").limit(20)


_DUP = "SELECT DISTINCT a.partner_id AS a, b.partner_id AS b FROM partners a JOIN partners b ON a.partner_id < b.partner_id AND (lower(a.legal_name) = lower(b.legal_name) OR a.tax_id = b.tax_id OR a.registration_id = b.registration_id)"


@query("partner_duplicates", _DUP)
def partner_duplicates(spark, d):
    """The OR of three keys as three equi-joins: an OR-join would be a nested loop."""
    p = table(spark, d, "partners").withColumn("name", F.lower("legal_name"))
    parts = []
    for k in ("name", "tax_id", "registration_id"):
        a, b = p.select(F.col("partner_id").alias("a"), F.col(k).alias("ka")), p.select(F.col("partner_id").alias("b"), F.col(k).alias("kb"))
        parts.append(a.join(b, (F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b"))).select("a", "b"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


_CON = "con AS (SELECT DISTINCT * FROM contracts)"


@query("partner_profile", f"""WITH {_CON} SELECT p.partner_id, any_value(p.display_name) AS display_name, count(c.contract_id) AS n_contracts, coalesce(array_to_string(list(c.contract_id ORDER BY c.contract_id) FILTER (c.contract_id IS NOT NULL), ','), '') AS contracts, round(coalesce(sum(c.annual_value), 0), 2) AS total_value
FROM partners p LEFT JOIN (SELECT contract_id, partner_id, min(annual_value) AS annual_value FROM con GROUP BY 1, 2) c ON p.partner_id = c.partner_id GROUP BY 1""")
def partner_profile(spark, d):
    c = table(spark, d, "contracts").distinct().groupBy("contract_id", F.col("partner_id").alias("pid")).agg(F.min("annual_value").alias("annual_value"))
    c = c.groupBy("pid").agg(F.count("*").alias("n_contracts"), F.array_join(F.array_sort(F.collect_list("contract_id")), ",").alias("contracts"), F.sum("annual_value").alias("v"))
    p = table(spark, d, "partners").groupBy("partner_id").agg(F.min("display_name").alias("display_name"))
    x = p.join(c, F.col("partner_id") == F.col("pid"), "left")
    return x.select("partner_id", "display_name", F.coalesce("n_contracts", F.lit(0)).alias("n_contracts"), F.coalesce("contracts", F.lit("")).alias("contracts"), F.round(F.coalesce("v", F.lit(0.0)), 2).alias("total_value"))


@query("contract_lookup", f"""WITH {_CON} SELECT c.contract_id, c.partner_id, CASE WHEN c.partner_id IS NULL THEN 'PARTNER_REQUIRED' WHEN p.partner_id IS NULL THEN 'PARTNER_NOT_FOUND' ELSE 'OK' END AS lookup FROM (SELECT DISTINCT contract_id, partner_id FROM con) c LEFT JOIN (SELECT DISTINCT partner_id FROM partners) p USING (partner_id)""")
def contract_lookup(spark, d):
    c = table(spark, d, "contracts").select("contract_id", "partner_id").distinct()
    p = table(spark, d, "partners").select(F.col("partner_id").alias("pid")).distinct()
    x = c.join(p, F.col("partner_id") == F.col("pid"), "left")
    return x.select("contract_id", "partner_id", F.when(F.col("partner_id").isNull(), "PARTNER_REQUIRED").when(F.col("pid").isNull(), "PARTNER_NOT_FOUND").otherwise("OK").alias("lookup"))


@query("latest_version", "SELECT activity_id, max(received_at) AS received_at, count(*) AS n_deliveries FROM activities GROUP BY 1")
def latest_version(spark, d):
    """Latest-wins merge: the last delivery of each id."""
    return table(spark, d, "activities").groupBy("activity_id").agg(F.max("received_at").alias("received_at"), F.count("*").alias("n_deliveries"))


# line items as expense lines: decimal money, half-up rounding at every step
_LINES = """li AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, CAST(l_quantity AS DECIMAL(18,2)) AS q, CAST(l_extendedprice AS DECIMAL(18,2)) AS net, CAST(l_discount AS DECIMAL(6,4)) AS disc, CAST(l_tax AS DECIMAL(6,4)) AS tax FROM lineitem),
amounts AS (SELECT *, CAST(round(net * disc, 2) AS DECIMAL(18,2)) AS discount FROM li), lines AS (SELECT *, CAST(round((net - discount) * tax, 2) AS DECIMAL(18,2)) AS tax_amount FROM amounts), tot AS (SELECT *, net - discount + tax_amount AS total FROM lines)"""


def lines(spark, d) -> DataFrame:
    x = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", F.col("l_quantity").cast("decimal(18,2)").alias("q"), F.col("l_extendedprice").cast("decimal(18,2)").alias("net"), F.col("l_discount").cast("decimal(6,4)").alias("disc"), F.col("l_tax").cast("decimal(6,4)").alias("tax")
    )
    x = x.withColumn("discount", F.round(F.col("net") * F.col("disc"), 2).cast("decimal(18,2)"))
    x = x.withColumn("tax_amount", F.round((F.col("net") - F.col("discount")) * F.col("tax"), 2).cast("decimal(18,2)"))
    return x.withColumn("total", F.col("net") - F.col("discount") + F.col("tax_amount"))


@query("expense_lines", f"WITH {_LINES} SELECT l_orderkey, l_linenumber, count(*) AS n, sum(discount)::DOUBLE AS discount, sum(tax_amount)::DOUBLE AS tax_amount, sum(total)::DOUBLE AS total FROM tot GROUP BY 1, 2")
def expense_lines(spark, d):
    s = lambda c: F.sum(c).cast("double").alias(c)
    return lines(spark, d).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), s("discount"), s("tax_amount"), s("total"))


@query("expense_metrics", f"WITH {_LINES} SELECT count(*) AS n, count(DISTINCT l_orderkey) AS n_orders, count(*) FILTER (disc > 0) AS discounted, sum(total)::DOUBLE AS total, min(total)::DOUBLE AS least, max(total)::DOUBLE AS most, round(avg(total)::DOUBLE, 4) AS mean, round(median(total::DOUBLE), 4) AS median FROM tot")
def expense_metrics(spark, d):
    t = F.col("total").cast("double")
    return lines(spark, d).agg(
        F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("n_orders"), F.count_if(F.col("disc") > 0).alias("discounted"), F.sum("total").cast("double").alias("total"),
        F.min(t).alias("least"), F.max(t).alias("most"), F.round(F.avg(t), 4).alias("mean"), F.round(F.median(t), 4).alias("median"),
    )


@query("expense_groups", f"""WITH {_LINES}, g AS (SELECT CASE WHEN grouping(l_suppkey) = 0 THEN 'supplier' ELSE 'flag' END AS dimension, coalesce(l_suppkey::VARCHAR, l_returnflag) AS key, count(*) AS n, sum(total) AS total FROM tot GROUP BY GROUPING SETS ((l_suppkey), (l_returnflag))),
r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY total DESC, key) AS k FROM g) SELECT dimension, key, n, total::DOUBLE AS total, k FROM r WHERE k <= 100""")
def expense_groups(spark, d):
    """All one-key groupings in one pass, the top 100 of each."""
    lines(spark, d).createOrReplaceTempView("__expense_lines")
    g = spark.sql("SELECT CASE WHEN grouping(l_suppkey) = 0 THEN 'supplier' ELSE 'flag' END AS dimension, coalesce(cast(l_suppkey AS string), l_returnflag) AS key, count(*) AS n, sum(total) AS total FROM __expense_lines GROUP BY GROUPING SETS ((l_suppkey), (l_returnflag))")
    k = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("total"), "key")).cast("long")
    return g.withColumn("k", k).filter("k <= 100").select("dimension", "key", "n", F.col("total").cast("double").alias("total"), "k")


@query("repeated_lines", "SELECT l_suppkey, l_partkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_lines(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey", "l_quantity").agg(F.count("*").alias("n")).filter("n > 1")


@query("percentiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.75), 6) AS p75, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY 1")
def percentiles(spark, d):
    q = F.percentile("l_extendedprice", F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9)))).alias("q")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(q).select("l_returnflag", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p10", "p25", "p50", "p75", "p90"))])


@query("month_totals", "SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n FROM lineitem GROUP BY 1")
def month_totals(spark, d):
    return table(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("record_issue_counts")
def record_issue_counts(spark, d):
    """Number of raw records by reason; '-' counts the good ones."""
    r = parse_records(table(spark, d, "expense_records")).select(F.explode_outer("errors.reason").alias("r"))
    return r.groupBy(F.coalesce("r", F.lit("-")).alias("reason")).agg(F.count("*").alias("n"))


# the good records in SQL: the same fields and checks as problem 4, each (source_file, source_row) once
_FIELD = lambda i: f"""replace(trim({_BARE.format(c=f'f[{i}]')}), '""', '"')"""
_YES = "('true', 't', 'yes', 'y', '1')"
_cents = lambda x: f"floor(({x}) * 100 + 0.5) / 100"
_GOOD = (
    _P4_SQL[: _P4_SQL.index("SELECT source_file, source_row, 'quoting'")].rstrip()
    + f""", g AS (SELECT source_file, source_row, x AS quantity, y AS unit_amount, strftime(day, '%Y-%m') AS month, {", ".join(f"{_FIELD(i + 1)} AS {n}" for i, n in enumerate(FIELDS) if n not in ("quantity", "unit_amount", "expense_date", *NUMERIC))},
 {", ".join(f"coalesce(CASE WHEN regexp_full_match({_FIELD(FIELDS.index(n) + 1)}, '{_NUM}') THEN try_cast({_FIELD(FIELDS.index(n) + 1)} AS DOUBLE) END, {d})" + f" AS {n}" for n, d in (("fx_rate_to_reporting", 1), ("tax_rate", 0), ("discount_rate", 0)))}
 FROM n WHERE quoted AND len(f) = 17 AND x > 0 AND isfinite(x) AND y >= 0 AND isfinite(y) AND day IS NOT NULL),
m AS (SELECT *, lower(reimbursable) IN {_YES} AS paid, lower(receipt_available) IN {_YES} AS receipt, {_cents("quantity * unit_amount")} AS subtotal FROM g), d2 AS (SELECT *, {_cents("subtotal * discount_rate")} AS discount FROM m),
c AS (SELECT *, {_cents("(subtotal - discount) * tax_rate")} AS tax FROM d2), l AS (SELECT *, {_cents("subtotal - discount + tax")} AS amount, {_cents("(subtotal - discount + tax) * fx_rate_to_reporting")} AS reporting FROM c)"""
)


def record_lines(spark, d) -> DataFrame:
    """Good records with their calculated amounts; a missing rate of exchange is 1, other missing rates are 0."""
    yes = lambda c: F.lower(F.trim(c)).isin("true", "t", "yes", "y", "1")
    g = good_records(table(spark, d, "expense_records")).fillna({"fx_rate_to_reporting": 1.0, "tax_rate": 0.0, "discount_rate": 0.0})
    cents = lambda x: F.floor(x * 100 + 0.5) / 100
    g = g.withColumns({"paid": yes("reimbursable"), "receipt": yes("receipt_available"), "month": F.date_format("expense_date", "yyyy-MM"), "subtotal": cents(F.col("quantity") * F.col("unit_amount"))})
    g = g.withColumn("discount", cents(F.col("subtotal") * F.col("discount_rate")))
    g = g.withColumn("tax", cents((F.col("subtotal") - F.col("discount")) * F.col("tax_rate")))
    gross = F.col("subtotal") - F.col("discount") + F.col("tax")
    return g.withColumn("amount", cents(gross)).withColumn("reporting", cents(gross * F.col("fx_rate_to_reporting")))


_CALC = ("subtotal", "discount", "tax")


@query("record_metrics", f"""{_GOOD}, i AS (SELECT expense_id, count(*) AS k FROM l GROUP BY 1), p AS (SELECT count(*) AS k FROM l GROUP BY employee_ref, month, merchant, amount, currency)
SELECT count(*) AS valid_rows, (SELECT count(*) FROM r) AS input_rows, (SELECT count(*) FROM r) - count(*) AS error_rows, count(DISTINCT expense_id) AS unique_expense_ids, (SELECT count(*) FROM i WHERE k > 1) AS duplicate_expense_ids, count(DISTINCT employee_ref) AS unique_employees, count(DISTINCT department) AS unique_departments, count(DISTINCT project_code) AS unique_projects, count(DISTINCT merchant) AS unique_merchants,
 {", ".join(f"round(sum({c} * fx_rate_to_reporting), 1) AS {c}_reporting" for c in _CALC)}, round(sum(reporting), 2) AS total_expense_reporting, round(sum(reporting) FILTER (paid), 2) AS reimbursable_expense_reporting, round(sum(reporting) FILTER (NOT paid), 2) AS non_reimbursable_expense_reporting,
 round(avg(reporting), 2) AS average_transaction_reporting, round(median(reporting), 2) AS median_transaction_reporting, min(reporting) AS min_transaction_reporting, max(reporting) AS max_transaction_reporting, count(*) FILTER (NOT receipt) AS receipt_missing_count, round(avg(receipt::INT), 4) AS receipt_coverage, (SELECT sum(k) FILTER (k > 1)::BIGINT FROM p) AS potential_duplicate_count FROM l""")
def record_metrics(spark, d):
    """Metrics of the parsed records in one row: counts, distinct counts, totals in the reporting currency, repeats."""
    l = cut(record_lines(spark, d))
    raw = table(spark, d, "expense_records").select("source_file", "source_row").distinct().agg(F.count("*").alias("input_rows"))
    repeats = l.groupBy("expense_id").agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("duplicate_expense_ids"))
    alike = l.groupBy("employee_ref", "month", "merchant", "amount", "currency").agg(F.count("*").alias("k")).agg(F.sum(F.when(F.col("k") > 1, F.col("k"))).alias("potential_duplicate_count"))
    r = F.col("reporting")
    m = l.agg(
        F.count("*").alias("valid_rows"), *[F.count_distinct(c).alias(f"unique_{n}") for c, n in (("expense_id", "expense_ids"), ("employee_ref", "employees"), ("department", "departments"), ("project_code", "projects"), ("merchant", "merchants"))],
        *[F.round(F.sum(F.col(c) * F.col("fx_rate_to_reporting")), 1).alias(f"{c}_reporting") for c in _CALC], F.round(F.sum(r), 2).alias("total_expense_reporting"),
        F.round(F.sum(F.when(F.col("paid"), r)), 2).alias("reimbursable_expense_reporting"), F.round(F.sum(F.when(~F.col("paid"), r)), 2).alias("non_reimbursable_expense_reporting"), F.round(F.avg(r), 2).alias("average_transaction_reporting"), F.round(F.median(r), 2).alias("median_transaction_reporting"),
        F.min(r).alias("min_transaction_reporting"), F.max(r).alias("max_transaction_reporting"), F.count_if(~F.col("receipt")).alias("receipt_missing_count"), F.round(F.avg(F.col("receipt").cast("int")), 4).alias("receipt_coverage"),
    )
    out = m.crossJoin(F.broadcast(raw)).crossJoin(F.broadcast(repeats)).crossJoin(F.broadcast(alike))  # one row each
    return out.withColumn("error_rows", F.col("input_rows") - F.col("valid_rows"))


_DIMENSIONS = {"by_employee": "employee_ref", "by_department": "department", "by_category": "category", "by_project": "project_code", "by_merchant": "merchant", "by_payment_method": "payment_method", "by_currency": "currency", "by_month": "month"}


@query("record_groups", f"""{_GOOD}, us AS ({" UNION ALL ".join(f"SELECT '{k}' AS dimension, {c} AS key, amount, reporting FROM l" for k, c in _DIMENSIONS.items())}),
qs AS (SELECT dimension, key, count(*) AS n, round(sum(reporting), 2) AS reporting_total, CASE WHEN dimension = 'by_currency' THEN round(sum(amount), 2) END AS local_total FROM us GROUP BY 1, 2),
ks AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY reporting_total DESC, key) AS rank FROM qs) SELECT * FROM ks WHERE rank <= 100 OR dimension NOT IN ('by_employee', 'by_project', 'by_merchant')""")
def record_groups(spark, d):
    """Totals by each of eight keys in one pass; the top 100 employees, projects and merchants."""
    pairs = F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(c).alias("key")) for k, c in _DIMENSIONS.items()])
    u = record_lines(spark, d).select("amount", "reporting", F.explode(pairs).alias("p")).groupBy("p.dimension", "p.key").agg(F.count("*").alias("n"), F.round(F.sum("reporting"), 2).alias("reporting_total"), F.round(F.sum("amount"), 2).alias("local"))
    u = u.select("dimension", "key", "n", "reporting_total", F.when(F.col("dimension") == "by_currency", F.col("local")).alias("local_total"))
    rank = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("reporting_total"), "key")).cast("long")  # grouped rows only
    return u.withColumn("rank", rank).filter("rank <= 100 or dimension not in ('by_employee', 'by_project', 'by_merchant')")


@query("record_totals")
def record_totals(spark, d):
    """Good records by currency: repeated expense ids once (the first source row)."""
    g = good_records(table(spark, d, "expense_records"))
    once = g.groupBy("expense_id").agg(F.min_by(F.struct("currency", "quantity", "unit_amount", "employee_ref"), F.struct("source_file", "source_row")).alias("x"))
    return once.groupBy("x.currency").agg(F.count("*").alias("n"), F.count_distinct("x.employee_ref").alias("n_employees"), F.round(F.sum(F.col("x.quantity") * F.col("x.unit_amount")), 2).alias("total"))
