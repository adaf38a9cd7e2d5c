"""Column functions on text: built-in expressions only, unless said otherwise."""
from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType


def casefold(c: Column) -> Column:
    """Lower case with the two foldings that lower() leaves: final sigma and sharp s."""
    return F.replace(F.replace(F.lower(c), F.lit("ς"), F.lit("σ")), F.lit("ß"), F.lit("ss"))


def collapse(c: Column) -> Column:
    """Case folded, white space of any kind collapsed and trimmed."""
    return F.trim(F.regexp_replace(casefold(c), r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def nfkc_casefold(s: pd.Series) -> pd.Series:
    """NFKC and full case folding (Arrow batches; Spark has neither)."""
    return s.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t).casefold())


# fixed values: dynamic values that a semantic document does not tell apart
SEMANTIC = [
    re.compile(p, f)
    for p, f in (
        (r"https?://\S+", re.I),
        (r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", re.I),
        (r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b", 0),
        (r"\b\d{1,2}:\d{2}(?::\d{2})?\b", 0),
        (r"\b\d{6,}\b", 0),
        (r"\b[A-Z]{1,8}[-_][A-Z0-9]{2,}[-_][A-Z0-9]{2,}\b", 0),
    )
]


def _semantic(t: str | None) -> str:
    t = (t or "").replace("\x07", " ").casefold()
    for p in SEMANTIC:
        t = p.sub(" <DYN> ", t)
    return " ".join(t.split())


@F.pandas_udf(StringType())
def semantic_text(s: pd.Series) -> pd.Series:
    """Full case folding, dynamic values masked, white space collapsed (Arrow batches; Java's word bounds and digits differ); null as empty."""
    return s.map(_semantic)


def slug(c: Column) -> Column:
    """Header slug: lower case, other than a-z 0-9 to one underscore, none outside."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


# fixed values: order and patterns of the dynamic masks
DYNAMIC = (
    r"https?://[^\s]+",
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    r"[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?",
    r"[A-Z]{2,5}-[0-9]{4,}(-[0-9]+)?",
    r"[0-9]+",
)
TYPED = (
    ("<URL>", r"https?://[^\s]+"),
    ("<EMAIL>", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"),
    ("<HEX>", r"0x[0-9a-fA-F]+"),
    ("<NUM>", r"[0-9]+([.,][0-9]+)*"),
)


def mask_dynamic(c: Column) -> Column:
    """Every dynamic value as <DYN>."""
    for p in DYNAMIC:
        c = F.regexp_replace(c, p, "<DYN>")
    return c


def mask_typed(c: Column) -> Column:
    """URL, e-mail, hexadecimal and number masks, in that order."""
    for tag, p in TYPED:
        c = F.regexp_replace(c, p, tag)
    return c


ENTITY = (("ID", r"[A-Z]{2,5}-[0-9]{4,}(?:-[0-9]+)?"), ("EMAIL", TYPED[1][1]), ("FILENAME", r"[A-Za-z0-9_.]+[.](?:xlsx|csv|pdf|txt)"), ("URL", r"https?://[^\s]+"))


def _typed(values: Column, kind: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))


def entities(c: Column) -> Column:
    """array<struct<type,value>> in order of type, each once: ids, e-mails, file names, public URLs, numbers of four or more digits outside ids."""
    found = []
    for kind, p in ENTITY:
        vals = F.regexp_extract_all(c, F.lit(f"({p})"), F.lit(1))
        if kind == "URL":
            vals = F.filter(vals, lambda u: ~is_private(u))
        found.append(_typed(vals, kind))
    bare = F.regexp_replace(F.regexp_replace(c, TYPED[0][1], " "), ENTITY[0][1], " ")
    nums = F.regexp_extract_all(bare, F.lit(r"([0-9]{4,})"), F.lit(1))
    found.append(_typed(nums, "NUMBER"))
    return F.array_distinct(F.concat(*found))


def url_host(c: Column) -> Column:
    """Lower-case host without port and leading www."""
    h = F.regexp_extract(F.lower(c), r"^[a-z]+://([^/:?#]+)", 1)
    return F.nullif(F.regexp_replace(h, r"^www[.]", ""), F.lit(""))


def is_private(c: Column) -> Column:
    """Loopback, private and link-local hosts."""
    return F.coalesce(url_host(c).rlike(r"^(localhost|127[.]|10[.]|192[.]168[.]|172[.](1[6-9]|2[0-9]|3[01])[.]|169[.]254[.])"), F.lit(False))


def contains_either(a: Column, b: Column, least: int = 4) -> Column:
    """Whether one text holds the other, both at least ``least`` long."""
    ok = (F.length(a) >= least) & (F.length(b) >= least) & (F.contains(a, b) | F.contains(b, a))
    return F.coalesce(ok, F.lit(False))


def clip(c: Column, head: int = 1700, tail: int = 300) -> Column:
    """Head and tail of texts longer than both together."""
    return F.when(F.length(c) > head + tail, F.concat(F.left(c, F.lit(head)), F.lit(" "), F.right(c, F.lit(tail)))).otherwise(c)


def shorten(c: Column, n: int) -> Column:
    """At most n characters, the last three dots where cut."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 3)), F.lit("..."))).otherwise(c)


def stable_id(*cols: Column, size: int = 16) -> Column:
    """Upper-case prefix of the SHA-256 of the joined values."""
    return F.upper(F.left(F.sha2(F.concat_ws("|", *cols), 256), F.lit(size)))


# fixed values: entity types that identify an object
LINKABLE = ("INVOICE_ID", "EMPLOYEE_ID", "CASE_ID", "DOCUMENT_ID", "CUSTOMER_ID", "ID_CANDIDATE", "EMAIL", "FILENAME")


def linkable(entities: Column) -> Column:
    """'TYPE\\x1fvalue' of the entities that identify an object, each once: the linkable types, and URLs with more than a host."""
    kind = lambda e: F.upper(F.trim(e["type"]))
    value = lambda e: casefold(F.trim(e["value"]))
    page = lambda e: F.contains(F.regexp_replace(value(e), r"(?s)^.*?://", ""), F.lit("/"))
    ok = F.filter(entities, lambda e: F.coalesce((value(e) != "") & (kind(e).isin(*LINKABLE) | (kind(e) == "URL") & page(e)), F.lit(False)))
    return F.coalesce(F.array_distinct(F.transform(ok, lambda e: F.concat(kind(e), F.lit("\x1f"), value(e)))), F.array().cast("array<string>"))
