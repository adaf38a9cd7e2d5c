"""Problem 4: typed rows and labelled errors from raw delimited records.

A quote-aware finite-state tokenizer runs over the bytes of all records of a batch at
once.  Records are cut into chunks of fixed length; for every chunk the tokenizer's
transition is computed for each entry state together (one table lookup per byte
column), the chunks' transitions are composed along each record, which gives every
chunk its true entry state, and a second pass marks field ends and the first broken
quote with its byte offset.  A record of any length is thus a row of equal chunks.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# fixed values: the fields of an expense record
FIELDS = (
    "expense_id", "employee_ref", "department", "expense_date", "category", "merchant", "project_code", "payment_method", "reimbursable",
    "receipt_available", "quantity", "unit_amount", "currency", "fx_rate_to_reporting", "tax_rate", "discount_rate", "source_reference",
)
NUMERIC = ("fx_rate_to_reporting", "tax_rate", "discount_rate")

# states
START, PLAIN, QUOTED, CLOSED, BROKEN = range(5)
# byte classes
OTHER, COMMA, QUOTE, BLANK, PAD = range(5)
_T = np.zeros((5, 5), np.uint8)  # [class, state] -> state
_T[OTHER] = [PLAIN, PLAIN, QUOTED, BROKEN, BROKEN]
_T[COMMA] = [START, START, QUOTED, START, BROKEN]
_T[QUOTE] = [QUOTED, BROKEN, CLOSED, QUOTED, BROKEN]
_T[BLANK] = [START, PLAIN, QUOTED, CLOSED, BROKEN]
_T[PAD] = [START, PLAIN, QUOTED, CLOSED, BROKEN]
# a doubled quote returns from CLOSED to QUOTED, but only at once: a blank after the closing quote leaves that chance
AFTER = 5
_T = np.pad(_T, ((0, 0), (0, 1)))
_T[:, AFTER] = [BROKEN, START, BROKEN, AFTER, AFTER]
_T[BLANK, CLOSED] = AFTER
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord(",")] = COMMA
_CLASS[ord('"')] = QUOTE
_CLASS[[9, 10, 11, 12, 13, 32]] = BLANK
N_STATES = 6

NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\Z")
_DATES = (
    re.compile(r"(?P<y>[0-9]{4})-(?P<m>[0-9]{1,2})-(?P<d>[0-9]{1,2})\Z"),
    re.compile(r"(?P<y>[0-9]{4})/(?P<m>[0-9]{1,2})/(?P<d>[0-9]{1,2})\Z"),
    re.compile(r"(?P<d>[0-9]{1,2})/(?P<m>[0-9]{1,2})/(?P<y>[0-9]{4})\Z"),
)
_ISO = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})[Tt ]([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:[.,][0-9]+)?)?(?:[Zz]|[+-]([0-9]{2})(?::?([0-9]{2}))?)?\Z")


def parse_number(text: str) -> float | None:
    """ASCII decimal with optional sign and exponent, finite; else None."""
    text = text.strip()
    if not (text.isdigit() and text.isascii()) and not NUMBER.match(text):
        return None
    x = float(text)
    return x if x not in (float("inf"), float("-inf")) else None


def parse_date(text: str) -> date | None:
    """y-m-d, y/m/d, d/m/y or an ISO date-time; None if there is no such date."""
    text = text.strip()
    try:
        for p in _DATES:
            if m := p.match(text):
                return date(int(m["y"]), int(m["m"]), int(m["d"]))
        if m := _ISO.match(text):
            h, mi, s, zh, zm = (int(m[i] or 0) for i in (4, 5, 6, 7, 8))
            if h < 24 and mi < 60 and s < 60 and zh < 24 and zm < 60:
                return date(int(m[1]), int(m[2]), int(m[3]))
    except ValueError:
        pass
    return None


def tokenize(records: list[bytes], chunk: int = 128, block: int = 1 << 22) -> tuple[list[np.ndarray], np.ndarray]:
    """Field ends (byte offsets of separating commas) of each record, and the offset of its broken quote or -1.

    ``block`` bounds the bytes tokenized together; a longer record forms a block of its own."""
    ends: list[np.ndarray] = []
    broken = np.full(len(records), -1, np.int64)
    i = 0
    while i < len(records):
        j, held = i, 0
        while j < len(records) and (j == i or held + len(records[j]) + chunk <= block):
            held += len(records[j]) + chunk
            j += 1
        _tokenize_block(records[i:j], chunk, ends, broken[i:j])
        i = j
    return ends, broken


def _tokenize_block(records: list[bytes], chunk: int, ends: list[np.ndarray], broken: np.ndarray) -> None:
    n = np.array([max(1, -(-len(r) // chunk)) for r in records])
    first = np.concatenate([[0], np.cumsum(n)])
    cls = np.full((first[-1], chunk), PAD, np.uint8)
    flat = cls.reshape(-1)
    size = np.array([len(r) for r in records])
    body = _CLASS[np.frombuffer(b"".join(records), np.uint8)]
    if len(body):
        flat[np.repeat(first[:-1] * chunk - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(len(body))] = body
    # transition of every chunk from every entry state
    trans = np.tile(np.arange(N_STATES, dtype=np.uint8), (first[-1], 1))
    for c in range(chunk):
        trans = _T[cls[:, c][:, None], trans]
    # composed along each record: all records' k-th chunks together
    entry = np.zeros(first[-1], np.uint8)
    state = np.zeros(len(records), np.uint8)
    for k in range(n.max()):
        live = np.flatnonzero(n > k)
        at = first[live] + k
        entry[at] = state[live]
        state[live] = trans[at, state[live]]
    # second pass with the true entry states
    st = entry
    comma = np.zeros(cls.shape, bool)
    bad = np.full(first[-1], -1, np.int64)
    for c in range(chunk):
        nxt = _T[cls[:, c], st]
        comma[:, c] = (cls[:, c] == COMMA) & (nxt == START)
        hit = (nxt == BROKEN) & (st != BROKEN)
        bad[hit] = c
        st = nxt
    row = np.repeat(np.arange(len(records)), n)
    hit = np.flatnonzero(bad >= 0)
    broken[row[hit]] = bad[hit] + (hit - first[row[hit]]) * chunk
    broken[(state == QUOTED) & (broken < 0)] = size[(state == QUOTED) & (broken < 0)]  # the quote never closes
    r, c = np.nonzero(comma)
    offset = (r - first[row[r]]) * chunk + c
    ends.extend(np.split(offset, np.searchsorted(row[r], np.arange(1, len(records)))))


def _value(raw: bytes) -> str:
    t = raw.decode("utf-8", "replace").strip()
    return t[1:-1].replace('""', '"') if len(t) >= 2 and t[0] == '"' == t[-1] else t


def _schema() -> pa.Schema:
    text = [(f, pa.string()) for f in FIELDS if f not in ("expense_date", "quantity", "unit_amount", *NUMERIC)]
    typed = [("expense_date", pa.date32()), ("quantity", pa.float64()), ("unit_amount", pa.float64()), *((f, pa.float64()) for f in NUMERIC)]
    return pa.schema(
        [("source_file", pa.string()), ("source_row", pa.int32()), *text, *typed, ("raw_line", pa.string()), ("errors", pa.list_(pa.struct([("reason", pa.string()), ("byte_offset", pa.int64())])))]
    )


PARSED = (
    "source_file string, source_row int, "
    + ", ".join(f"{f} string" for f in FIELDS if f not in ("expense_date", "quantity", "unit_amount", *NUMERIC))
    + ", expense_date date, quantity double, unit_amount double, "
    + ", ".join(f"{f} double" for f in NUMERIC)
    + ", raw_line string, errors array<struct<reason:string,byte_offset:bigint>>"
)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _schema()
    for b in batches:
        if not b.num_rows:
            continue
        lines = b.column("raw_line").to_pylist()
        raw = [(x or "").encode() for x in lines]
        ends, broken = tokenize(raw)
        out: dict[str, list] = {f: [None] * len(raw) for f in FIELDS}
        errors: list[list] = []
        for i, r in enumerate(raw):
            if broken[i] >= 0:
                errors.append([("quoting", int(broken[i]))])
                continue
            cuts = ends[i]
            if len(cuts) != len(FIELDS) - 1:
                errors.append([("column_count", int(cuts[len(FIELDS) - 1]) if len(cuts) >= len(FIELDS) else len(r))])
                continue
            begin = [0, *(int(c) + 1 for c in cuts)]
            v = dict(zip(FIELDS, (_value(r[s:e]) for s, e in zip(begin, [*map(int, cuts), len(r)]))))
            at = dict(zip(FIELDS, begin))
            q, u, d = parse_number(v["quantity"]), parse_number(v["unit_amount"]), parse_date(v["expense_date"])
            bad = [(f, at[f]) for f, wrong in (("quantity", q is None or q <= 0), ("unit_amount", u is None or u < 0), ("expense_date", d is None)) if wrong]
            errors.append(bad)
            for f in FIELDS:
                out[f][i] = {"quantity": q, "unit_amount": u, "expense_date": d}[f] if f in ("quantity", "unit_amount", "expense_date") else parse_number(v[f]) if f in NUMERIC else v[f]
        cols = {"source_file": b.column("source_file"), "source_row": b.column("source_row").cast(pa.int32()), "raw_line": b.column("raw_line")} | out
        cols["errors"] = [[{"reason": x, "byte_offset": o} for x, o in e] for e in errors]
        yield pa.RecordBatch.from_arrays([x if isinstance(x := cols[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Only the errors: of a record's fields none but the three checked ones is decoded."""
    kind = pa.struct([("reason", pa.string()), ("byte_offset", pa.int64())])
    q_at, u_at, d_at = (FIELDS.index(f) for f in ("quantity", "unit_amount", "expense_date"))
    dates: dict[str, bool] = {}
    for b in batches:
        if not b.num_rows:
            continue
        raw = [(x or "").encode() for x in b.column("raw_line").to_pylist()]
        ends, broken = tokenize(raw)
        rows: list[int] = []
        errors: list[list[dict]] = []
        for i, r in enumerate(raw):
            bad = []
            cuts = ends[i]
            if broken[i] >= 0:
                bad = [("quoting", int(broken[i]))]
            elif len(cuts) != len(FIELDS) - 1:
                bad = [("column_count", int(cuts[len(FIELDS) - 1]) if len(cuts) >= len(FIELDS) else len(r))]
            else:
                begin = cuts.tolist()
                field = lambda k: r[begin[k - 1] + 1 if k else 0 : begin[k] if k < len(begin) else len(r)]
                q, u = parse_number(_value(field(q_at))), parse_number(_value(field(u_at)))
                if q is None or q <= 0:
                    bad.append(("quantity", begin[q_at - 1] + 1))
                if u is None or u < 0:
                    bad.append(("unit_amount", begin[u_at - 1] + 1))
                day = _value(field(d_at))
                ok = dates.get(day)
                if ok is None:
                    if len(dates) > 50_000:
                        dates.clear()
                    ok = dates[day] = parse_date(day) is not None
                if not ok:
                    bad.append(("expense_date", begin[d_at - 1] + 1))
            if bad:
                rows.append(i)
                errors.append([{"reason": x, "byte_offset": o} for x, o in bad])
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("source_file").take(at), b.column("source_row").cast(pa.int32()).take(at), pa.array(errors, pa.list_(kind))], names=["source_file", "source_row", "errors"])


def parse_records(df: DataFrame) -> DataFrame:
    """Every record with its typed fields and ``errors`` (reason, byte offset in the record).

    Needs ``source_file``, ``source_row``, ``raw_line``; other columns are not read.  A null
    or empty ``raw_line`` is a record of one empty field: 'column_count'.  A good record has no
    errors; the fields of a record with broken quoting or a wrong count are null.  Redelivered
    rows are the same record: callers that want each once use ``bad_records``/``good_records``."""
    return df.select("source_file", "source_row", "raw_line").mapInArrow(_parse, PARSED)


def good_records(df: DataFrame) -> DataFrame:
    """The valid rows, typed; a redelivered (source_file, source_row) comes once, of differing deliveries the least by its fields."""
    g = parse_records(df).filter("size(errors) = 0").drop("errors", "raw_line")
    rest = [c for c in g.columns if c not in ("source_file", "source_row")]
    return g.groupBy("source_file", "source_row").agg(F.min(F.struct(*rest)).alias("x")).select("source_file", "source_row", "x.*")


def bad_records(df: DataFrame) -> DataFrame:
    """(source_file, source_row, reason, byte_offset): one row for each reason of each bad record, of repeats the least offset.

    Each delivery of a record is judged by itself."""
    bad = df.select("source_file", "source_row", "raw_line").mapInArrow(_check, "source_file string, source_row int, errors array<struct<reason:string,byte_offset:bigint>>")
    return bad.selectExpr("source_file", "source_row", "inline(errors)").groupBy("source_file", "source_row", "reason").agg(F.min("byte_offset").alias("byte_offset"))
