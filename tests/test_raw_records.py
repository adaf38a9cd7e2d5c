import csv
import io
import random

import pytest
from hypothesis import given, settings, strategies as st

from opweave.sources.raw_records import FIELDS, bad_records, good_records, parse_date, parse_number, tokenize


def slow(text):
    """Fields, or None for broken quotes: a plain reading of the rule."""
    fields, i = [], 0
    while True:
        j = i
        while j < len(text) and text[j] in " \t\r\n\x0b\x0c":
            j += 1
        if j < len(text) and text[j] == '"':
            k = j + 1
            while True:
                k = text.find('"', k)
                if k < 0:
                    return None
                if text[k + 1 : k + 2] == '"':
                    k += 2
                    continue
                break
            k += 1
            while k < len(text) and text[k] in " \t\r\n\x0b\x0c":
                k += 1
            if k < len(text) and text[k] != ",":
                return None
            end = k
        else:
            end = text.find(",", i)
            end = len(text) if end < 0 else end
            if '"' in text[i:end]:
                return None
        fields.append(text[i:end])
        if end >= len(text):
            return fields
        i = end + 1


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet='a",\n é', max_size=40), min_size=1, max_size=8), st.integers(1, 9))
def test_tokenizer(texts, chunk):
    ends, broken = tokenize([t.encode() for t in texts], chunk=chunk, block=64)
    for t, e, b in zip(texts, ends, broken):
        want = slow(t)
        assert (b >= 0) == (want is None)
        if want is not None:
            assert len(e) == len(want) - 1


def test_csv_round_trip():
    r = random.Random(1)
    rows = [["".join(r.choice('x",\n ') for _ in range(r.randint(0, 400))).strip() for _ in range(5)] for _ in range(200)]
    out = io.StringIO()
    lines = []
    for row in rows:
        out.seek(0), out.truncate()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(row)
        lines.append(out.getvalue().encode())
    ends, broken = tokenize(lines)
    assert (broken < 0).all() and all(len(e) == 4 for e in ends)


@pytest.mark.parametrize("text,x", [("1", 1), (" +2 ", 2), ("1e1", 10), (".5", 0.5), ("47490.", 47490), ("1e", None), ("１", None), ("nan", None), ("inf", None), ("1e999", None), ("", None), ("1 0", None), ("0x1", None), ("--2", None)])
def test_numbers(text, x):
    assert parse_number(text) == x


@pytest.mark.parametrize("text,ok", [("2024-2-29", 1), ("2023-02-29", 0), ("2023/1/5", 1), ("31/12/2024", 1), ("31/12/24", 0), ("2024-01-01T10:00:00", 1), ("2024-01-01T10:00:00+09:00", 1), ("2024-01-01T25:00:00", 0), ("2024.01.01", 0), ("24-01-01", 0), ("2024-01", 0), ("", 0), (" 2024-01-01 ", 1)])
def test_dates(text, ok):
    assert (parse_date(text) is not None) == bool(ok)


def line(**kw):
    v = dict.fromkeys(FIELDS, "x") | {"quantity": "1", "unit_amount": "2.5", "expense_date": "2024-01-02"} | kw
    return ",".join(v[f] for f in FIELDS)


def test_reasons(spark):
    rows = [("f", 1, line(), "other"), ("f", 1, line(), "again"), ("f", 2, line(quantity="0", unit_amount="-1", expense_date="soon"), ""), ("f", 3, line() + ",y", ""), ("f", 4, line(merchant='"a'), ""), ("f", 5, None, ""), ("f", 6, "", ""), ("f", 7, line(merchant='"a,""b"""'), ""), ("f", None, line(quantity="two"), ""), ("f", 8, line(merchant='"' + "z," * 50_000 + '"'), "")]
    df = spark.createDataFrame(rows, "source_file string, source_row int, raw_line string, errors string")
    bad = {(r.source_row, r.reason) for r in bad_records(df).collect()}
    assert bad == {(2, "quantity"), (2, "unit_amount"), (2, "expense_date"), (3, "column_count"), (4, "quoting"), (5, "column_count"), (6, "column_count"), (None, "quantity")}
    good = {r.source_row: r for r in good_records(df).collect()}
    assert sorted(good) == [1, 7, 8] and good[7].merchant == 'a,"b"' and good[1].unit_amount == 2.5 and len(good[8].merchant) == 100_000
    assert bad_records(df.limit(0)).count() == 0
