"""Queries that take every row: fixtures with the rows that a narrower query leaves out."""
import hashlib
import re

from pyspark.sql import functions as F

import __spark_entry__ as entry

# fixed values: Unicode White_Space
SPACES = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def test_collapse_takes_every_script(spark, tmp_path):
    texts = ["Plain  ASCII\n text ", "  Größe ÉTÉ　", "経費　　精算", "ไทย  ก", "مرحبا\u0085x", "हिन्दी  पाठ", "", None, "\x1c a"]
    spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {f"d{i}": t if t is None else hashlib.md5(re.sub(SPACES, " ", t.casefold()).strip(" ").encode()).hexdigest() for i, t in enumerate(texts)}
    assert {r.doc_id: r.h for r in entry.queries()["collapse_documents"](spark, str(tmp_path)).collect()} == want


def _acts(spark, tmp_path, rows, cols):
    """activities with every column the driver queries read; times in seconds."""
    text = [c for c in cols.split() if c not in ("start", "end")]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` {'double' if c in ('start', 'end') else 'string'}" for c in cols.split()))
    df = df.withColumn("start", F.timestamp_seconds("start")).withColumn("end", F.timestamp_seconds("end"))
    for c in ("type", "app", "window", "target_field", "text", "screen_text"):
        if c not in text:
            df = df.withColumn(c, F.lit(None).cast("string"))
    df.write.parquet(f"{tmp_path}/activities.parquet")


def test_timeline_keeps_what_comes_after_100_hours(spark, tmp_path):
    _acts(spark, tmp_path, [("a", "s", 0.0, 1.0), ("b", "s", 359_999.0, 360_000.0), ("c", "s", 360_000.0, 360_001.0), ("d", "s", 4_000_000.5, 4_000_001.0)], "activity_id session_id start end")
    got = {r.activity_id: (r.rel_s, r.elapsed) for r in entry.queries()["timeline"](spark, str(tmp_path)).collect()}
    assert got == {"a": (0, "00:00:00"), "b": (359_999, "99:59:59"), "c": (360_000, "100:00:00"), "d": (4_000_000, "1111:06:40")}


def test_rebuild_types_every_text(spark, tmp_path):
    texts = ["plain", " outer ", "Größe", "経費 精算", "a\nb\r\nc", "\ttab\u3000wide\xa0", "vv\nvv", "😀\u200dx", "\n", "ไทยมี"]
    _acts(spark, tmp_path, [(f"a{i}", "s", float(i), i + 1.0, "TEXT_ENTRY", t) for i, t in enumerate([*texts, "", None])], "activity_id session_id start end type text")
    got = sorted((r.activity_id, r.text) for r in entry.queries()["activity_rebuild_all"](spark, str(tmp_path)).collect())
    assert got == sorted((f"a{i}", t) for i, t in enumerate(texts))


def test_segment_documents_hold_every_channel(spark, tmp_path):
    rows = [
        ("a", "s", 1.0, 2.0, "CLICK", "Win  A", "F1", "Straße 123456", "x" * 1699 + " " + "y" * 400),
        ("b", "s", 3.0, 4.0, "TEXT_ENTRY", None, "", "see https://x.y/z", None),
        ("c", "s", 101.0, 102.0, "CLICK", "Win A", None, "one", None),
        ("d", "s", 201.0, 202.0, "CLICK", "Win A", None, "two", None),
    ]
    _acts(spark, tmp_path, rows, "activity_id session_id start end type window target_field text screen_text")
    at = lambda m, s: f"1970-01-01T00:{m:02d}:{s:02d}.000Z"
    spark.createDataFrame([("s", at(0, 0), at(0, 50), "A"), ("s", at(1, 40), at(1, 50), "B"), ("s", at(3, 20), at(3, 30), "B")], "session_id string, start string, end string, label string").write.parquet(f"{tmp_path}/segments.parquet")
    screen = "x" * 1699 + "  " + "y" * 300
    first = ["WIN::win a"] * 4 + ["TARGET::f1"] * 3 + ["TEXT::strasse <DYN>"] * 2 + [f"SCREEN::{screen}"] + ["TEXT::see <DYN>"] * 2 + ["ACTIONPAIR::CLICK>TEXT_ENTRY", "DUR::SHORT"]
    docs = [" ".join(first), *(" ".join(["WIN::win a"] * 4 + [f"TEXT::{t}"] * 2 + ["DUR::SHORT"]) for t in ("one", "two"))]
    got = {r.seg: r.doc for r in entry.queries()["segment_documents"](spark, str(tmp_path)).collect()}
    assert got == {i + 1: hashlib.md5(x.encode()).hexdigest() for i, x in enumerate(docs)}
