import datetime
import json
import zipfile

import pytest

from opweave.sources import files as S
from opweave.streaming.sessions import streaming_activities, streaming_counts, streaming_gap_sessions
from tests.test_text_engine import keys


def test_jsonl(spark, tmp_path):
    d = tmp_path / "ses_1" / "chunk_2"
    d.mkdir(parents=True)
    (d / "events.jsonl").write_text('{"event_id": "é"}\n\nnot json\n[1]\n{"event_id": "b"}\n', encoding="utf-8")
    f = S.read_jsonl_lenient(spark, str(d / "events.jsonl"), "event_id string")
    assert sorted(r.error or "-" for r in f.collect()) == ["-", "-", "invalid_json", "not_an_object"]
    s = S.read_sessions(spark, str(tmp_path), "event_id string")
    assert {(r.session_dir, r.chunk_dir, r.event_id) for r in s.collect()} == {("ses_1", "chunk_2", "é"), ("ses_1", "chunk_2", "b")}
    assert [r.event_id for r in S.first_events(s, ["event_id"], 1).collect()] == ["b"]
    with pytest.raises(Exception):
        S.read_jsonl_strict(spark, str(d / "events.jsonl"), "event_id string").collect()


def test_segments_in_wrappers(spark, tmp_path):
    seg = {"session_id": "s", "start": "1", "end": "2", "label": "L"}
    (tmp_path / "a.json").write_text(json.dumps({"data": {"predictions": [seg, seg | {"label": "M"}]}}))
    (tmp_path / "b.json").write_text(json.dumps([seg | {"label": "N"}]))
    (tmp_path / "c.json").write_text("nothing")
    assert sorted(r.label for r in S.find_segments(spark, str(tmp_path)).collect()) == ["L", "M", "N"]


def test_ground_truth(spark, tmp_path):
    g = {"version": "1", "sessions": [{"session_id": "s", "segments": [{"segment_id": "a", "execution_id": "", "process_code": "P", "start": "1", "end": "2"}, {"segment_id": "b", "execution_id": "x", "process_code": "P", "start": "2", "end": "3"}]}]}
    (tmp_path / "g.json").write_text(json.dumps(g))
    assert sorted(r.owner for r in S.read_ground_truth(spark, str(tmp_path / "g.json"), "1").collect()) == ["a", "x"]
    with pytest.raises(ValueError):
        S.read_ground_truth(spark, str(tmp_path / "g.json"), "2")


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Expense ID,Unit-Amount\n1,"a ""b"", c"\n', encoding="utf-8")
    r = S.read_csv(spark, str(tmp_path / "a.csv"))
    assert r.columns == ["expense_id", "unit_amount"] and r.first().unit_amount == 'a "b", c'
    S.write_csv(r, str(tmp_path / "out"), single=True)
    assert S.read_csv(spark, str(tmp_path / "out")).collect() == r.collect()


def workbook(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda ref, t: f'<c r="{ref}" t="inlineStr"><is><t>{t}</t></is></c>'
    good = f'<worksheet {ns}><sheetData><row r="1">{cell("A1", "note")}</row><row r="3">{cell("A3", "Amount")}{cell("C3", "Name")}</row><row r="4"><c r="A4"><v>5</v></c><c r="C4" t="s"><v>0</v></c></row><row r="5"/></sheetData></worksheet>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="One" sheetId="1"/><sheet name="Two" sheetId="2"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>é</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", good)
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row r="1">{cell("A1", "nothing here")}</row></sheetData></worksheet>')


def test_xlsx(spark, tmp_path):
    workbook(tmp_path / "w.xlsx")
    spark.dataSource.register(S.XlsxSource)
    r = spark.read.format("xlsx").option("columns", "name,amount").option("least", 2).load(str(tmp_path / "w.xlsx")).collect()
    assert [tuple(x) for x in r] == [("One", 4, "é", "5")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é|x"), (2, None)], "id int, t string")
    S.write_jsonl(df, str(tmp_path / "j"), single=True)
    assert sorted(map(tuple, spark.read.schema("id int, t string").json(str(tmp_path / "j")).collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    assert json.loads(S.report(df.filter("id = 1"))) == {"id": 1, "t": "é|x"}
    assert "é\\|x" in S.markdown(df, "T")
    with pytest.raises(ValueError):
        S.report(df)
    S.append_log(df, str(tmp_path / "log"))
    S.append_log(df, str(tmp_path / "log"))
    assert [r.id for r in S.read_log(spark, str(tmp_path / "log"), ["id"]).collect()] == [1, 1, 2, 2]


def test_merge_latest(spark):
    old = spark.createDataFrame([("a", 1, "o"), ("b", 5, "o")], "k string, v int, x string")
    new = spark.createDataFrame([("a", 1, "n"), ("b", 4, "n"), ("c", 1, "n")], "k string, v int, x string")
    assert {(r.k, r.x) for r in S.merge_latest(old, new, ["k"], "v").collect()} == {("a", "n"), ("b", "o"), ("c", "n")}


def test_streams(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    ev = spark.createDataFrame([("u", t0 + datetime.timedelta(seconds=s), "view") for s in (0, 10, 200, 5000)], "u string, ts timestamp, event_type string")
    ev.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    for name, df, want in (("gaps", streaming_gap_sessions(stream, "u", "ts"), {2, 1}), ("counts", streaming_counts(stream, "ts"), {3})):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert {r.n for r in spark.table(name).collect()} <= want and spark.table(name).count() >= 1


def test_stream_of_activities(spark, tmp_path):
    e = [*keys("hi"), *keys("x", 60_000)]
    rows = [(x["event_id"], "s", x["timestamp_ms"], x["timestamp_iso"], x["event_type"], json.dumps(x["payload"]), json.dumps(x["context"]), json.dumps(x["correlation"])) for x in e]
    df = spark.createDataFrame(rows, "event_id string, session_id string, timestamp_ms long, timestamp_iso string, event_type string, payload string, context string, correlation string")
    df.write.parquet(str(tmp_path / "raw"))
    q = streaming_activities(spark.readStream.schema(df.schema).parquet(str(tmp_path / "raw"))).writeStream.format("memory").queryName("acts").outputMode("append").trigger(once=True).start()  # one batch: time-outs would keep it going
    q.awaitTermination(60)
    q.stop()
    assert [r.text for r in spark.table("acts").collect()][:1] == ["hi"]  # the open run may come with a time-out


def test_lines_are_numbered(spark, tmp_path):
    from opweave.sources.files import bad_lines, event_order, read_csv, read_jsonl_lenient, read_jsonl_strict, read_sessions

    d = tmp_path / "ses_1" / "chunk_a"
    d.mkdir(parents=True)
    good = '{"event_id": "e%d", "timestamp_ms": %d, "correlation": {"sequence_number": null, "chunk_id": ""}}'
    (d / "events.jsonl").write_text("\n".join([good % (i, i) for i in range(500)] + ["", "{bad", "[1]", good % (500, 500)]))
    schema = "event_id string, timestamp_ms long, correlation struct<sequence_number:long,chunk_id:string>"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_jsonl_lenient(spark, str(d), schema, numbered=True).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.line_no for r in rows] == [*range(1, 501), 502, 503, 504]
    assert [r.error for r in rows[-3:]] == ["invalid_json", "not_an_object", None] and rows[6].obj.event_id == "e6"
    with pytest.raises(ValueError, match="line 502: invalid_json"):
        read_jsonl_strict(spark, str(d), schema)
    e = read_sessions(spark, str(tmp_path), schema)
    assert event_order(e) == ["timestamp_ms", "sequence_number", "event_id"]
    assert {tuple(r) for r in e.select("chunk_id", "sequence_number").collect()} == {("chunk_a", 0)} and e.count() == 501
    assert {tuple(r) for r in bad_lines(spark, str(tmp_path)).collect()} == {("ses_1", "invalid_json", 1), ("ses_1", "not_an_object", 1)}
    (tmp_path / "x.csv").write_text("\ufeffName,B c\na,\"1\n2\"\nb,3\n")
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "x.csv"), numbered=True).orderBy("file_row").collect()] == [("a", "1\n2", 2), ("b", "3", 3)]


def test_segments_at_any_depth(spark, tmp_path):
    import json

    from opweave.sources.files import find_segments

    doc = {"session_id": "s", "start": "a", "end": "b", "label": "x"}
    for _ in range(7):
        doc = {"data": [doc]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    assert [tuple(r) for r in find_segments(spark, str(tmp_path / "d.json")).collect()] == [("s", "a", "b", "x")]


def test_sheets_by_relationship(spark, tmp_path):
    import zipfile

    from opweave.sources.files import read_xlsx

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = lambda v: f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Name</t></is></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>{v}</t></is></c></row></sheetData></worksheet>'
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{r}"><sheets><sheet name="first" r:id="rId2"/><sheet name="second" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet("of second"))
        z.writestr("xl/worksheets/sheet2.xml", sheet("of first"))
    assert {(x.sheet, x.name) for x in read_xlsx(spark, str(tmp_path / "w.xlsx"), ["name"]).collect()} == {("first", "of first"), ("second", "of second")}
