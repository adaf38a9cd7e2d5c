import json

import pytest

from opweave.operators.activity_builder import build_activities
from opweave.operators.text_engine import TextBuffer, build, normalize, reconcile, text_entities

FIELD = {"automation_id": "field-1", "class_name": "Edit"}


def ev(i, ms, kind="keystroke", key=None, char=None, mods=(), app="App", win="Win", target=FIELD, payload=None, screen=None, **corr):
    p = {"key": key, "character": char, "modifiers": {m: True for m in mods}, "target_field": target} if kind == "keystroke" else {}
    c = {"active_app": {"app_name": app, "window_title": win}}
    if screen:
        c["extracted_text"] = screen
    return {"event_id": f"e{i}", "session_id": "s", "timestamp_ms": ms, "timestamp_iso": f"2026-01-01T00:00:{ms // 1000:02d}.{ms % 1000:03d}Z", "event_type": kind, "payload": p | (payload or {}), "context": c, "correlation": {"sequence_number": i} | corr}


def keys(text, start=0, **kw):
    return [ev(start + k, start + k, key=c, char=c, **kw) for k, c in enumerate(text)]


def typed(events):
    return [a["text"] for a in build(events, "s") if a["type"] == "TEXT_ENTRY"]


@pytest.mark.parametrize(
    "more,text",
    [
        ([], "hello"),
        ([("Backspace", ())], "hell"),
        ([("Left", ()), ("Left", ()), ("X", ())], "helXlo"),
        ([("Home", ()), ("Delete", ())], "ello"),
        ([("a", ("ctrl",)), ("b", ())], "b"),
        ([("a", ("ctrl",)), ("x", ("ctrl",))], ""),
        ([("Backspace", ()), ("z", ("ctrl",))], "hello"),
        ([("Backspace", ()), ("z", ("ctrl",)), ("y", ("ctrl",))], "hell"),
        ([("a", ("ctrl",)), ("c", ("ctrl",)), ("End", ()), ("v", ("ctrl",))], "hellohello"),
        ([("Backspace", ("ctrl",))], ""),
    ],
)
def test_editing(more, text):
    e = keys("hello")
    e += [ev(10 + 100 * k, 10 + 100 * k, key=key, char=key if len(key) == 1 else None, mods=m) for k, (key, m) in enumerate(more)]
    assert typed(e) == [text]


def test_echo_of_a_shortcut_is_one_operation():
    ops = normalize([ev(0, 0, key="v", char="v", mods=("ctrl",)), ev(1, 1, "shortcut"), ev(2, 2, key="v", char="v")])
    assert [(o.kind, o.ids) for o in ops] == [("PASTE", ["e0", "e1", "e2"])]


def test_close_plain_keys_both_stay():
    assert typed([ev(0, 0, key="o", char="o"), ev(1, 0, key="o", char="o")]) == ["oo"]


def test_shift_echo():
    assert typed([ev(0, 0, key="n", char="N", mods=("shift",)), ev(1, 1, key="n", char="n", triggered_by="e0")]) == ["N"]
    assert typed([ev(0, 0, key="n", char="N", mods=("shift",)), ev(99, 5000, key="n", char="n")]) == ["Nn"]


def test_known_clipboard_pastes():
    e = [ev(0, 0, "clipboard_change", payload={"content": "pasted"}), ev(1, 100, key="v", char="v", mods=("ctrl",))]
    assert typed(e) == ["pasted"]


def test_runs_split_by_target_and_pause_only():
    other = FIELD | {"automation_id": "field-2"}
    assert typed(keys("ab") + keys("cd", 10, target=other)) == ["ab", "cd"]
    assert typed(keys("ab") + keys("cd", 40_000)) == ["ab", "cd"]
    assert typed([*keys("a"), ev(5, 5, "window_title_change"), *keys("b", 6)]) == ["ab"]


def test_app_switch_emits_and_splits():
    e = [*keys("ab"), ev(5, 5, "app_switch", app="B", win="W2", payload={"new_app": "B", "previous_app": "App"}), *keys("cd", 6, app="B", win="W2")]
    got = build(e, "s")
    assert [a["type"] for a in got].count("TEXT_ENTRY") == 2
    assert next(a for a in got if a["type"] == "APP_SWITCH")["triggered_by"] == ["App"]


def test_evidence():
    base = keys("a@b.example")
    assert build([*base, ev(50, 50, "browser_form_input", payload={"value": "a@b.example"})], "s")[0]["verification_status"] == "VERIFIED_BROWSER"
    assert build([*base, ev(50, 50, "screenshot_smart", screen="Mail a@b.example ok")], "s")[0]["verification_status"] == "VERIFIED_SCREEN"
    for text, status in (("a@b.example", "VERIFIED_SCREEN"), ("other", "CONFLICT")):
        assert build([*base, ev(50, 50, "screenshot_smart", screen={"text": text, "source": "field_value"})], "s")[0]["verification_status"] == status
    assert build([*base, ev(50, 50, "screenshot_smart", screen={"text": "a page\na@b.example", "source": "text_pattern"})], "s")[0]["verification_status"] == "VERIFIED_SCREEN"
    late = build([*base, ev(49, 49, key="Enter"), ev(900, 900, "screenshot_smart", screen="see a@b.example")], "s")
    assert late[0]["verification_status"] == "VERIFIED_SCREEN" and late[0]["screen_text"] == "see a@b.example"
    assert build([*base, ev(49, 49, key="Enter"), ev(9000, 9000, "screenshot_smart", screen="see a@b.example")], "s")[0]["verification_status"] == "RECONSTRUCTED"
    assert reconcile("x", ["y"], [], [], []) == "CONFLICT"
    assert reconcile("x", ["x"], ["x"], [], []) == "RECONCILED"
    assert reconcile("x", [], [], [], []) == "RECONSTRUCTED"


def test_open_dialog_ends_where_it_starts():
    got = build([ev(0, 0, "dialog_opened"), *keys("a", 50)], "s")
    d = next(a for a in got if a["type"] == "DIALOG")
    assert d["start"] == d["end"]


def test_selection_and_word_moves():
    b = TextBuffer()
    for c in "one two":
        b.apply("INSERT", c)
    b.apply("MOVE_WORD_LEFT")
    assert b.cursor == 4
    b.apply("MOVE_END", extend=True)
    assert b.apply("COPY") == "two"
    b.apply("INSERT", "X")
    assert b.text == "one X"


def test_entities_once_in_order():
    assert text_entities("CON-12345 12345 a@b.example 9876 CON-12345") == [{"type": "ID_CANDIDATE", "value": "CON-12345"}, {"type": "EMAIL", "value": "a@b.example"}, {"type": "NUMBER_CANDIDATE", "value": "12345"}, {"type": "NUMBER_CANDIDATE", "value": "9876"}]


def test_spark_equals_fold(spark):
    events = [*keys("hello"), ev(9, 900, "click"), *keys("again", 3000), ev(3100, 3100, "screenshot", screen="again"), *keys("later", 90_000)]
    rows = [(e["event_id"], s, e["timestamp_ms"], e["timestamp_iso"], e["event_type"], json.dumps(e["payload"]), json.dumps(e["context"]), json.dumps(e["correlation"])) for s in ("s", "t") for e in events]
    df = spark.createDataFrame(rows[::-1], "event_id string, session_id string, timestamp_ms long, timestamp_iso string, event_type string, payload string, context string, correlation string")
    got = sorted((r.session_id, r.activity_id, r.type, r.text, r.verification_status) for r in build_activities(df).collect())
    want = sorted((s, a["activity_id"], a["type"], a["text"], a["verification_status"]) for s in ("s", "t") for a in build(events, s))
    assert got == want
    assert build_activities(df.limit(0)).count() == 0


def test_declarative_echoes(spark):
    from opweave.operators.activity_builder import mark_echoes

    rows = [("s", "e0", 0, 0, "keystroke", "v", "f", True), ("s", "e1", 1, 1, "shortcut", None, None, False), ("s", "e2", 2, 2, "keystroke", "v", "f", False), ("s", "e3", 40, 3, "keystroke", "v", "f", False), ("s", "e4", 41, 4, "keystroke", "x", "f", True), ("s", "e5", 60, 5, "keystroke", "x", "f", False)]
    df = spark.createDataFrame(rows, "session_id string, event_id string, timestamp_ms long, seq long, event_type string, key string, target string, command boolean")
    assert {r.event_id for r in mark_echoes(df).filter("echo").collect()} == {"e2"}


def test_listed_keystrokes_swallow_their_echo():
    e = [ev(0, 0, key="a", char="a"), ev(1, 4, key="a", char="a"), ev(2, 30, key="b", char="b"), ev(3, 500, "text_input_complete", payload={"related_keystrokes": ["e0", "e2"], "final_text": "ab"})]
    got = build(e, "s")
    assert [a["text"] for a in got] == ["ab"] and got[0]["verification_status"] == "VERIFIED_INPUT_COMPLETE"


def test_reconciled_needs_two_values():
    """Screens that merely show the text never count towards RECONCILED."""
    assert reconcile("x", [], ["x"], [], ["see x"]) == "VERIFIED_BROWSER"
    assert reconcile("x", ["x"], [], [], ["see x"]) == "VERIFIED_INPUT_COMPLETE"
    assert reconcile("x", [], ["x"], ["x"], []) == "RECONCILED"


def test_late_evidence():
    base = [*keys("inv"), ev(49, 49, key="Enter")]
    late = build([*base, ev(900, 900, "screenshot_smart", screen="see inv"), ev(950, 950, "screenshot_smart", screen="a@b.example")], "s")[0]
    assert late["screen_text"] == "see inv a@b.example" and {"type": "EMAIL", "value": "a@b.example"} in late["entities"]


def test_undo_stack_is_linear():
    from opweave.operators.text_engine import TextBuffer

    b = TextBuffer()
    for i in range(6_000):
        b.apply("INSERT", "ab"[i % 2])
    assert sum(len(old) + len(new) for _, old, new, *_ in b.undo) == 6_000
    whole = b.text
    b.apply("SELECT_ALL")
    b.apply("CUT")
    assert b.text == ""
    b.apply("UNDO")
    assert b.text == whole and b.selection == (0, 6_000)
    for _ in range(10):
        b.apply("UNDO")
    assert b.text == whole[:-10]
    for _ in range(11):
        b.apply("REDO")
    assert b.text == ""
