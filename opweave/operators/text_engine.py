"""Order-dependent core of activity rebuilding: key normalisation, text buffer, evidence, builder.

Everything here is a fold over one session's events in order; state is the open text run,
the clipboard and the last few signatures, so a session of any length streams through.
"""
from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

# fixed values: thresholds in ms, names of keys and of their combinations
ECHO_MS, LOOSE_ECHO_MS, RUN_GAP_MS, OCR_MS, COPY_MS = 10, 50, 30_000, 2_500, 1_000
ALIASES = {"return": "enter", "esc": "escape", "del": "delete", "arrowleft": "left", "arrowright": "right", "arrowup": "up", "arrowdown": "down", "spacebar": "space", "control": "ctrl"}
PLAIN_KEYS = {"backspace": "BACKSPACE", "delete": "DELETE", "enter": "ENTER", "tab": "TAB", "escape": "ESCAPE", "left": "MOVE_LEFT", "right": "MOVE_RIGHT", "up": "MOVE_UP", "down": "MOVE_DOWN", "home": "MOVE_HOME", "end": "MOVE_END"}
COMBOS = {
    "ctrl+a": "SELECT_ALL", "ctrl+c": "COPY", "ctrl+x": "CUT", "ctrl+v": "PASTE", "ctrl+z": "UNDO", "ctrl+y": "REDO", "ctrl+shift+z": "REDO", "ctrl+backspace": "DELETE_WORD_BACK",
    "ctrl+left": "MOVE_WORD_LEFT", "ctrl+right": "MOVE_WORD_RIGHT",
}
# fixed values: recorder event types
EVENT_OPS = {
    "app_switch": "APP_SWITCH", "mouse_click": "CLICK", "mouse_double_click": "CLICK", "browser_click": "CLICK", "click": "CLICK", "mouse_scroll": "SCROLL", "mouse_drag_drop": "DRAG", "clipboard_change": "CLIPBOARD",
    "text_input_complete": "INPUT_COMPLETE", "browser_form_input": "BROWSER_VALUE", "window_title_change": "SCREEN", "window_state_change": "SCREEN", "screenshot_smart": "SCREEN", "screenshot": "SCREEN",
    "dialog_opened": "DIALOG_OPEN", "dialog_closed": "DIALOG_CLOSE", "browser_navigation": "NAVIGATE", "browser_tab_event": "NAVIGATE", "browser_alert": "OTHER_EVENT", "browser_error": "OTHER_EVENT",
    "session_start": "SYSTEM", "session_end": "SYSTEM", "extension_connected": "SYSTEM", "extension_disconnected": "SYSTEM", "upload_started": "SYSTEM", "upload_completed": "SYSTEM", "upload_failed": "SYSTEM", "shortcut": "SHORTCUT_ROW",
}
# fixed values: sources whose extracted text is the value of a field
FIELD_SOURCES = ("text_input", "browser_form_input", "accessibility", "field_value")
TEXT_OPS = {"INSERT", "BACKSPACE", "DELETE", "DELETE_WORD_BACK", "SELECT_ALL", "COPY", "CUT", "PASTE", "UNDO", "REDO"} | {f"MOVE_{x}" for x in ("LEFT", "RIGHT", "UP", "DOWN", "HOME", "END", "WORD_LEFT", "WORD_RIGHT")}
OPENING = {"INSERT", "BACKSPACE", "DELETE", "DELETE_WORD_BACK", "CUT", "PASTE"}
CLIPBOARD_KEYS = ("content", "new_content", "text", "new_value", "value", "data")


def get(e: Any, *path: str) -> Any:
    """Nested value or None."""
    for p in path:
        e = e.get(p) if isinstance(e, dict) else None
    return e


def modifiers(e: dict) -> set[str]:
    m = get(e, "payload", "modifiers")
    names = [k for k, v in m.items() if v] if isinstance(m, dict) else m if isinstance(m, list) else []
    return {"win" if n in ("win", "meta", "super", "cmd") else ALIASES.get(n, n) for n in (str(x).lower() for x in names)}


def key_name(e: dict) -> str:
    k = str(get(e, "payload", "key") or "").lower()
    return ALIASES.get(k, k) or str(get(e, "payload", "character") or "").lower()


def command(e: dict) -> bool:
    return bool(modifiers(e) & {"ctrl", "alt", "win"})


def signature(e: dict) -> tuple:
    """What a text run is bound to: application, window and field."""
    f = get(e, "payload", "target_field")
    f = tuple(f.get(k) for k in ("automation_id", "class_name", "control_type", "name")) if isinstance(f, dict) else (f,)
    return get(e, "context", "active_app", "app_name"), get(e, "context", "active_app", "window_title"), f


def printable(e: dict) -> bool:
    c = get(e, "payload", "character")
    return isinstance(c, str) and len(c) == 1 and c.isprintable() and key_name(e) not in PLAIN_KEYS


@dataclass
class Op:
    kind: str
    event: dict
    ids: list[str]
    char: str = ""
    extend: bool = False
    label: str | None = None


def _seq(e: dict) -> int | None:
    return get(e, "correlation", "sequence_number")


def _adjacent(a: dict, b: dict) -> bool:
    return _seq(a) is None or _seq(b) is None or _seq(b) == _seq(a) + 1


def linked_echoes(events: list[dict]) -> set[str]:
    """Release echoes of keystrokes that a text_input_complete lists: first later, unlisted, printable keystroke on the same target within 10 ms."""
    keys = {e["event_id"]: i for i, e in enumerate(events) if e["event_type"] == "keystroke"}
    related: set[str] = set()
    out: set[str] = set()
    for e in events:
        if e["event_type"] != "text_input_complete":
            continue
        ids = [i for i in get(e, "payload", "related_keystrokes") or [] if i in keys]
        related.update(ids)
        for i in ids:
            k = events[keys[i]]
            for c in events[keys[i] + 1 :]:
                gap = c["timestamp_ms"] - k["timestamp_ms"]
                if gap > ECHO_MS:
                    break
                if gap >= 0 and c["event_type"] == "keystroke" and c["event_id"] not in related and printable(c) and signature(c) == signature(k):
                    out.add(c["event_id"])
                    break
    return out


def command_echoes(events: list[dict]) -> set[str]:
    """Unmodified keystrokes that follow a command combination of the same key and target within 10 ms, shortcut rows between ignored."""
    out: set[str] = set()
    for i, e in enumerate(events):
        if e["event_type"] != "keystroke" or not command(e):
            continue
        c = next((x for x in events[i + 1 :] if x["event_type"] != "shortcut"), None)
        if c is None or c["event_type"] != "keystroke" or command(c) or key_name(c) != key_name(e) or signature(c) != signature(e):
            continue
        after = _seq(e) is None or _seq(c) is None or _seq(c) >= _seq(e) + 1
        if 0 <= c["timestamp_ms"] - e["timestamp_ms"] <= ECHO_MS and after:
            out.add(c["event_id"])
    return out


def _is_echo(c: dict, used: list[dict]) -> bool:
    last = used[-1]
    gap = c["timestamp_ms"] - last["timestamp_ms"]
    link = get(c, "correlation", "triggered_by")
    if link:
        return link in {u["event_id"] for u in used} or 0 <= gap <= ECHO_MS and _adjacent(last, c)
    ms = get(c, "correlation", "ms_since_last_event")
    return (gap if ms is None else ms) <= LOOSE_ECHO_MS and _adjacent(last, c)


def normalize(events: list[dict]) -> list[Op]:
    """Raw events to operations, in order; echoes consumed."""
    drop_linked, drop_command = linked_echoes(events), command_echoes(events)
    listed = {i for e in events for i in (get(e, "payload", "related_keystrokes") or [] if e["event_type"] == "text_input_complete" else [])}
    ops: list[Op] = []
    i = 0
    while i < len(events):
        e = events[i]
        i += 1
        if e["event_type"] != "keystroke":
            kind = EVENT_OPS.get(e["event_type"], "OTHER_EVENT")
            if kind != "SHORTCUT_ROW":
                ops.append(Op(kind, e, [e["event_id"]]))
            continue
        if e["event_id"] in drop_linked:
            continue
        mods, key = modifiers(e), key_name(e)
        if e["event_id"] in drop_command:
            continue
        if command(e):
            if key in ("ctrl", "alt", "shift", "win"):
                continue
            used = [e]
            while i < len(events) and events[i]["event_type"] == "shortcut":
                used.append(events[i])
                i += 1
            if i < len(events):
                c = events[i]
                close = c["event_type"] == "keystroke" and not command(c) and key_name(c) == key and (c["event_id"] in drop_command or _is_echo(c, used))
                if close:
                    used.append(c)
                    i += 1
            label = "+".join([*sorted(mods), key])
            ops.append(Op(COMBOS.get(label, "SHORTCUT"), e, [u["event_id"] for u in used], label=label))
            continue
        ids = [e["event_id"]]
        if "shift" in mods and e["event_id"] not in listed and i < len(events):
            c = events[i]
            if c["event_type"] == "keystroke" and not modifiers(c) and key_name(c) == key and _is_echo(c, [e]):
                ids.append(c["event_id"])
                i += 1
        if key in PLAIN_KEYS:
            ops.append(Op(PLAIN_KEYS[key], e, ids, extend="shift" in mods))
        elif printable(e):
            ops.append(Op("INSERT", e, ids, char=get(e, "payload", "character")))
    return ops


@dataclass
class TextBuffer:
    """Buffer, cursor, selection and undo stacks of one text run."""

    text: str = ""
    cursor: int = 0
    selection: tuple[int, int] | None = None
    undo: list = field(default_factory=list)
    redo: list = field(default_factory=list)
    undo_used: bool = False
    paste_unknown: bool = False

    def _replace(self, a: int, b: int, new: str) -> str:
        """One edit; the undo stack keeps what it changed, not the text."""
        old = self.text[a:b]
        self.undo.append((a, old, new, self.cursor, self.selection))
        self.redo.clear()
        self.text = self.text[:a] + new + self.text[b:]
        self.cursor, self.selection = a + len(new), None
        return old

    def _span(self) -> tuple[int, int]:
        return tuple(sorted(self.selection)) if self.selection is not None else (self.cursor, self.cursor)

    def _word(self, step: int) -> int:
        i, n, t = self.cursor, len(self.text), self.text
        inside = (lambda k: k > 0) if step < 0 else (lambda k: k < n)
        at = (lambda k: t[k - 1]) if step < 0 else (lambda k: t[k])
        while inside(i) and at(i) == " ":
            i += step
        while inside(i) and at(i) != " ":
            i += step
        return i

    def apply(self, kind: str, char: str = "", extend: bool = False, clipboard: str | None = None) -> str | None:
        """Applies one operation; returns the text that COPY or CUT took."""
        if kind == "INSERT":
            self._replace(*self._span(), char)
        elif kind in ("BACKSPACE", "DELETE", "DELETE_WORD_BACK"):
            if self.selection is not None:
                self._replace(*self._span(), "")
            else:
                a = self._word(-1) if kind == "DELETE_WORD_BACK" else self.cursor - (kind == "BACKSPACE")
                self._replace(max(a, 0), self.cursor + (kind == "DELETE"), "")
        elif kind.startswith("MOVE_"):
            to = {"LEFT": max(0, self.cursor - 1), "RIGHT": min(len(self.text), self.cursor + 1), "HOME": 0, "END": len(self.text)}.get(kind[5:], self.cursor)
            if kind.startswith("MOVE_WORD"):
                to, extend = self._word(-1 if kind.endswith("LEFT") else 1), False
            self.selection = ((self.selection[0] if self.selection else self.cursor), to) if extend else None
            self.cursor = to
        elif kind == "SELECT_ALL":
            self.selection, self.cursor = (0, len(self.text)), len(self.text)
        elif kind == "COPY":
            if self.selection is not None:
                a, b = sorted(self.selection)
                return self.text[a:b]
        elif kind == "CUT":
            return self._replace(*self._span(), "")
        elif kind == "PASTE":
            if clipboard is None:
                self.paste_unknown = True
                self.undo.append((self.cursor, "", "", self.cursor, self.selection))
                self.redo.clear()
            else:
                self._replace(*self._span(), clipboard)
        elif kind in ("UNDO", "REDO"):
            take, give = (self.undo, self.redo) if kind == "UNDO" else (self.redo, self.undo)
            self.undo_used |= kind == "UNDO"
            if take:
                a, old, new, cursor, selection = take.pop()
                give.append((a, new, old, self.cursor, self.selection))
                self.text = self.text[:a] + old + self.text[a + len(new) :]
                self.cursor, self.selection = cursor, selection
        return None


def reconcile(text: str, complete: list[str], browser: list[str], targeted: list[str], screen: list[str]) -> str:
    """Verification status: no evidence says nothing, any equal value confirms, otherwise it contradicts; two that confirm reconcile; screens can only confirm."""
    match = lambda vs: None if not vs else any(v == text for v in vs)
    a, b, c = match(complete), match(browser), match(targeted)
    seen = bool(text) and any(text in s for s in screen)
    if False in (a, b, c):
        return "CONFLICT"
    if sum(x is True for x in (a, b, c)) >= 2:
        return "RECONCILED"
    return "VERIFIED_INPUT_COMPLETE" if a else "VERIFIED_BROWSER" if b else "VERIFIED_SCREEN" if c or seen else "RECONSTRUCTED"


ENTITY_PATTERNS = (
    ("ID_CANDIDATE", re.compile(r"\b[A-Z]{2,5}-\d{4,}(?:-\d+)?\b")), ("EMAIL", re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")), ("FILENAME", re.compile(r"\b[\w.-]+\.(?:xlsx|csv|pdf|docx|txt)\b")), ("URL", re.compile(r"https?://[^\s]+")),
)


def text_entities(text: str) -> list[dict[str, str]]:
    """Typed entities in order, each once; numbers of four or more digits outside ids."""
    out: dict[tuple[str, str], None] = {}
    spans = []
    for kind, p in ENTITY_PATTERNS:
        for m in p.finditer(text or ""):
            out[(kind, m.group())] = None
            if kind == "ID_CANDIDATE":
                spans.append(m.span())
    for m in re.finditer(r"\b\d{4,}\b", text or ""):
        if not any(a <= m.start() < b for a, b in spans):
            out[("NUMBER_CANDIDATE", m.group())] = None
    return [{"type": k, "value": v} for k, v in out]


def _screen_text(e: dict) -> str | None:
    t = get(e, "context", "extracted_text")
    t = t.get("text") if isinstance(t, dict) else t
    return t if isinstance(t, str) and t else None


def _field_text(e: dict) -> str | None:
    """Extracted text that is a field's value: of a trusted source, or a compact one-line pattern."""
    x = get(e, "context", "extracted_text")
    t, source = get(x, "text"), get(x, "source")
    if not isinstance(t, str) or not t:
        return None
    compact = source == "text_pattern" and len(t) <= 256 and "\n" not in t and "\r" not in t
    return t if source in FIELD_SOURCES or compact else None


def clipboard_content(e: dict) -> str | None:
    p = get(e, "payload") or {}
    for level in (p, get(p, "new"), get(p, "to"), get(p, "after")):
        for k in CLIPBOARD_KEYS:
            v = get(level, k)
            if isinstance(v, str):
                return v
    return None


class Builder:
    """Folds operations of one session into activities; feed() in order, then finish()."""

    def __init__(self, session: str) -> None:
        self.session, self.n = session, 0
        self.run: dict | None = None
        self.recent: dict | None = None
        self.clipboard: str | None = None
        self.last_copy: int | None = None
        self.last_switch: tuple | None = None
        self.dialog: dict | None = None

    def _activity(self, kind: str, first: dict, last: dict, ids: list[str], **more: Any) -> dict:
        self.n += 1
        f = get(first, "payload", "target_field")
        c = lambda *p: get(first, "context", *p)
        a = {
            "activity_id": f"act_{self.session}_{self.n:06d}", "session_id": self.session, "start": first["timestamp_iso"], "end": last["timestamp_iso"], "start_ms": first["timestamp_ms"], "type": kind,
            "app": c("active_app", "app_name"), "window": c("active_app", "window_title"), "browser_tab": c("active_browser_tab", "title"), "browser_url": c("active_browser_tab", "url"),
            "target_field": json.dumps(f, ensure_ascii=False, sort_keys=True) if isinstance(f, dict) else f, "text": None, "screen_text": None, "entities": [], "source_event_ids": list(dict.fromkeys(ids)), "triggered_by": [],
            "source_event_types": [first["event_type"]] if first is last else sorted({first["event_type"], last["event_type"]}), "chunk_ids": sorted({c for c in (get(first, "correlation", "chunk_id"), get(last, "correlation", "chunk_id")) if isinstance(c, str)}),
            "browser_value": None, "screen_value": None, "input_complete_value": None, "verification_status": None, "undo_used": False, "paste_content_unknown": False, "input_complete_count": 0,
        }
        return a | more

    def _close(self) -> Iterator[dict]:
        r, self.run = self.run, None
        if r is None:
            return
        b: TextBuffer = r["buffer"]
        a = self._activity("TEXT_ENTRY", r["first"], r["last"], r["ids"], text=b.text, undo_used=b.undo_used, paste_content_unknown=b.paste_unknown, input_complete_count=len(r["complete"]), source_event_types=sorted(r["types"]), chunk_ids=sorted(r["chunks"]))
        a |= self._evidence(b.text, r)
        self.recent = {"activity": a, "at": r["last"]["timestamp_ms"], "sig": r["sig"], "run": r}
        yield a

    @staticmethod
    def _evidence(text: str, r: dict) -> dict:
        """What the evidence of a run says: status, last values, all screen texts, entities of text and screens."""
        screen = " ".join(r["screen"])
        last = lambda k: r[k][-1] if r[k] else None
        return {
            "verification_status": reconcile(text, r["complete"], r["browser"], r["targeted"], r["screen"]), "browser_value": last("browser"), "screen_value": last("targeted"), "input_complete_value": last("complete"),
            "screen_text": screen or None, "entities": text_entities(f"{text}\n{screen}" if screen else text),
        }

    def _used(self, op: Op) -> None:
        """The operation's events belong to the open run."""
        r = self.run
        r["ids"].extend(op.ids)
        r["types"].add(op.event["event_type"])
        chunk = get(op.event, "correlation", "chunk_id")
        if isinstance(chunk, str):
            r["chunks"].add(chunk)

    def feed(self, op: Op) -> Iterator[dict]:
        """Activities that this operation completes."""
        e, now = op.event, op.event["timestamp_ms"]
        if op.kind in TEXT_OPS:
            sig = signature(e)
            if self.run and (self.run["sig"] != sig or now - self.run["last"]["timestamp_ms"] > RUN_GAP_MS):
                yield from self._close()
            if self.run is None:
                if op.kind not in OPENING or op.kind == "PASTE" and self.clipboard is None:
                    return
                self.run = {"buffer": TextBuffer(), "sig": sig, "first": e, "last": e, "ids": [], "complete": [], "browser": [], "targeted": [], "screen": [], "types": set(), "chunks": set()}
            took = self.run["buffer"].apply(op.kind, op.char, op.extend, self.clipboard)
            self.run["last"] = e
            self._used(op)
            if took is not None:
                self.last_copy = now
                if self.clipboard is None:
                    self.clipboard = took
            return
        if op.kind in ("ENTER", "TAB", "ESCAPE"):
            if self.run:
                self.run["last"] = e
                self._used(op)
                yield from self._close()
        elif op.kind == "CLICK":
            yield from self._close()
            element = get(e, "payload", "element")
            yield self._activity("CLICK", e, e, op.ids, target_field=json.dumps(element, ensure_ascii=False, sort_keys=True) if isinstance(element, dict) else element)
        elif op.kind == "APP_SWITCH":
            if self.run:
                if (get(e, "context", "active_app", "app_name"), get(e, "context", "active_app", "window_title")) == self.run["sig"][:2]:
                    return
                yield from self._close()
            else:
                self._late_screen(e, now)
            sig = (json.dumps(get(e, "payload", "new_app"), sort_keys=True), get(e, "context", "active_app", "window_title"))
            if sig != self.last_switch:
                self.last_switch = sig
                yield from self._close_dialog(e)
                before = get(e, "payload", "previous_app")
                yield self._activity("APP_SWITCH", e, e, op.ids, triggered_by=[before if isinstance(before, str) else json.dumps(before, sort_keys=True)] if before else [])
        elif op.kind == "NAVIGATE":
            yield from self._close()
            yield self._activity("NAVIGATE", e, e, op.ids)
        elif op.kind in ("SCROLL", "DRAG", "OTHER_EVENT", "SYSTEM"):
            a = self._activity("SCROLL" if op.kind == "SCROLL" else "OTHER", e, e, op.ids)
            yield a | ({"app": None, "window": None} if op.kind == "SYSTEM" else {})
        elif op.kind == "DIALOG_OPEN":
            yield from self._close_dialog(e)
            self.dialog = {"first": e, "ids": op.ids}
        elif op.kind == "DIALOG_CLOSE":
            if self.dialog:
                first, ids = self.dialog["first"], self.dialog["ids"] + op.ids
                self.dialog = None
                yield self._activity("DIALOG", first, e, ids)
        elif op.kind == "CLIPBOARD":
            content = clipboard_content(e)
            self.clipboard = content if content is not None else self.clipboard
            if self.last_copy is None or now - self.last_copy > COPY_MS:
                yield self._activity("COPY", e, e, op.ids, text=content)
        elif op.kind in ("BROWSER_VALUE", "INPUT_COMPLETE"):
            v = next((x for k in (("value",) if op.kind == "BROWSER_VALUE" else ("final_text", "value")) if isinstance(x := get(e, "payload", k), str)), None)
            if self.run and v is not None:
                self.run["browser" if op.kind == "BROWSER_VALUE" else "complete"].append(v)
                self._used(op)
        elif op.kind == "SHORTCUT":
            yield from self._close()
            if op.label:
                yield self._activity("SHORTCUT", e, e, op.ids, text=op.label)
        elif op.kind == "SCREEN":
            t = _screen_text(e)
            if t and self.run:
                self.run["screen"].append(t)
                self.run["targeted"] += [f for f in (_field_text(e),) if f]
                self._used(op)
            elif t:
                self._late_screen(e, now)

    def _late_screen(self, e: dict, now: int) -> None:
        """A screen text soon after a run closed still counts for it, on the same application, window and field."""
        r, t = self.recent, _screen_text(e)
        if not r or not t or not 0 <= now - r["at"] <= OCR_MS:
            return
        sig, own = signature(e), r["sig"]
        if any(x and y and x != y for x, y in zip(sig[:2], own[:2])):
            return
        if any(sig[2]) and any(own[2]) and sig[2] != own[2]:
            return
        run, a = r["run"], r["activity"]
        run["screen"].append(t)
        run["targeted"] += [f for f in (_field_text(e),) if f]
        a |= self._evidence(a["text"], run)
        a["source_event_ids"] = list(dict.fromkeys([*a["source_event_ids"], e["event_id"]]))

    def _close_dialog(self, e: dict) -> Iterator[dict]:
        d, self.dialog = self.dialog, None
        if d:
            yield self._activity("DIALOG", d["first"], e, d["ids"])

    def finish(self) -> Iterator[dict]:
        """End of the session: an unclosed dialog ends where it starts."""
        yield from self._close()
        if self.dialog:
            d, self.dialog = self.dialog, None
            yield self._activity("DIALOG", d["first"], d["first"], d["ids"])


def build(events: list[dict], session: str) -> list[dict]:
    """All activities of one session, ordered by (start, activity_id)."""
    b = Builder(session)
    out = [a for op in normalize(sorted(events, key=event_order)) for a in b.feed(op)]
    out += b.finish()
    return sorted(out, key=lambda a: (a["start"], a["activity_id"]))


def event_order(e: dict) -> tuple:
    return e["timestamp_ms"], _seq(e) or 0, e["event_id"]
