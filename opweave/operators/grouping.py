"""State machines, one-to-one matching and greedy grouping of activities."""
from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from opweave.functions import text as T
from opweave.operators.sequences import CLOSE_S, EDGE_WEIGHTS, LARGE_GAP_S
from opweave.plans.sequence import sequence
from opweave.session import micros

CLOSING = ("process_switched_out", "process_suspended", "session_ended")


def process_segments(log: DataFrame, entity: str, time: str, key: str) -> DataFrame:
    """Segments of a process log: (entity, process, case_id, start_us, end_us, end_event).

    log: ``entity``, ``time``, ``key``, event, process, case_id.  process_started is ignored while the same
    process and case is active, else it closes what is active and opens; process_resumed does so with no
    case; both are ignored without a process; closing events close.  The next event ends a segment; nothing is made up at the end of the log;
    segments without duration are dropped, closings without an active process do nothing."""
    from opweave.session import micros

    opens = F.col("event").isin("process_started", "process_resumed")
    events = log.filter(F.col("event").isin(*CLOSING) | opens & F.col("process").isNotNull())
    case = F.when(F.col("event") == "process_started", F.col("case_id"))
    x = events.withColumn("state", F.when(opens, F.struct(F.col("process").alias("process"), case.alias("case_id")))).withColumn("us", micros(time))
    y, w = sequence(x, entity, time, key)
    y = y.withColumn("before", F.lag("state").over(w)).filter("own")
    again = (F.col("event") == "process_started") & F.col("before").isNotNull() & F.col("before").eqNullSafe(F.col("state"))
    y = y.filter(~again).drop("pos", "chunk", "own")
    z, w = sequence(y, entity, time, key, back=0, ahead=1)
    z = z.withColumn("end_us", F.lead("us").over(w)).withColumn("end_event", F.lead("event").over(w)).filter("own and state is not null and end_us > us")
    return z.select(entity, F.col("state.process").alias("process"), F.col("state.case_id").alias("case_id"), F.col("us").alias("start_us"), "end_us", "end_event")


def match_one_to_one(a: DataFrame, b: DataFrame, keys: list[str], a_order: list[str], b_order: list[str]) -> DataFrame:
    """Full outer join that pairs the k-th row of a with the k-th of b inside equal keys; leftovers of both sides stay."""
    ra = a.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*a_order)).cast("long"))
    rb = b.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*b_order)).cast("long"))
    return ra.join(rb, [*keys, "k"], "full_outer")


def best_links(edges: DataFrame, strong_s: float = 300, context_s: float = 12, least_score: int = 3) -> DataFrame:
    """(session_id, b_pos, a_pos): the best earlier link of each activity that is near enough.

    edges: session_id, a_pos < b_pos, score, gap_s, strong (boolean).  Strong links bridge ``strong_s``,
    others need ``least_score`` and ``context_s``; strong before score before recency."""
    ok = edges.filter((F.col("strong") & (F.col("gap_s") <= strong_s)) | ((F.col("score") >= least_score) & (F.col("gap_s") <= context_s)))
    return ok.groupBy("session_id", "b_pos").agg(F.max_by("a_pos", F.struct(F.col("strong").cast("int"), "score", "a_pos")).alias("a_pos"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    session, seen, n = None, {}, 0
    for b in batches:
        out = []
        for s, p, a, until in zip(*(b.column(c).to_pylist() for c in ("session_id", "pos", "a_pos", "until"))):
            if s != session:
                session, seen, n = s, {}, 0
            g = None
            if a is not None:
                g, last = seen[a]
                if last == p:  # no later link asks for this place
                    del seen[a]
            if g is None:
                n += 1
                g = n
            if until is not None:
                seen[p] = g, until
            out.append(g)
        yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(out, pa.int64()), b.column("activity_id")], names=["session_id", "pos", "grp", "activity_id"])


def greedy_groups(acts: DataFrame, links: DataFrame) -> DataFrame:
    """Each activity joins the group of its best earlier link or begins one: (session_id, pos, grp, activity_id).

    acts: session_id, pos, activity_id; links: session_id, a_pos < b_pos, one for each b_pos.  A session streams
    through its task in order; the state is the groups of the places that a later link asks for, each until its last."""
    l = links.select(F.col("session_id").alias("ls"), "b_pos", "a_pos")
    last = links.groupBy(F.col("session_id").alias("us"), F.col("a_pos").alias("up")).agg(F.max("b_pos").alias("until"))
    x = acts.join(l, (F.col("session_id") == F.col("ls")) & (F.col("pos") == F.col("b_pos")), "left").join(last, (F.col("session_id") == F.col("us")) & (F.col("pos") == F.col("up")), "left")
    x = x.select("session_id", "pos", "a_pos", "activity_id", "until")
    return x.repartition("session_id").sortWithinPartitions("session_id", "pos").mapInArrow(_groups, "session_id string, pos bigint, grp bigint, activity_id string")


# fixed values: reach of the candidates (near, in seconds and places; next holders of a value, in a session with at most so many) and of the links
NEAR_S, NEAR_ROWS, HOLDERS, MOST_HOLDERS = 45, 20, 5, 200
STRONG_S, CONTEXT_S, LEAST_SCORE = 300, 12, 3
_TEXTS = ("app", "window", "browser_tab", "text")
_LINKED = "session_id string, grp bigint, n_activities bigint, first_activity string"


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(session_id, value) of every entity; the batches are whole, so that this reads the exchange that the links read."""
    for b in batches:
        ents = b.column("ents")
        at = pc.list_parent_indices(ents)
        yield pa.RecordBatch.from_arrays([b.column("session_id").take(at), pc.list_flatten(ents)], names=["session_id", "value"])


class _Place:
    """What later activities of a session ask of an earlier one."""

    __slots__ = ("pos", "us", "texts", "ents", "ids", "refs", "group")

    def __init__(self, pos: int | None, us: int, texts: tuple, ents: list[str], ids: list[str], refs: list[str]):
        self.pos, self.us, self.texts, self.ents, self.ids, self.refs, self.group = pos, us, texts, ents, ids, refs, None


class _Links:
    """The open groups of a session whose activities come in order of (start, id); holds what began in the last STRONG_S seconds."""

    def __init__(self, session: str):
        self.session, self.pos, self.groups = session, 0, 0
        self.common: set[str] = set()
        self.places: deque[_Place] = deque()
        self.near: deque[_Place] = deque(maxlen=NEAR_ROWS)
        self.holders: dict[str, deque[_Place]] = {}
        self.ids: dict[str, deque[_Place]] = {}
        self.refs: dict[str, deque[_Place]] = {}
        self.done: list[tuple] = []

    def _forget(self, before: int) -> None:
        while self.places and self.places[0].us < before:
            p = self.places.popleft()
            for held, keys in ((self.holders, p.ents), (self.ids, p.ids), (self.refs, p.refs)):
                for k in keys:
                    if (q := held.get(k)) and q[0] is p:
                        q.popleft()
                        if not q:
                            del held[k]
            if (g := p.group) is not None:
                g[1] -= 1
                if not g[1]:
                    self.done.append((self.session, g[0], g[2], g[3]))

    def feed(self, key: str | None, us: int, texts: tuple, ents: list[str], ids: list[str], refs: list[str]) -> None:
        self._forget(us - STRONG_S * 1_000_000)
        if key is None:  # no activity, but a holder of its values
            self._hold(_Place(None, us, texts, ents, [], []))
            return
        p = _Place(self.pos, us, texts, ents, ids, refs)
        best = self._strong(p) or self._context(p)
        if best is None:
            self.groups += 1
            p.group = [self.groups, 1, 1, key]  # number, members held, members, least id
        else:
            p.group = g = best.group
            g[1] += 1
            g[2] += 1
            g[3] = min(g[3], key)
        self._hold(p)
        self.near.append(p)
        self.pos += 1

    def _hold(self, p: _Place) -> None:
        self.places.append(p)
        for v in p.ents:
            if (q := self.holders.get(v)) is None:
                q = self.holders[v] = deque()
            elif len(q) > NEAR_ROWS:  # neither near nor one of the last holders; one may be without id
                q.popleft()
            q.append(p)
        for held, keys in ((self.ids, p.ids), (self.refs, p.refs)):
            for k in keys:
                held.setdefault(k, deque()).append(p)

    def _strong(self, p: _Place) -> _Place | None:
        found: dict[int, tuple[_Place, bool]] = {}
        for v in p.ents:
            q = self.holders.get(v, ())
            last = len(q) - HOLDERS if v not in self.common else len(q)
            for i, x in enumerate(q):
                if x.pos is not None and (i >= last or p.pos - x.pos <= NEAR_ROWS and p.us - x.us <= NEAR_S * 1_000_000):
                    found[x.pos] = x, False
        for mine, held in ((p.refs, self.ids), (p.ids, self.refs)):
            for k in mine:
                for x in held.get(k, ()):
                    found[x.pos] = x, True
        best, top = None, None
        for x, trig in found.values():
            s = self._score(p, x, trig)
            if top is None or (s, x.pos) > top:
                best, top = x, (s, x.pos)
        return best

    def _context(self, p: _Place) -> _Place | None:
        best, top = None, LEAST_SCORE - 1
        for x in reversed(self.near):  # the later of equal scores comes first
            if p.us - x.us > CONTEXT_S * 1_000_000:
                break
            if (s := self._score(p, x, False)) > top:
                best, top = x, s
        return best

    def _score(self, p: _Place, x: _Place, trig: bool) -> int:
        w, (app, window, tab, text), (x_app, x_window, x_tab, x_text) = EDGE_WEIGHTS, p.texts, x.texts
        s = w["triggered_by"] if trig else 0
        if p.ents and x.ents and not set(p.ents).isdisjoint(x.ents):
            s += w["same_entity"]
        if app and app == x_app:
            s += w["same_app"]
        if window and window == x_window:
            s += w["same_window"]
        if tab and tab == x_tab:
            s += w["same_browser_tab"]
        if len(text) >= 4 and len(x_text) >= 4 and (text in x_text or x_text in text):
            s += w["semantic_match"]
        gap = p.us - x.us
        return s + (w["close_in_time"] if gap <= CLOSE_S * 1_000_000 else 0) + (w["large_time_gap"] if gap > LARGE_GAP_S * 1_000_000 else 0)

    def ended(self) -> list[tuple]:
        out, self.done = self.done, []
        return out

    def finish(self) -> list[tuple]:
        self._forget(self.places[-1].us + 1 if self.places else 0)
        return self.ended()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    names = [c.split(" ")[0] for c in _LINKED.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    at: _Links | None = None
    for b in batches:
        out: list[tuple] = []
        for session, us, key, *texts, ents, ids, refs in zip(*(b.column(c).to_pylist() for c in ("session_id", "us", "activity_id", *_TEXTS, "ents", "ids", "refs"))):
            if at is None or session != at.session:
                if at is not None:
                    out += at.finish()
                at = _Links(session)
            if us is None:
                at.common.update(ents)
            else:
                at.feed(key, us, tuple(texts), ents, ids, refs)
        yield batch(out + at.ended() if at is not None else out)
    if at is not None:
        yield batch(at.finish())


def linked_groups(acts: DataFrame) -> DataFrame:
    """(session_id, grp, n_activities, first_activity): ``greedy_groups`` by the ``best_links`` of scored candidates, no pair being written.

    acts: each activity_id once, with session_id, start, app, window, browser_tab, text, entities, source_event_ids
    and triggered_by.  No link is longer than STRONG_S, so a session streams through its task in order and the state is what
    began in that time; a group is given out when its last member is left behind.  Rows pass two exchanges; values
    with more than MOST_HOLDERS holders in a session come ahead of its activities."""
    some = lambda c: F.coalesce(F.filter(c, lambda v: v.isNotNull()), F.array().cast("array<string>"))
    text = {c: F.coalesce(T.casefold(F.trim(c)), F.lit("")).alias(c) for c in _TEXTS}
    ids = F.array_distinct(F.concat(F.array("activity_id"), some(F.col("source_event_ids"))))
    a = acts.filter("session_id is not null").select("session_id", micros("start").alias("us"), "activity_id", *text.values(), T.linkable(F.col("entities")).alias("ents"), ids.alias("ids"), F.array_distinct(some(F.col("triggered_by"))).alias("refs"))
    common = a.mapInArrow(_common, "session_id string, value string").groupBy("session_id", "value").count().filter(F.col("count") > MOST_HOLDERS)
    none = F.array().cast("array<string>")
    ahead = common.select("session_id", F.lit(None).cast("bigint").alias("us"), F.lit(None).cast("string").alias("activity_id"), *[F.lit("").alias(c) for c in _TEXTS], F.array("value").alias("ents"), none.alias("ids"), none.alias("refs"))
    x = a.filter("us is not null").unionByName(ahead)
    return x.repartition("session_id").sortWithinPartitions("session_id", F.asc_nulls_first("us"), "activity_id").mapInArrow(_linked, _LINKED)
