"""Problem 5: one consistent form for visually identical text.

Nodes are code points and strings (a letter with its split marks, half-width kana with
its voicing mark, whole words of look-alike letters).  Rules and a short fixed list join
nodes that look the same; union-find makes the relation transitive.  One pass over the
corpus counts code points and ambiguous words, and each class takes as representative
its most frequent member among those that are no deviation by themselves.  A greedy
leftmost-longest multi-pattern automaton rewrites form deviations; letters with twins in
another script follow the script of their word, and a word that could be either
follows its neighbours or the representative of its string class.
"""
from __future__ import annotations

import bisect
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opweave.session import cut

# fixed values: letters that look like a Latin letter (left: Latin; right: Cyrillic, Greek, Armenian and other twins)
LATIN_TWINS = {
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һհ", "i": "іι", "j": "јϳ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛզ", "s": "ѕ", "u": "ս", "v": "ѵν", "w": "ԝ", "x": "хχ", "y": "уγ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙӀ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "УΥҮ", "Z": "Ζ",
}
# fixed values: kana (left) and ideographs that look like them (right)
KANA_TWINS = {"カ": "力", "ニ": "二", "ロ": "口", "タ": "夕", "ト": "卜", "ハ": "八", "エ": "工", "ー": "一", "チ": "千", "オ": "才", "ヌ": "又", "ム": "厶", "ノ": "丿", "ヒ": "匕", "ヘ": "へ", "ベ": "べ", "ペ": "ぺ"}
RARE = "ѕԁһјіѵԛԝӏϲϳհոսցզյ"  # twins outside the alphabets that most texts of their script use
INVISIBLE = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯﻿"
SPACES = "               　"

_KANA = "ァ-ヺー-ヿ"
_HAN = "々㐀-䶿一-鿿"
_CJK_TWINS = "".join(KANA_TWINS) + "".join(KANA_TWINS.values())
CJK_RUN = re.compile(f"[{_KANA}{_HAN}へべぺ]*[{_CJK_TWINS}][{_KANA}{_HAN}へべぺ]*")
_HAN_OF = {v: k for k, v in KANA_TWINS.items()}
_OTHER = "Ͱ-ϿЀ-ԯԱ-ևɑ-ɡ"
WORD = re.compile(r"[A-Za-zÀ-ɏ" + _OTHER + "]+")
HAS_OTHER = re.compile(f"[{_OTHER}]")
_TO_LATIN = {t: l for l, ts in LATIN_TWINS.items() for t in ts}
_FIRST_OF = _HAN_OF | _TO_LATIN
_TWIN_WORD = re.compile(r"(?<![^\W\d_])[" + "".join(LATIN_TWINS) + "".join(_TO_LATIN) + r"]{2,}+(?![^\W\d_])")
_SCRIPTS = (("CYRILLIC", "Ѐ", "ԯ"), ("GREEK", "Ͱ", "Ͽ"), ("ARMENIAN", "Ա", "և"))
MAX_CLASSES = 5_000_000  # string classes of two forms or more that the workers hold; more raise an error, none is dropped
CLEAR = 0.6  # share of its class that a representative needs to decide a word by itself


class UnionFind:
    """Classes of hashable nodes."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, a, b) -> None:
        self.up[self.find(a)] = self.find(b)

    def classes(self) -> dict:
        out: dict = {}
        for x in list(self.up):
            out.setdefault(self.find(x), []).append(x)
        return out


def script(ch: str) -> str:
    """LATIN, CYRILLIC, GREEK, ARMENIAN or ''."""
    for name, a, b in _SCRIPTS:
        if a <= ch <= b:
            return name
    return "LATIN" if ch.isalpha() and (ch < "ɐ" or "ɐ" <= ch <= "ʯ") else ""


def deviates(node: str) -> bool:
    """Whether the node is by its form alone a deviation: width, split marks, compatibility twins of letters."""
    if len(node) > 1:
        return unicodedata.normalize("NFC", node) != node or "ｦ" <= node[0] <= "ﾟ"
    return "０" <= node <= "９" or "Ａ" <= node <= "Ｚ" or "ａ" <= node <= "ｚ" or "ｦ" <= node <= "ﾟ" or "⼀" <= node <= "⿕" or "⺀" <= node <= "⻳" or unicodedata.normalize("NFC", node) != node


def form_edges() -> Iterator[tuple[str, str]]:
    """Pairs of nodes that look the same, by rule."""
    marks = ("ﾞ", "ﾟ")
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        if deviates(ch):
            other = unicodedata.normalize("NFKC", ch)
            if cp in (0xFF9E, 0xFF9F):
                other = "゛" if cp == 0xFF9E else "゜"
            if other != ch and len(other) == 1:
                yield ch, other
            if "ｦ" <= ch <= "ﾝ":
                for m in marks:
                    both = unicodedata.normalize("NFKC", ch + m)
                    if len(both) == 1:
                        yield ch + m, both
        elif d := unicodedata.decomposition(ch):
            if not d.startswith("<") and len(parts := d.split()) == 2:
                split = "".join(chr(int(p, 16)) for p in parts)
                if unicodedata.normalize("NFC", split) == ch:
                    yield split, ch
                    full = unicodedata.normalize("NFD", ch)
                    if full != split:
                        yield full, ch


@lru_cache(1)
def _edges() -> tuple[tuple[str, str], ...]:
    return tuple(form_edges())


@dataclass
class LookalikeModel:
    """Representatives learned from a corpus: of code points (bounded by Unicode) and of string classes that hold several forms.

    strings: skeleton -> representative; shares: its share of the class's occurrences."""

    forms: dict[str, str] = field(default_factory=dict)
    strings: dict[str, str] = field(default_factory=dict)
    shares: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def of(points: dict[str, int], classes: Iterable[tuple[str, str, float]]) -> "LookalikeModel":
        """points: code point counts; classes: (skeleton, representative, share)."""
        uf = UnionFind()
        for a, b in _edges():
            uf.union(a, b)
        forms = {}
        for nodes in uf.classes().values():
            good = [x for x in nodes if not deviates(x)] or [min(nodes, key=lambda x: unicodedata.normalize("NFKC", x))]
            rep = max(good, key=lambda x: (points.get(x, 0), -ord(x[0])))
            forms |= {x: rep for x in nodes if x != rep and deviates(x)}
        m = LookalikeModel(forms)
        for key, rep, share in classes:
            m.strings[key], m.shares[key] = rep, share
        return m

    @staticmethod
    def fit(points: dict[str, int], words: dict[str, int]) -> "LookalikeModel":
        """From counts in memory, also for other texts than those counted; words: counts of ambiguous words."""
        su = UnionFind()
        for w in words:
            su.union(w, "\0" + skeleton(w))
        classes = []
        for nodes in su.classes().values():
            own = [x for x in nodes if x[0] != "\0"]
            rep = max(own, key=lambda x: (words[x], x))
            classes.append((skeleton(rep), rep, words[rep] / sum(words[x] for x in own)))
        return LookalikeModel.of(points, classes)


def skeleton(word: str) -> str:
    """Every letter by the first member of its class."""
    return "".join(_FIRST_OF.get(c, c) for c in word)


_EMOJI = re.compile("[©®‼-㊙\U0001f000-\U0001fbff️]")


def _needed(text: str, i: int) -> bool:
    """Whether the invisible character at i is a joiner that its word or emoji needs."""
    ch = text[i]
    if ch not in "‌‍" or i == 0 or i + 1 >= len(text):
        return False
    a, b = text[i - 1], text[i + 1]
    if ch == "‍" and _EMOJI.match(a) and _EMOJI.match(b):
        return True
    if unicodedata.combining(a) == 9:  # after a virama
        return unicodedata.category(b) == "Lo"
    return ch == "‌" and _arabic(a) and _arabic(b)


def _arabic(c: str) -> bool:
    return "ؠ" <= c <= "ۿ" and c.isalpha() or "ݐ" <= c <= "ݿ"


class Rewriter:
    """Applies a model to texts, one worker at a time."""

    def __init__(self, model: LookalikeModel) -> None:
        self.model = model
        self.auto = ahocorasick.Automaton()
        for k, v in model.forms.items():
            self.auto.add_word(k, (k, v))
        for k in INVISIBLE:
            self.auto.add_word(k, (k, None))
        for k in SPACES:
            self.auto.add_word(k, (k, " "))
        self.auto.make_automaton()

    def __call__(self, text: str) -> str:
        return text if text.isascii() else self.rewrite(text)[0]

    def rewrite(self, text: str) -> tuple[str, list[tuple[int, int]]]:
        """The consistent form, and (offset there, offset in text) anchors where the two move apart."""
        if text.isascii():
            return text, [(0, 0)]
        out, anchors, at, n = [], [(0, 0)], 0, 0
        for end, (k, v) in self.auto.iter_long(text):
            start = end - len(k) + 1
            if v is None and _needed(text, start):
                continue
            out.append(text[at:start])
            n += start - at
            if v:
                out.append(v)
                n += len(v)
            at = end + 1
            if len(v or "") != len(k):
                anchors.append((n, at))
        out.append(text[at:])
        t = "".join(out)
        if not unicodedata.is_normalized("NFC", t):
            t, anchors = self._marks(t, anchors)
        t = self._cjk(self._words(t))  # one character each: no offset moves, but a letter may now take its mark
        if not unicodedata.is_normalized("NFC", t):
            t, anchors = self._marks(t, anchors)
        return t, anchors

    @staticmethod
    def _marks(t: str, anchors: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
        """Marks left over after the automaton (stacked, out of order): composed in place."""
        back = [source_offset(anchors, i) for i in range(len(t) + 1)]
        out, new, at = [], [(0, 0)], 0
        for m in re.finditer(r"(?:[^\W\d_])?[̀-֑ͯ-ׇؐ-़゙゚ۜ]+", t):
            c = unicodedata.normalize("NFC", m.group())
            if c != m.group():
                out += [(t[at : m.start()], at), (c, m.start())]
                at = m.end()
        out.append((t[at:], at))
        n = 0
        for piece, src in out:
            new.append((n, back[src]))
            new += [(n + i, back[src + i]) for i in range(1, len(piece)) if back[src + min(i, len(t) - src)] != back[src] + i]
            n += len(piece)
        return "".join(p for p, _ in out), new

    def _words(self, t: str) -> str:
        if not HAS_OTHER.search(t):
            return t
        words = [(m.start(), m.group()) for m in WORD.finditer(t)]
        kinds = [_word_script(w) for _, w in words]
        chars = near = None
        for i, (at, w) in enumerate(words):
            if not HAS_OTHER.search(w) and kinds[i] != "?":
                continue
            to = kinds[i]
            if to == "?":
                if all(script(c) == "LATIN" for c in w):
                    continue
                near = near or _nearest(words, kinds)
                to = self._by_neighbours(w, near[i])
            new = _to_script(w, to)
            if new != w:
                chars = chars or list(t)
                chars[at : at + len(w)] = new
        return "".join(chars) if chars else t

    def _by_neighbours(self, w: str, near: str) -> str:
        own = {script(c) for c in w}
        if len(own) > 1:
            return "LATIN"
        if near and near not in own:
            return "LATIN"
        rep = self.model.strings.get(skeleton(w), "")
        latin = len(w) > 1 and rep and all(script(c) == "LATIN" for c in rep) and self.model.shares[skeleton(w)] >= CLEAR
        rare = any(c in RARE for c in w)
        return "LATIN" if latin or rare and not near else next(iter(own))

    def _cjk(self, t: str) -> str:
        if not any(c in t for c in _CJK_TWINS):
            return t
        return CJK_RUN.sub(self._run, t)

    def _run(self, m: re.Match) -> str:
        w = m.group()
        rep = self.model.strings.get(skeleton(w))
        if rep is not None and rep != w and self.model.shares[skeleton(w)] >= CLEAR:
            return rep
        out = list(w)
        for i, c in enumerate(w):  # no representative: the neighbours decide
            a, b = out[i - 1] if i else "", w[i + 1] if i + 1 < len(w) else ""
            kana = lambda x: bool(x) and "ァ" <= x <= "ヿ"
            if c in _HAN_OF and kana(a) and (kana(b) or not b and i > 1 and kana(out[i - 2])):
                out[i] = _HAN_OF[c]
            elif c in KANA_TWINS and c not in "ノヘベペ" and a and b and not kana(a) and not kana(b) and a not in "へべぺ" and rep is None and c == "ー":
                out[i] = KANA_TWINS[c]
        return "".join(out)


def _nearest(words: list[tuple[int, str]], kinds: list[str]) -> list[str]:
    """Script of the nearest word with a decisive one, '' if there is none; the earlier wins ties."""
    n = len(words)
    left: list[int | None] = [None] * n
    right: list[int | None] = [None] * n
    for order, side in ((range(n), left), (range(n - 1, -1, -1), right)):
        last = None
        for i in order:
            side[i] = last
            if kinds[i] not in "?!":
                last = i
    out = []
    for i, (at, w) in enumerate(words):
        a, b = left[i], right[i]
        da = at - words[a][0] - len(words[a][1]) if a is not None else None
        db = words[b][0] - at - len(w) if b is not None else None
        out.append("" if da is None and db is None else kinds[a] if db is None or da is not None and da <= db else kinds[b])
    return out


def _word_script(w: str) -> str:
    """Script of the letters without twins; '?' if all have twins, '!' if two scripts are decisive."""
    own = {script(c) for c in w if c not in LATIN_TWINS and c not in _TO_LATIN}
    if len(own) == 1:
        return own.pop()
    return "!" if own else "?"


def _to_script(w: str, to: str) -> str:
    if to == "LATIN":
        return "".join(_TO_LATIN.get(c, c) for c in w)
    if to in ("CYRILLIC", "GREEK", "ARMENIAN"):
        out = []
        for c in w:
            if script(c) != to:
                c = next((t for t in LATIN_TWINS.get(_TO_LATIN.get(c, c), "") if script(t) == to), c)
            out.append(c)
        return "".join(out)
    return w


def source_offset(anchors: list[tuple[int, int]], i: int) -> int:
    """Offset in the original text of offset i in the consistent form."""
    n, at = anchors[bisect.bisect_right(anchors, (i, 1 << 60)) - 1]
    return at + i - n


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        points: Counter = Counter()
        words: Counter = Counter()
        for col in b.columns:
            texts = [t for t in col.to_pylist() if t]
            joined = "\n".join(texts)
            at = 0
            while at < len(joined):  # blocks bound the memory whatever the texts' lengths
                part = joined[at : at + 2_000_000]
                cp, n = np.unique(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
                points.update(dict(zip(cp.tolist(), n.tolist())))
                at += len(part)
            for t in texts:
                words.update(_TWIN_WORD.findall(t))
                if not t.isascii():
                    words.update(CJK_RUN.findall(t))
        keys = [chr(c) for c in points if not 0xD800 <= c < 0xE000]
        yield pa.RecordBatch.from_pydict({"kind": pa.array(["p"] * len(keys), pa.string()), "key": pa.array(keys, pa.string()), "n": pa.array([points[ord(k)] for k in keys], pa.int64())})
        yield pa.RecordBatch.from_pydict({"kind": pa.array(["w"] * len(words), pa.string()), "key": pa.array(list(words), pa.string()), "n": pa.array(list(words.values()), pa.int64())})


def fit_lookalikes(df: DataFrame, columns: list[str]) -> LookalikeModel:
    """Counts over all rows of ``columns``.

    Words are joined to their classes in Spark.  To the driver come code points (bounded by
    Unicode) and the classes that hold two forms or more: a class of one form has nothing to
    rewrite.  A representative's weight is its share of its class, whatever the corpus's size."""
    got = df.select(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(_count, "kind string, key string, n bigint")
    got = cut(got.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    points = {r[0]: r[1] for r in got.filter("kind = 'p'").select("key", "n").collect()}
    words = got.filter("kind = 'w'").withColumn("class", F.translate("key", "".join(_FIRST_OF), "".join(_FIRST_OF.values()))).groupBy("class").agg(F.count("*").alias("forms"), F.max_by("key", F.struct("n", "key")).alias("rep"), (F.max("n") / F.sum("n")).alias("share"))
    classes = [tuple(r) for r in words.filter("forms > 1").select("class", "rep", "share").limit(MAX_CLASSES + 1).collect()]
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes of several forms; raise MAX_CLASSES if the workers can hold them")
    return LookalikeModel.of(points, classes)


_REWRITERS: dict[int, Rewriter] = {}


def rewriter(shared) -> Rewriter:
    """The rewriter of a broadcast model, built once a worker."""
    key = shared.id if hasattr(shared, "id") else id(shared)
    if key not in _REWRITERS:
        _REWRITERS.clear()
        _REWRITERS[key] = Rewriter(shared.value if hasattr(shared, "value") else shared)
    return _REWRITERS[key]


def consistent_form(df: DataFrame, model: LookalikeModel, columns: list[str], suffix: str = "_form") -> DataFrame:
    """Adds ``<column><suffix>``, the consistent form.  Null stays null, an empty text empty."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        r = rewriter(shared)
        seen: dict[str, str] = {}
        return s.map(lambda t: t if t is None or t.isascii() else seen.get(t) or seen.setdefault(t, r(t)))

    return df.withColumns({c + suffix: form(F.col(c)) for c in columns})


def deviating_fields(df: DataFrame, model: LookalikeModel, key: str, columns: list[str]) -> DataFrame:
    """(key, field_name): each field whose text differs from its consistent form; rows with a repeated key count once."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = rewriter(shared)
        for b in batches:
            keys, names = [], []
            ids = b.column(0).to_pylist()
            for c in columns:
                for k, t in zip(ids, b.column(c).to_pylist()):
                    if t and not t.isascii() and r(t) != t:
                        keys.append(k)
                        names.append(c)
            yield pa.RecordBatch.from_pydict({"k": pa.array(keys, pa.string()), "field_name": pa.array(names, pa.string())})

    cols = [F.col(key).alias("__k"), *[F.col(c) for c in columns]]
    return df.select(*cols).mapInArrow(find, "k string, field_name string").distinct().select(F.col("k").alias(key), "field_name")
