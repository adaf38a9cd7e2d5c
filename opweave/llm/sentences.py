"""Problem 9: sentence units across languages and scripts.

Abbreviations, collocations and sentence starters are learned unsupervised, per
language, from the whole corpus by log-likelihood ratios; every period is then
classified by these statistics.  Terminators of scripts without that ambiguity, quotes,
brackets, ellipses and Thai spaces follow rules.

Counts are exact and stay in Spark: the ratios are column expressions over the counted
types, and only accepted types come to the driver.
"""
from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from opweave.session import cut

LINE = re.compile(r"[^\r\n\x0b\x0c\x85\u2028\u2029]+")
# fixed values: sentence terminals by their Unicode property, by what they need: a look at what follows, nothing, or a space
WIDE = "。！？｡．﹒﹖﹗"
FULL = (
    "।॥۔\u0589\u061d\u061e\u0700\u0701\u0702\u07f9\u0837\u0839\u083d\u083e\u0f0d\u0f0e\u104b\u1362\u1367\u1368\u166e\u1735\u1736\u17d4\u17d5\u1803\u1809\u1944\u1945"
    "\u1aa8\u1aa9\u1aaa\u1aab\u1b5a\u1b5b\u1b5e\u1b5f\u1c3b\u1c3c\u1c7e\u1c7f\u2e3c\ua4ff\ua60e\ua60f\ua6f3\ua6f7\ua876\ua877\ua8ce\ua8cf\ua92f\ua9c8\ua9c9\uaa5d\uaa5e\uaa5f\uaaf0\uaaf1\uabeb"
)
ASKING = "!?؟\u037e\u203c\u203d\u2047\u2048\u2049\u2e2e\u2e53\u2e54"
DOTS = "….‥"
TERMINAL = DOTS + WIDE + FULL + ASKING
OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "「": "」", "『": "』", "【": "】", "《": "》", "〈": "〉", "“": "”", "«": "»", "„": "“”", "‹": "›", "‘": "’"}
CLOSE = set("".join(OPEN.values())) - {"’"} | {'"'}
MARKS = re.compile(r"[()\[\]{}（）［］「」『』【】《》〈〉“”«»„‹›\"]")
OPENING = set("([{（［「『【《〈“«„‹¿¡")
# a single period counts before white space, a closing mark or the end of the line; other terminals always
RUN = re.compile(rf"[.](?![{TERMINAL}])(?=[\s{re.escape(''.join(sorted(CLOSE)))}]|\Z)|[{TERMINAL}]*[{TERMINAL.replace('.', '')}][{TERMINAL}]*|[.]{{2,}}")
_QUICK = re.compile(rf"[.](?![{TERMINAL}])\s+(?=([^\s,;:)]))|(?>[{TERMINAL}]*[{TERMINAL.replace('.', '')}][{TERMINAL}]*|[.]{{2,}})\s*(?=(\S))")
_TAIL = re.compile(rf"[\s{re.escape(''.join(sorted(CLOSE)))}]*\Z")
_ANY = re.compile(f"[{TERMINAL}]")
THAI = "ก-ฺเ-๎"
THAI_SPACE = re.compile(f"(?<=[{THAI}])[^\\S\\r\\n]+(?=[{THAI}])")
CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿ｦ-ﾟ]")
_CLOSERS = re.escape("".join(sorted(CLOSE)))
# a terminator before something that could begin another unit of the line
_INNER = re.compile(rf"[.](?=[\s{_CLOSERS}])[\s{_CLOSERS}]*+[^\s,;:a-z{TERMINAL}]|[{TERMINAL.replace('.', '')}][\s{_CLOSERS}{TERMINAL}]*+\S|[.]{{2}}|[{THAI}][^\S\r\n]+[{THAI}]")
_THAI_LETTER = re.compile(f"[{THAI}]")
_FAR = re.compile("[\u0371-\U0010ffff]")
_LATIN = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ʯ]")
_DIGIT = re.compile(r"\d")
_KANA = "぀-ヿｦ-ﾟ"
_HAN = "㐀-䶿一-鿿"
_KANA3 = re.compile(f"[{_KANA}][^{_KANA}]*[{_KANA}][^{_KANA}]*[{_KANA}]")
_KANA1 = re.compile(f"[{_KANA}]")
_OTHER3 = re.compile("[؀-ۿऀ-ॿ฀-๿]")
_SCRIPT_OF = {"ja": re.compile(f"[{_KANA}]"), "zh": re.compile(f"[{_HAN}]"), "th": re.compile("[฀-๿]"), "hi": re.compile("[ऀ-ॿ]"), "ar": re.compile("[؀-ۿ]")}
# fixed values: further scripts, each with the language its lines count for unless the label names one of the others
SCRIPTS = {
    "ru": ("\u0400-\u052f", ("uk", "bg", "sr", "mk", "be", "kk")), "el": ("\u0370-\u03ff\u1f00-\u1fff", ()), "hy": ("\u0530-\u058f", ()), "he": ("\u0590-\u05ff", ("yi",)), "bn": ("\u0980-\u09ff", ("as",)), "pa": ("\u0a00-\u0a7f", ()),
    "gu": ("\u0a80-\u0aff", ()), "ta": ("\u0b80-\u0bff", ()), "te": ("\u0c00-\u0c7f", ()), "kn": ("\u0c80-\u0cff", ()), "ml": ("\u0d00-\u0d7f", ()), "si": ("\u0d80-\u0dff", ()), "lo": ("\u0e80-\u0eff", ()), "bo": ("\u0f00-\u0fff", ("dz",)),
    "my": ("\u1000-\u109f", ()), "ka": ("\u10a0-\u10ff", ()), "am": ("\u1200-\u139f", ("ti",)), "km": ("\u1780-\u17ff", ()), "mn": ("\u1800-\u18af", ()), "ko": ("\uac00-\ud7af\u1100-\u11ff", ()),
}
_SCRIPTS = {k: re.compile(f"[{r}]") for k, (r, _) in SCRIPTS.items()}
_MORE = re.compile("[" + "".join(r for r, _ in SCRIPTS.values()) + "]")
ENUMERATOR = re.compile(r"\s*(?:\d{1,3}|[A-Za-z])\.(?=\s)")
_STOP = r"\s()\[\]{}\"“”«»„‹›「」『』（）,;:!?¿¡…"
TOKEN = re.compile(f"[^{_STOP}]+")
_LAST = re.compile(f"[^{_STOP}]+\\Z")
# a token with one final period, what stands between, and the next token of the line; not the number of a list item
_EDGE = re.compile(rf"[.](?![^{_STOP}])|[!?؟।]")
_DOTTED = re.compile(rf"(?<![^{_STOP}])(?!(?<=\n)(?:\d{{1,3}}|[A-Za-z])\.[^\S\n])((?:[^{_STOP}]*[^{_STOP}.]))\.(?![^{_STOP}])((?:(?!\n)[{_STOP}])*)(?=([^{_STOP}]*))")
_SURE = re.compile(rf"(?:[!?؟](?=(?:(?!\n)[{_STOP}])*?[^\S\n])|।(?=(?!\n)[{_STOP}]))(?:(?!\n)[{_STOP}])*([^{_STOP}]+)(?=(?:(?!\n)[{_STOP}])+[^{_STOP}])")
_FIRST = re.compile(rf"[{_STOP}]*([^{_STOP}]+)(?=[{_STOP}]+[^{_STOP}])")
# fixed values: frequent function words that tell the Latin-script languages apart
FUNCTION_WORDS = {
    "en": "the of and to was is at for by from on nobody with it in not before while",
    "de": "der die das und ist ein eine mit um von zu den nicht des dem wurde im am als",
    "fr": "le la les des et est une à du un sur dans pas que au pour malgré sans",
    "es": "el la los las de que y un una en se fue por del con sin según no",
    "it": "il gli della dello dei degli nel nella alla dal che è sono anche questo",
    "pt": "não uma ao pelo pela são foi também mais isso esta",
    "nl": "het een niet zijn voor naar ook wordt deze",
    "pl": "nie się jest są oraz który przez",
    "sv": "och att är inte som från också",
    "cs": "není jsou byl který také však",
    "tr": "ve bir için değil ile olarak",
}
_WORDS = {w: tuple(k for k, ws in FUNCTION_WORDS.items() if w in ws.split()) for ws in FUNCTION_WORDS.values() for w in ws.split()}
UNSPACED = ("ja", "zh", "th", "km", "my", "lo", "bo")  # no period of theirs is ambiguous
REPEATED = 300  # shorter lines (headings, log and form lines) are looked up among the latest before they are taken apart again
STARTER_SHARE = 1e-5  # a starter opens at least this share of the certain sentences: at most 1 / STARTER_SHARE a language
MIN_USES = 3  # periods after a type, or after a number before a word, before it is judged at all
EVIDENCE = 400  # uses a ratio is scaled to, so that it does not grow with the corpus
MAX_TYPES = 5_000_000  # accepted types the driver and the workers hold; more raise an error, none is dropped


@lru_cache(1 << 14)
def _label_language(label: str) -> str:
    return label if label in FUNCTION_WORDS or len(label) in (2, 3) and label.isascii() and label.isalpha() and label not in _SCRIPT_OF and label not in SCRIPTS and label != "und" else "en"


def line_language(line: str, label: str) -> str:
    """By script where it tells; Latin-script lines by function words, else by the document's label."""
    if not line.isascii() and _FAR.search(line):
        if not _OTHER3.search(line):
            if _KANA3.search(line):
                return "ja"
            if not _KANA1.search(line) and (han := len(_SCRIPT_OF["zh"].findall(line))) and han * 2 >= len(_LATIN.findall(line)):
                return "ja" if label == "ja" else "zh"
        n = {k: len(p.findall(line)) for k, p in _SCRIPT_OF.items()}
        far = sum(n.values())
        latin = -1
        if far:
            latin = len(_LATIN.findall(line))
            top = max(n, key=n.get)
            if far * 2 >= latin or top in ("ar", "hi", "th") and far * 4 >= latin or n["ja"] >= 3:
                return "ja" if n["ja"] and top in ("zh", "ja") else "zh" if top == "zh" and label != "ja" else "ja" if top == "zh" else top
        if _MORE.search(line):
            m = {k: len(p.findall(line)) for k, p in _SCRIPTS.items()}
            top = max(m, key=m.get)
            if m[top] * 2 >= (latin if latin >= 0 else len(_LATIN.findall(line))):
                return label if label in SCRIPTS[top][1] else top
    hits = [x for w in line.lower().replace(",", " ").replace(".", " ").replace("(", " ").replace('"', " ").replace("!", " ").replace("?", " ").split() if (x := _WORDS.get(w))]
    votes: dict[str, int] = {}
    for ks in hits:
        for k in ks:
            votes[k] = votes.get(k, 0) + 1
    if votes:
        best = max(votes.values())
        top = [k for k in votes if votes[k] == best]
        return label if label in top else top[0]
    return _label_language(label)


def word_type(token: str) -> str:
    """Lower case; tokens with digits count as numbers."""
    return "##" if _DIGIT.search(token) else token.lower()


@dataclass
class SentenceModel:
    """Per language: abbreviations (without their last period), sentence starters (as written), collocations."""

    abbreviations: dict[str, set[str]] = field(default_factory=dict)
    starters: dict[str, set[str]] = field(default_factory=dict)
    collocations: dict[str, set[tuple[str, str]]] = field(default_factory=dict)

    @cached_property
    def again(self):
        """segment_line with the latest lines kept, in one worker."""
        return lru_cache(1 << 15)(lambda line, label: segment_line(line, label, self))

    @cached_property
    def short(self) -> set[str]:
        """Abbreviations of any language: no other type needs a line's language."""
        return set().union(*self.abbreviations.values())

    @cached_property
    def numbered(self) -> set[str]:
        """Words that follow a number and its period in any language."""
        return {w for c in self.collocations.values() for _, w in c}


def _begins(w: str) -> bool:
    """Whether a word could begin a sentence: a capital, or a letter of a script without case."""
    c = w[0]
    return c.isupper() or c.isalpha() and not c.islower() and c.lower() == c.upper()


def _blank_inside(line: str) -> str:
    """The line without the words in its quotes and brackets: what is quoted has no boundaries to learn from."""
    ends, _ = _pairs(line)
    out, at = [], 0
    for a, b in _outer(ends):
        out += [line[at:a], TOKEN.sub(" ", line[a:b])]
        at = b
    return "".join([*out, line[at:]])


def _prepare(line: str, label: str) -> tuple[str, str]:
    """Language and text to count of a line."""
    lang = line_language(line, label)
    return lang, _blank_inside(line) if lang not in UNSPACED and MARKS.search(line) and _EDGE.search(line) else line


_prepare_again = lru_cache(1 << 15)(_prepare)


def _language_counts(lines: list[str], c: Counter) -> None:
    """Counts (kind, a, b): t uses of a type, d with a final period, c uses of a word that could begin, s those after a
    certain boundary, f what follows a type and its period, p that type and the word after it, n tokens."""
    joined = "\n".join(lines)
    tokens = Counter(TOKEN.findall(joined))
    for w, n in tokens.items():
        bare = w.rstrip(".")
        if bare:
            c["t", word_type(bare), ""] += n
            c["n", "", ""] += n
            if _begins(w):
                c["c", bare, ""] += n
    for line in lines:
        if (m := _FIRST.match(line)) and _begins(m[1]) and (w := m[1].rstrip(".")):
            c["s", w, ""] += 1
    for w in _SURE.findall(joined):
        if _begins(w) and (w := w.rstrip(".")):
            c["s", w, ""] += 1
    for (w, gap, nxt), n in Counter(_DOTTED.findall("\n" + joined)).items():
        core = word_type(w)
        c["d", core, ""] += n
        if not nxt:
            c["f", core, "end"] += n
            continue
        mark, ch = gap.lstrip()[:1], nxt[0]
        kind = "comma" if mark and mark in ",;:" else "open" if mark else "digit" if ch.isdigit() or ch == "." else "lower" if ch.islower() else "upper"
        c["f", core, kind] += n
        if kind == "upper":
            c["p", core, nxt.rstrip(".")] += n


def _count(batches: Iterable[pa.RecordBatch], block: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    for b in batches:
        by: dict[str, Counter] = {}
        held: dict[str, list[str]] = {}
        size = 0

        def flush() -> None:
            for lang, lines in held.items():
                _language_counts(lines, by.setdefault(lang, Counter()))
            held.clear()

        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            label = (label or "").strip().lower()
            for line in LINE.findall(text or ""):
                line = line.strip()
                if not line:
                    continue
                lang, line = (_prepare_again if len(line) < REPEATED else _prepare)(line, label)
                if lang not in UNSPACED:
                    held.setdefault(lang, []).append(line)
                    size += len(line)
            if size > block:  # bounds the memory whatever the texts' lengths
                flush()
                size = 0
        flush()
        rows = [(lang, *k, n) for lang, c in by.items() for k, n in c.items()]
        cols = list(zip(*rows)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.string()) for x in cols[:4]] + [pa.array(list(cols[4]), pa.int64())], names=["lang", "kind", "a", "b", "n"])


def likelihood_ratio(n_a: Column, n_b: Column, n_ab: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio that b follows a more often than by chance; 0 where undefined."""

    def ll(k: Column, m: Column, p: Column) -> Column:
        return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(m > k, (m - k) * F.log(1 - p)).otherwise(0.0)

    rest = F.greatest(F.lit(0), n_b - n_ab)
    p, p1, p2 = n_b / n, n_ab / n_a, rest / (n - n_a)
    r = -2 * (ll(n_ab, n_a, p) + ll(rest, n - n_a, p) - ll(n_ab, n_a, p1) - ll(rest, n - n_a, p2))
    return F.when((n_a > 0) & (n > n_a) & (p > 0) & (p < 1), r).otherwise(0.0)


def fit_counts(counts: DataFrame) -> SentenceModel:
    """Model of counts (lang, kind, a, b, n), each (lang, kind, a, b) once; see ``_language_counts``.

    Every type is judged by all its counts.  Starters open at least ``STARTER_SHARE`` of the certain
    sentences of their language; a type or collocation needs ``MIN_USES`` periods."""
    n = F.col("n")
    when = lambda k, *more: F.sum(F.when(F.col("kind") == k, n).otherwise(0)) if not more else F.sum(F.when((F.col("kind") == k) & (F.col("b") == more[0]), n).otherwise(0))
    # one row a language, and the languages are those of line_language
    totals = counts.groupBy("lang").agg(F.greatest(F.lit(2), when("n")).alias("total"), when("d").alias("dots"), when("s").alias("sure"), F.sum(F.when((F.col("kind") == "d") & (F.col("a") == "##"), n).otherwise(0)).alias("numbers"))
    langs = [r for r in totals.collect() if r["dots"]]
    m = SentenceModel()
    if not langs:
        return m
    for r in langs:
        m.abbreviations[r["lang"]], m.starters[r["lang"]], m.collocations[r["lang"]] = set(), set(), set()
    of = F.broadcast(counts.sparkSession.createDataFrame([tuple(r) for r in langs], "tl string, total long, dots long, sure long, numbers long"))
    total, dots, sure, numbers = (F.col(x) for x in ("total", "dots", "sure", "numbers"))

    words = counts.filter("kind in ('c', 's')").groupBy("lang", "a").agg(when("c").alias("c"), when("s").alias("s")).join(of, F.col("lang") == F.col("tl"))
    every = F.greatest("c", "s")  # a capital counts as a word of its own
    starters = words.filter((F.col("a") != "##") & (F.col("s") > sure * STARTER_SHARE) & (F.col("s") / every > sure / total) & (likelihood_ratio(sure, every, F.col("s"), total) > 30))
    starters = cut(starters.select(F.col("lang").alias("sl"), F.col("a").alias("sw")))

    p = counts.filter("kind = 'p'").join(starters, (F.col("lang") == F.col("sl")) & (F.col("b") == F.col("sw")), "left")
    begin = p.filter("sw is not null").select("lang", F.lit("b").alias("kind"), "a", F.lit("").alias("b"), "n")
    t = counts.filter("kind in ('t', 'd', 'f')").unionByName(begin).groupBy("lang", "a")
    t = t.agg(when("d").alias("d"), when("t").alias("t"), F.sum(F.when(F.col("kind") == "f", n).otherwise(0)).alias("seen"), (when("f", "lower") + when("f", "digit") + when("f", "comma")).alias("inside"), (when("f", "upper") - when("b")).alias("names"))
    t = t.filter((F.col("d") >= MIN_USES) & (F.col("a") != "##") & F.col("a").rlike(r"\p{L}")).join(of, F.col("lang") == F.col("tl"))
    uses = F.greatest("t", "d")
    without = uses - F.col("d")
    scale = F.least(F.lit(1.0), EVIDENCE / uses)
    null = F.col("d") * F.log(dots / total) + without * F.log(1 - dots / total)
    alt = F.col("d") * F.log(F.lit(0.99)) + without * F.log(F.lit(0.01))
    inner = F.length("a") - F.length(F.replace("a", F.lit(".")))
    size = F.greatest(F.lit(1), F.length("a") - inner)
    # the ratio per occurrence times a bounded count, by length, inner periods and uses without a period
    score = -2 * (null - alt) * scale * F.exp(-size) * (inner + 1) * F.pow(size, -F.least(without * scale, F.lit(50.0)))
    goes_on = F.col("inside") + F.col("names")
    least = F.when(F.col("a").rlike(r"^\p{Lo}"), 0.9).otherwise(0.25)
    seen = F.greatest(F.lit(1), "seen")
    often = (score >= 0.3) & (goes_on > least * seen)
    mostly = (goes_on > F.greatest(F.lit(0.5), least) * seen) & (goes_on >= MIN_USES) & ((score >= 0.003) | (F.col("inside") > 0))
    for lang, a in _bounded(t.filter(often | mostly).select("lang", "a")):
        m.abbreviations[lang].add(a)

    pairs = p.filter("a = '##' and sw is null").select(F.col("lang").alias("pl"), F.col("b").alias("pb"), F.col("n").alias("v"))
    x = pairs.filter(F.col("v") >= MIN_USES).join(words.select("lang", F.col("a").alias("w"), "c", "total", "numbers"), (F.col("pl") == F.col("lang")) & (F.col("pb") == F.col("w")))
    b = F.greatest("v", "c")
    x = x.filter((F.col("v") >= 0.5 * b) & (total / numbers > b / F.col("v")) & (likelihood_ratio(numbers, b, F.col("v"), total) > 7.88))
    for lang, w in _bounded(x.select("lang", "w")):
        m.collocations[lang].add(("##", w))
    for lang, w in _bounded(starters.select("sl", "sw")):
        if lang in m.starters:
            m.starters[lang].add(w)
    return m


def _bounded(df: DataFrame) -> list[tuple[str, str]]:
    rows = [tuple(r) for r in df.limit(MAX_TYPES + 1).collect()]
    if len(rows) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} accepted types; raise MAX_TYPES if the workers can hold them")
    return rows


def learn_sentences(df: DataFrame, text: str, lang: str) -> SentenceModel:
    """Statistics over all lines of all documents, counted by partial sums; null and empty texts count nothing."""
    got = df.select(F.col(text).cast("string"), F.col(lang).cast("string")).filter(F.col(text) != "").mapInArrow(_count, "lang string, kind string, a string, b string, n bigint")
    return fit_counts(cut(got.groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n"))))


def _pairs(line: str) -> tuple[dict[int, int], dict[int, int]]:
    """Matched opening -> closing offsets and back; unmatched marks are left out."""
    stack: list[tuple[str, int]] = []
    open_now: Counter = Counter()
    ends: dict[int, int] = {}

    def close(fits) -> bool:
        if not any(n and fits(c) for c, n in open_now.items()):
            return False
        while True:
            c, at = stack.pop()
            open_now[c] -= 1
            if fits(c):
                ends[at] = i
                return True

    for m in MARKS.finditer(line):
        ch, i = m.group(), m.start()
        if ch == '"':
            if close(lambda c: c == '"') or i and line[i - 1].isdigit():
                continue
        elif close(lambda c: ch in OPEN.get(c, "")) or ch not in OPEN:
            continue
        stack.append((ch, i))
        open_now[ch] += 1
    return ends, {b: a for a, b in ends.items()}


def _outer(ends: dict[int, int]) -> list[tuple[int, int]]:
    """The outermost pairs, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ends.items()):
        if not out or a > out[-1][1]:
            out.append((a, b))
    return out


def _within(outer: list[tuple[int, int]], i: int) -> tuple[int, int] | None:
    """The outermost pair around offset i."""
    k = bisect.bisect_left(outer, (i, 0)) - 1
    return outer[k] if k >= 0 and i < outer[k][1] else None


class _Language:
    """Language of a line, found when first asked for."""

    __slots__ = ("line", "label", "known")

    def __init__(self, line: str, label: str) -> None:
        self.line, self.label, self.known = line, label, None

    def __call__(self) -> str:
        if self.known is None:
            self.known = line_language(self.line, self.label)
        return self.known


def segment_line(line: str, label: str, model: SentenceModel) -> list[int]:
    """Offsets in the line at which a unit ends (the line's end not included)."""
    thai = not line.isascii() and _THAI_LETTER.search(line) is not None
    if not thai and not _ANY.search(line):
        return []
    if MARKS.search(line):
        return _segment_marked(line, label, model, thai)
    cuts: list[int] = []
    lang = _Language(line, label)
    first = ENUMERATOR.match(line)
    skip = first.end() if first else 0
    for m in _QUICK.finditer(line):
        p = m.start()
        ch = m[1]
        if ch is not None:  # one period and white space
            if p < skip or ch.islower():
                continue
            if _period_ends(line, p, m.end(), ch, lang, model, False):
                cuts.append(p + 1)
            continue
        run, nx = m.group(), m.end()
        bare = run.rstrip()
        q = p + len(bare)
        if _ends(line, bare, p, q, line[nx], nx, nx > q, False, lang, model, False, False):
            cuts.append(q)
    if thai:
        cuts += [m.start() for m in THAI_SPACE.finditer(line)]
        cuts.sort()
    return cuts


def _segment_marked(line: str, label: str, model: SentenceModel, thai: bool) -> list[int]:
    """A line with quotes or brackets."""
    cuts: list[int] = []
    runs = list(RUN.finditer(line))
    if not runs and not thai:
        return cuts
    if not thai and all(_TAIL.match(line, m.end()) for m in runs):
        return cuts  # no terminator but at the end
    ends, starts = _pairs(line)
    outer = _outer(ends)
    lang = _Language(line, label)
    first = ENUMERATOR.match(line)
    for m in runs:
        p, q = m.span()
        if first and q <= first.end() and line[p:q] == ".":
            continue
        around, r = _within(outer, p), q
        while r < len(line) and (line[r] in CLOSE) and (r in starts or line[r] != '"' and line[r] not in OPEN):
            r += 1
        if around and r <= around[1]:
            continue
        quoted = bool(around) or r > q
        if r < len(line) and RUN.match(line, r):
            continue
        nx = r
        while nx < len(line) and line[nx].isspace():
            nx += 1
        if nx >= len(line):
            continue
        ch = line[nx]
        if _ends(line, m.group(), p, q, ch, nx, nx > r, quoted, lang, model, nx in ends, nx in ends and (line[ends[nx] - 1] in ".!?…" or ch != "(" and line[nx + 1].isupper())):
            cuts.append(r)
    if thai:
        cuts += [m.start() for m in THAI_SPACE.finditer(line) if not _within(outer, m.start())]
        cuts.sort()
    return cuts


def _ends(line: str, run: str, p: int, q: int, ch: str, nx: int, spaced: bool, quoted: bool, lang: _Language, model: SentenceModel, opens: bool, full: bool) -> bool:
    """Whether a unit ends at the terminators line[p:q]; ``full``: what follows is a whole quoted sentence."""
    opening = ch in OPENING or opens
    last = run[-1]
    if run == ".":
        if not spaced or ch.islower() or ch in ",;:)" or quoted and not (ch.isupper() or opening or ch.isdigit()):
            return False
        return _period_ends(line, p, nx, ch, lang, model, full)
    cjk_before = bool(p and CJK.match(line[p - 1])) or (p > 1 and line[p - 1] in CLOSE and bool(CJK.match(line[p - 2])))
    if not run.strip(DOTS):
        if cjk_before and CJK.match(ch) or lang() in ("ja", "zh"):
            return False
        return spaced and (ch.isupper() or opening) or (not spaced and opening and ch in "¿¡«“„")
    if any(c in WIDE for c in run):
        if quoted or ch in "、，,；;：:":
            return False
        return not (run == "．" and p and line[p - 1].isdigit() and ch.isdigit())
    if any(c in FULL for c in run):
        return not quoted
    if last in ASKING or any(c in ASKING for c in run):
        if not spaced:
            return bool(cjk_before and CJK.match(ch)) and not quoted
        if ch.islower() or ch in ",;:)»”":
            return False
        return not quoted or ch.isupper() or opening or ch.isdigit()
    return False


def _period_ends(line: str, p: int, nx: int, ch: str, lang: _Language, model: SentenceModel, full: bool) -> bool:
    """Whether the period at ``p``, with white space after it and ``ch`` at ``nx``, ends a unit by the learned statistics."""
    t = line[line.rfind(" ", 0, p) + 1 : p]
    if not t.isalnum():
        m = _LAST.search(t)
        if m is None:
            return True
        t = m.group()
    bare = t.strip(".")
    core = word_type(bare)
    if core == "##":
        word = _word_at(line, nx)
        return word not in model.numbered or (core, word) not in model.collocations.get(lang(), ())
    single = len(core) == 1 and core.isalpha() and t[0].isupper()
    if not single and core not in model.short:
        return True
    if core in model.abbreviations.get(lang(), ()) or single and lang() not in ("ja", "zh"):
        return not ch.isdigit() and (_word_at(line, nx) in model.starters.get(lang(), ()) or ch in "¿¡" or bool(full))
    return True


def _word_at(line: str, at: int) -> str:
    m = TOKEN.search(line, at)
    return m.group().rstrip(".") if m else ""


def sentence_spans(text: str, label: str, model: SentenceModel) -> list[tuple[int, int]]:
    """(start, end) of each unit in code points, end exclusive, without outer white space."""
    out = []
    again = model.again
    for m in LINE.finditer(text):
        line, base = m.group(), m.start()
        cuts = (again(line, label) if len(line) < REPEATED else segment_line(line, label, model)) if _INNER.search(line) else None
        if not cuts:
            part = line.strip()
            if part:
                s = base + len(line) - len(line.lstrip())
                out.append((s, s + len(part)))
            continue
        a = 0
        for b in (*cuts, len(line)):
            part = line[a:b]
            s = len(part) - len(part.lstrip())
            e = len(part.rstrip())
            if e > s:
                out.append((base + a + s, base + a + e))
            a = b
    return out


def sentence_units(df: DataFrame, key: str, text: str, lang: str, model: SentenceModel) -> DataFrame:
    """(key, sent_start, sent_end): one row per unit.  Null, empty and blank texts have none."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            rows, s, e = [], [], []
            for i, (t, label) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                for x, y in sentence_spans(t or "", (label or "").strip().lower(), model):
                    rows.append(i)
                    s.append(x)
                    e.append(y)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int32())), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["k", "sent_start", "sent_end"])

    return df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l")).mapInArrow(run, f"k {kind}, sent_start int, sent_end int").withColumnRenamed("k", key)
