"""Problem 1: personal information in free text, found by anchor expansion and replaced by typed placeholders.

An Aho-Corasick automaton over the folded consistent form finds anchors: at-signs and
their written-out forms, schemes and call words, identifier cues, postal marks, street
and box words, titles and names of the staff table; digit runs are anchors too.  Each
anchor calls the local parser of its kind.  A parser walks left and right from the
anchor by character class, token by token, until the class ends, and validates what it
has: nothing but the text itself ends an occurrence, whatever its length.  Offsets go
back to the original text, so that everything else stays as it was.
"""
from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opweave.llm.lookalikes import LookalikeModel, Rewriter, source_offset

KINDS = ("email", "phone", "id_number", "address", "person_name")

# fixed values: written-out at-signs, identifier cues, titles, honorifics, street words, building words
AT_FORMS = ("@", "(at)", "[at]", "{at}", "<at>", "( at )", "[ at ]", "{ at }", "< at >")
CALLS = ("tel:", "tel.", "tel ", "phone", "call ", "mobile", "cell ", "fax", "telefon", "téléphone", "teléfono", "móvil", "☎", "電話", "携帯", "电话", "手机")
ID_CUES = (
    "ssn", "social security", "passport", "steuer-id", "steueridentifikationsnummer", "steuernummer", "national id", "ni number", "national insurance", "licence", "license", "tax id", "identity card", "id card",
    "旅券番号", "パスポート番号", "個人番号", "マイナンバー", "在留カード番号", "免許証番号", "身份证", "护照",
)
TITLES = "Mrs|Mr|Ms|Miss|Dr|Prof|Mme|Mlle|Herr|Frau|Sra|Sr|Srta|M"
HONORIFICS = "さん|様|氏|部長|課長|係長|社長|主任|先生|殿|君|くん"
STREETS = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Court|Ct|Boulevard|Blvd|Drive|Rise|Way|Place|Square|Terrace|Crescent|Close|Walk|Hill|Row"
TOWN_SECOND = "Falls|Bay|Heights|Park|City|Springs|Hills|Beach|Grove|Lake|Valley|Creek|Point|Harbor|Harbour"
DE_STREETS = "straße|strasse|str\\.|allee|weg|gasse|platz|ring|ufer|damm"
FR_STREETS = "rue|avenue|impasse|boulevard|place|chemin|quai|allée|cours|route"
BUILDINGS = "コーポ|ハイツ|マンション|メゾン|レジデンス|ビル|パレス|荘|アパート"
NOT_PERSONAL = r"(?<![a-z])(?:order|serial|counter|ticket|ticket number|part|part no\.?|no\.|ref\.?|batch|lot|ratio|build|version|invoice|tracking|tracking no\.?|item|room|row|line|shelf|追跡番号|注文番号|伝票|製番|版|様式|号機) ?[:：#]? ?\Z"
COMPANY = re.compile(r"(?:,? (?:gmbh|ltd|inc|sarl|llc|plc|corp|co|kk|k\.k|ag|s\.a)\b|\s?&\s|\s(?:tools|freight|papier|catering|systems|logistics|bureau|works|holdings)\b|-projekt)", re.I)
BEFORE_NAME = re.compile(r"(?:project|projekt|release|version)\s$", re.I)

_H = "一-鿿々ヶヵノツ"
_D = r"[-－−‐–]"

_SPACELESS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af"  # scripts that set no space before or after an address
LABEL = re.compile(rf"[^\W_{_SPACELESS}]+(?:-+[^\W_{_SPACELESS}]+)*+")
DOT = re.compile(r"\.|\s?[(\[{<]\s?dot\s?[)\]}>]\s?| dot ", re.I)
AT = re.compile(r"@|[(\[{<]\s?at\s?[)\]}>]", re.I)
LOCAL_CHAR = re.compile(rf"[^\W{_SPACELESS}]|[.%+-]")
EXT = r"(?:,?\s?(?:x|ext\.?|extension|内線|Durchwahl|App\.)\s?[0-9]{1,6})?"
PHONES = re.compile(
    r"(?<![\w.+/-])(?:"
    r"\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{1,14}+){1,6}"
    r"|\([0-9]{3}\)[ -]?[0-9]{3}[ .-][0-9]{4}"
    r"|[0-9]{3}([-.])[0-9]{3}\1[0-9]{4}"
    rf"|0[5789]0{_D}[0-9]{{4}}{_D}[0-9]{{4}}|0[5789]0[0-9]{{8}}"
    rf"|0120{_D}[0-9]{{3}}{_D}[0-9]{{3}}|0800{_D}[0-9]{{3}}{_D}[0-9]{{4}}"
    rf"|0[1-9]{_D}[0-9]{{4}}{_D}[0-9]{{4}}|0[1-9][0-9]{{1,2}}{_D}[0-9]{{2,3}}{_D}[0-9]{{4}}|0[1-9][0-9]{{0,2}}[（(][0-9]{{2,4}}[)）][0-9]{{4}}"
    r"|0[1-9](?:[ .][0-9]{2}){4}"
    r"|0[1-9][0-9]{1,3} [0-9]{3,4} [0-9]{3,4}|0[1-9][0-9]{1,3}[ /][0-9]{4,8}(?:-[0-9]{1,4})?"
    rf"){EXT}(?![\w]|[-.,][0-9])",
    re.I,
)
NUMBER_START = re.compile(r"(?<![\w.+/-])[+(]?[0-9]")
CALLED = re.compile(r"(?:number|no\.?|nr\.?|me|us|at|on|番号|号码)?\s?[:：.]?\s?(\+?[0-9](?:[ ./()-]{0,2}[0-9]){6,14}+)(?![\w]|[-.,:][0-9])", re.I)
CN_MOBILE = re.compile(r"(?<![\w.+/-])1[3-9][0-9]{9}(?![0-9A-Za-z_]|[-.,][0-9])")
DATE_LIKE = re.compile(r"(?:19|20)[0-9]{2}[-./][01]?[0-9][-./][0-3]?[0-9]|[0-3]?[0-9][-./][01]?[0-9][-./](?:19|20)[0-9]{2}")
HAN = re.compile("[\u4e00-\u9fff]")
_VALUES = r"[A-Z]{2}\s?[0-9]{2}\s?[0-9]{2}\s?[0-9]{2}\s?[A-D]|[A-Z]{1,2}[0-9]{6,9}(?:[A-Z]{1,2})?|[A-Z]?[0-9]{3,4}[- ][0-9]{4}[- ][0-9]{4}|[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}|[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{3}|[0-9]{7,12}(?:-?[A-Z0-9])?|[A-Z0-9]{2,4}(?:-[A-Z0-9]{2,6}){1,3}"
ID_VALUE = re.compile(rf"(?:['’]s)?(?:\s?(?:card|number|no\.?|nr\.?|id|#|番号|号码|号))*\s?[:：は#＃]?\s?({_VALUES})(?![\w]|-[0-9A-Z])")
BARE_ID = re.compile(r"(?<![\w.+/-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2} [0-9]{2} [0-9]{2} [0-9]{2} [A-D])(?![\w]|-[0-9])")
NEGATIVE = re.compile(NOT_PERSONAL, re.I)

_TOWN = rf"[A-ZÀ-Þ][\w'’-]+(?: (?:{TOWN_SECOND}))?"
_SEP = r"(?:, |,?\r?\n)"
_UNIT = r"(?:Apartment|Apt|Unit|Flat|Suite|Floor)\.? ?[0-9]{1,5}[A-Za-z]?"
_POST = r"(?:,? (?:[A-Z]{2} )?[0-9]{5}(?:-[0-9]{4})?\b| [A-Z]{1,2}[0-9]{1,2} [0-9][A-Z]{2}\b)"
CN_REGIONS = "北京|上海|天津|重庆|河北|山西|辽宁|吉林|黑龙江|江苏|浙江|安徽|福建|江西|山东|河南|湖北|湖南|广东|海南|四川|贵州|云南|陕西|甘肃|青海|台湾|内蒙古|广西|西藏|宁夏|新疆"  # fixed values
SOUTH_STREETS = ("calle ", "avenida ", "avda. ", "plaza ", "paseo ", "via ", "viale ", "piazza ", "corso ", "rua ", "praça ", "travessa ")  # fixed values
EN_ADDRESS = re.compile(
    rf"(?:{_UNIT},? )?\b[0-9]{{1,5}}[A-Za-z]? (?:[NSEW]\.? )?(?:[A-Z][\w'’-]+ ){{1,3}}(?:{STREETS})\b\.?(?:{_SEP}{_UNIT})?(?:, {_TOWN}(?:{_POST})?|\r?\n{_TOWN}{_POST})"
    rf"|\b[0-9]{{1,5}}[a-z]? (?:[nsew]\.? )?(?:[a-z'’-]+ ){{1,3}}(?:{STREETS.lower()})\b\.?,? [a-zà-þ'’-]{{3,}}(?: (?:{TOWN_SECOND.lower()})\b)?(?:{_POST.lower()})?"
)
BOX_ADDRESS = re.compile(rf"\bP\. ?O\. ?Box [0-9]+(?:{_SEP}{_TOWN})?(?:{_POST})?|\bPO Box [0-9]+{_SEP}{_TOWN}(?:{_POST})?")
_DE_END = rf" [0-9]{{1,4}} ?[a-z]?{_SEP}[0-9]{{4,5}} [A-ZÄÖÜ][\wäöüß-]+(?: (?:am|an der|im|bei|ob der) [A-ZÄÖÜ][\wäöüß]+)?"
DE_ADDRESS = re.compile(rf"\b(?:[A-ZÄÖÜ][\wäöüß-]*(?:{DE_STREETS})|(?:Am|An der|An den|Im|Zum|Zur|Auf dem|Unter den|Hinter der) [A-ZÄÖÜ][\wäöüß-]+){_DE_END}")
FR_ADDRESS = re.compile(rf"\b[0-9]{{1,4}}(?: bis| ter| quater)?,? (?:{FR_STREETS}) [^,\n0-9]{{3,80}}{_SEP}[0-9]{{5}} (?:(?:La|Le|Les|Saint|Sainte) )?[A-ZÀ-Þ][\wà-ÿ'’-]+")
SOUTH_ADDRESS = re.compile(rf"\b(?:Calle|Avenida|Avda\.|Plaza|Paseo|Via|Viale|Piazza|Corso|Rua|Praça|Travessa) [^,\n0-9]{{2,80}},? [0-9]{{1,4}}[A-Za-z]?{_SEP}[0-9]{{4,5}}(?:-[0-9]{{3}})? [A-ZÀ-Þ][\wà-ÿ'’-]+(?: (?:de|del|di|do|da|la) [A-ZÀ-Þ][\wà-ÿ'’-]+)?", re.I)
JP_ADDRESS = re.compile(
    rf"(?:〒 ?[0-9]{{3}}{_D}?[0-9]{{4}}\s?)?[一-鿿]{{1,4}}[都道府県][{_H}]{{1,24}}?(?:[0-9一二三四五六七八九十]{{1,3}}丁目(?:[0-9]{{1,4}}番地?(?:[0-9]{{1,4}}号?)?)?|[0-9]{{1,4}}番地?(?:[0-9]{{1,4}}号?)?|[0-9]{{1,4}}(?:{_D}[0-9]{{1,4}}){{1,3}})(?: ?(?:{BUILDINGS})[^\s0-9、。]{{0,8}} ?[0-9]{{1,5}}(?:号室)?)?"
)
CN_ADDRESS = re.compile(rf"(?:(?:{CN_REGIONS})(?:省|市|自治区)?(?:[一-鿿]{{2,4}}?市)?|[一-鿿]{{2}}市)[一-鿿]{{1,16}}?[路街道巷弄] ?[0-9]{{1,5}}号(?:[0-9]{{1,3}}[栋楼幢])?(?:[0-9]{{1,5}}室)?")
JP_MARK = re.compile(rf"〒 ?[0-9]{{3}}{_D}?[0-9]{{4}}\s?\Z")
_FOLD = {c: unicodedata.normalize("NFD", chr(c))[0] for c in range(0x80, 0x200)} | str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "ı": "i"})


def fold(text: str) -> str:
    """Lower case without accents, of the same length."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low if low.isascii() else low.translate(_FOLD)


Put = Callable[[int, int, str], None]


class Finder:
    """Occurrences of personal information in a text."""

    def __init__(self, staff: list[tuple[str | None, str | None, str | None]], model: LookalikeModel | None = None) -> None:
        """staff: (given, family, local 'family given'); a table of bounded size."""
        self.rewrite = Rewriter(model or LookalikeModel.fit({}, {})).rewrite
        self.given = {fold(g.strip()) for g, _, _ in staff if g and g.strip()}
        self.family = {fold(f.strip()) for _, f, _ in staff if f and f.strip()}
        local = [x.split() for _, _, x in staff if x and len(x.split()) == 2]
        lf, self.local_given = {x[0] for x in local}, {x[1] for x in local}
        self.local_sizes = sorted({len(x) for x in self.local_given}, reverse=True)
        self.given_sizes = sorted({len(x) for x in self.given}, reverse=True)
        self.given_words = max([len(x.split()) for x in self.given], default=1)
        self.titled = re.compile(r"(?<![\w@.+-])(?:Mrs|Mr|Ms|Dr|Prof|Mme|Herr|Frau|Sra|Sr)\.? (?:[A-ZÀ-Þ]\. )?[A-ZÀ-Þ][\w'’-]+(?: [A-ZÀ-Þ][a-zß-ÿ][\w'’-]*(?= (?:[a-zß-ÿ<]|at )|[,;)]))?(?![\w@])")
        auto = ahocorasick.Automaton()
        add = lambda words, kind: [auto.add_word(w, (kind, len(w))) for w in words if w not in auto]
        add(AT_FORMS, "email")
        add((" dot ",), "spoken")
        add(ID_CUES, "id")
        add((fold(w) for w in CALLS), "call")
        add((f" {s}" for s in STREETS.lower().split("|")), "street")
        add(("box ",), "box")
        add((fold(s).replace("\\", "") for s in DE_STREETS.split("|")), "de")
        add(("am ", "an der ", "an den ", "im ", "zum ", "zur ", "auf dem ", "unter den ", "hinter der "), "de_at")
        add((f"{fold(s)} " for s in FR_STREETS.split("|")), "fr")
        add((fold(w) for w in SOUTH_STREETS), "south")
        add("都道府県", "jp")
        add("路街巷弄", "cn")
        add((f"{t}{dot} " for t in TITLES.lower().split("|") if len(t) > 1 for dot in ("", ".")), "title")
        add(self.family, "name")
        add(lf, "local")
        auto.make_automaton()
        self.auto = auto

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) in reading order, not overlapping; offsets in ``text``."""
        t, anchors = self.rewrite(text)
        low = fold(t)
        seen: dict[str, list[tuple[int, int]]] = {}
        for end, (kind, n) in self.auto.iter(low):
            seen.setdefault(kind, []).append((end - n + 1, end + 1))
        numbers = DIGIT.search(t) is not None
        if not seen and not numbers:
            return []
        spans: list[tuple[int, int, str]] = []
        taken = bytearray(len(t))

        def put(a: int, b: int, kind: str) -> None:
            if taken.find(1, a, b) < 0:
                spans.append((a, b, kind))
                taken[a:b] = b"\1" * (b - a)

        for a, _ in seen.get("email", ()):
            _mail(t, a, put)
        for a, b in seen.get("spoken", ()):
            _spoken_mail(t, low, a, b, put)
        if numbers:
            for a, b in seen.get("id", ()):
                _identity(t, low, a, b, put)
            for kind in ("street", "box", "de", "de_at", "fr", "south", "jp", "cn"):
                if kind in seen:
                    _addresses(t, low, kind, seen[kind], put)
            _numbers(t, put)
            for _, b in seen.get("call", ()):
                _called(t, b, put)
        if "name" in seen or "title" in seen or "local" in seen:
            pieces, at = [], 0
            for a, b, _ in sorted(spans):  # what is taken is no part of a name
                pieces += [low[at:a], "\0" * (b - a)]
                at = b
            low = "".join([*pieces, low[at:]])
            done = 0
            for a, b in sorted(seen.get("name", ()), key=lambda x: (x[0], -x[1])):
                m = self._person(low, a, b, done)
                if m:
                    done = m[1]
                    if not COMPANY.match(t, m[1]) and not BEFORE_NAME.search(t, max(0, m[0] - 12), m[0]) and _cased(t[m[0] : m[1]]):
                        put(*m, "person_name")
            for a, _ in seen.get("title", ()):  # a title names a person that no table knows
                m = self.titled.match(t, a)
                if m and not COMPANY.match(t, m.end()):
                    put(*m.span(), "person_name")
            for a, b in seen.get("local", ()):
                self._local(t, a, b, put)
        spans.sort()
        if t == text:
            return spans
        return [(source_offset(anchors, a), source_offset(anchors, b - 1) + 1 if b > a else a, k) for a, b, k in spans]

    def _person(self, low: str, a: int, b: int, done: int) -> tuple[int, int] | None:
        """The name around the family name low[a:b]: title, given name or initials before it, or a given name after a comma."""
        if low[b : b + 2] == ", ":
            end = self._given_after(low, b + 2)
            start = _titled(low, a, done)
            if end and _edge(low, start) and start >= done:
                return start, end
        if not _name_end(low, b) or a < 2 or low[a - 1] != " ":
            return None
        h = a - 1
        initials = 0
        at = h
        while initials < 2 and at >= 2 and low[at - 1] == "." and low[at - 2].isalpha() and low[at - 2].isascii() and (at == 2 or not _word_char(low[at - 3])):
            initials += 1
            at -= 2
            if initials == 2 or at == 0 or low[at - 1] != " ":
                break
            nxt = at - 1
            if not (nxt >= 2 and low[nxt - 1] == "." and low[nxt - 2].isalpha()):
                break
            at = nxt
        for stop in ([h] if not initials else [h, h - 3]):  # given name, or given name and one initial
            g = self._given_before(low, stop)
            if g is not None and _edge(low, g):
                start = _titled(low, g, done)
                return (start, b) if start >= done else None
        if initials and _edge(low, at) and at >= done:
            start = _titled(low, at, done)
            return start, b
        start = _titled(low, a, done)
        return (start, b) if start < a and start >= done else None

    def _given_before(self, low: str, end: int) -> int | None:
        """Start of the longest given name that ends at ``end``."""
        if end <= 0:
            return None
        s, best = end, None
        for _ in range(self.given_words):
            while s > 0 and (low[s - 1].isalnum() or low[s - 1] in "'’-"):
                s -= 1
            if low[s:end] in self.given:
                best = s
            if s == 0 or low[s - 1] != " ":
                break
            s -= 1
        return best

    def _given_after(self, low: str, at: int) -> int | None:
        """End of the given name that begins at ``at``, with an initial after it; none if a family name follows."""
        for n in self.given_sizes:
            if at + n <= len(low) and low[at : at + n] in self.given and _name_end(low, at + n):
                end = at + n
                break
        else:
            return None
        rest = INITIAL.match(low, end)
        tail = rest.end() if rest else end
        if low[tail : tail + 1] == " ":
            w = WORDS.match(low, tail + 1)
            if w and (w.group() in self.family or any(f in self.family for f in _starts(w.group()))):
                return None
        return rest.end() if rest and _name_end(low, rest.end()) else end

    def _local(self, t: str, a: int, b: int, put: Put) -> None:
        at = b + 1 if t[b : b + 1] == " " else b
        for n in self.local_sizes:
            if at + n <= len(t) and t[at : at + n] in self.local_given:
                m = HONORIFIC.match(t, at + n)
                return put(a, m.end() if m else at + n, "person_name")
        m = HONORIFIC.match(t, b)
        if m:
            put(a, m.end(), "person_name")


DIGIT = re.compile("[0-9]")
INITIAL = re.compile(r" [a-z]\.")
WORDS = re.compile(r"(?:[a-z]\. )?[\w'’-]+(?: [\w'’-]+)?")
HONORIFIC = re.compile(rf" ?(?:{HONORIFICS})")
TITLE_BEFORE = frozenset(TITLES.lower().split("|"))
NOT_AFTER = re.compile(r"[\w@]|[.+-]\w*@|-[a-z]")
CANDIDATE = re.compile(r"(?<!\w)[\w〒]")


def _word_char(c: str) -> bool:
    return c.isalnum() or c in "_@.+-"


def _edge(low: str, at: int) -> bool:
    return at == 0 or not _word_char(low[at - 1])


def _name_end(low: str, at: int) -> bool:
    return NOT_AFTER.match(low, at) is None


def _starts(words: str) -> list[str]:
    """A following name with and without its initial, one word or two."""
    w = words[3:] if words[1:3] == ". " else words
    return [w, w.split(" ")[0]]


def _titled(low: str, at: int, done: int) -> int:
    """Start of a title before ``at``, or ``at``."""
    if at < 2 or low[at - 1] != " ":
        return at
    e = at - 1
    s = e - 1 if low[e - 1] == "." else e
    a = s
    while a > done and low[a - 1].isalpha():
        a -= 1
    return a if low[a:s] in TITLE_BEFORE and _edge(low, a) else at


def _domain(t: str, at: int) -> int | None:
    """End of the host name at ``at``: labels and dots as far as they go, back to the last alphabetic one."""
    end, n = None, 0
    while m := LABEL.match(t, at):
        n += 1
        if n > 1 and len(m.group()) > 1 and m.group().replace("-", "").isalpha():
            end = m.end()
        d = DOT.match(t, m.end())
        if not d:
            break
        at = d.end()
    return end


def _mail(t: str, at: int, put: Put) -> None:
    """Local part to the left and host to the right of an at-sign, as far as their characters go."""
    sign = AT.match(t, at)
    i = at
    if i and t[i - 1].isspace() and t[i - 1] not in "\r\n":
        i -= 1
    a = i
    while a and LOCAL_CHAR.match(t[a - 1]):
        a -= 1
    while a < i and not t[a].isalnum():
        a += 1
    j = sign.end()
    if j < len(t) and t[j].isspace() and t[j] not in "\r\n":
        j += 1
    end = _domain(t, j)
    if a < i and end:
        put(a, end, "email")


def _spoken_mail(t: str, low: str, a: int, b: int, put: Put) -> None:
    """name at host dot com: from the first spoken dot back over labels to ' at ' and the local part."""
    i = a
    while True:
        s = i
        while s and (t[s - 1].isalnum() or t[s - 1] in "-."):
            s -= 1
        if s == i:
            return
        if low.endswith(" at ", 0, s):
            break
        if not low.endswith(" dot ", 0, s):
            return
        i = s - 5
    i = s - 4
    c = i
    while c and LOCAL_CHAR.match(t[c - 1]):
        c -= 1
    while c < i and not t[c].isalnum():
        c += 1
    end = _domain(t, s)
    if c < i and end and end > b:
        put(c, end, "email")


def _identity(t: str, low: str, a: int, b: int, put: Put) -> None:
    if a and low[a].isascii() and (low[a - 1].isalnum() or low[a - 1] in "_-"):
        return
    m = ID_VALUE.match(t, b)
    if m and sum(c.isdigit() for c in m.group(1)) >= 5:
        put(*m.span(1), "id_number")


def _numbers(t: str, put: Put) -> None:
    """Each digit run calls the number parsers where it begins."""
    done, han = 0, None
    for s in NUMBER_START.finditer(t):
        for at in (s.start(),) if t[s.start()] != "(" else (s.start(), s.start() + 1):
            if at < done:
                continue
            m = BARE_ID.match(t, at)
            if m and not NEGATIVE.search(t, max(0, at - 24), at):
                put(*m.span(), "id_number")
            m = PHONES.match(t, at)
            if m is None and (m := CN_MOBILE.match(t, at)):
                han = bool(HAN.search(t)) if han is None else han
                m = m if han else None
            if m is None:
                continue
            done = m.end()
            n = sum(c.isdigit() for c in m.group())
            if 9 <= n <= 22 and not NEGATIVE.search(t, max(0, at - 24), at):
                put(*m.span(), "phone")


def _called(t: str, at: int, put: Put) -> None:
    """A number that its text calls a telephone number, in any grouping."""
    m = CALLED.match(t, at)
    if m and not DATE_LIKE.match(m.group(1)):
        put(*m.span(1), "phone")


def _tokens_back(t: str, at: int, n: int, floor: int) -> int:
    """Start of the n-th blank-separated token before ``at``."""
    for _ in range(n):
        while at > floor and t[at - 1].isspace():
            at -= 1
        while at > floor and not t[at - 1].isspace():
            at -= 1
    return at


def _addresses(t: str, low: str, kind: str, at: list[tuple[int, int]], put: Put) -> None:
    """From each street word, box or region mark left to where an address can begin, then its parser."""
    done = 0
    for a, b in at:
        if a < done:
            continue
        nxt = low[b : b + 1]
        if kind == "street":  # unit, number, direction and up to three names before the street word
            if nxt.isalpha():
                continue
            m = _first(EN_ADDRESS, t, _tokens_back(t, a, 8, done), a)
        elif kind == "box":
            m = _first(BOX_ADDRESS, t, _tokens_back(t, a, 3, done), a + 1)
        elif kind == "de":
            if nxt != " " or not low[b + 1 : b + 2].isdigit():
                continue
            s = a
            while s > done and (t[s - 1].isalnum() or t[s - 1] in "-_"):
                s -= 1
            m = _first(DE_ADDRESS, t, s, b)
        elif kind in ("de_at", "south"):
            m = None if a and low[a - 1].isalnum() else (DE_ADDRESS if kind == "de_at" else SOUTH_ADDRESS).match(t, a)
        elif kind == "fr":
            m = None if a and low[a - 1].isalnum() else _first(FR_ADDRESS, t, _tokens_back(t, a, 2, done), a)
        elif kind == "jp":
            s = a
            while s > max(done, a - 4) and HAN.match(t[s - 1]):
                s -= 1
            mark = JP_MARK.search(t, max(done, s - 12), s) if s else None
            m = next((x for p in ([mark.start()] if mark else []) + list(range(s, a)) if (x := JP_ADDRESS.match(t, p))), None)
        else:  # cn
            if not low[b : b + 2].strip()[:1].isdigit():
                continue
            s = a
            while s > done and HAN.match(t[s - 1]):
                s -= 1
            m = next((x for p in range(max(s, a - 32), a) if (x := CN_ADDRESS.match(t, p))), None)
        if m:
            done = m.end()
            put(*m.span(), "address")


def _first(p: re.Pattern, t: str, lo: int, hi: int) -> re.Match | None:
    """The match that begins first at a word of t[lo:hi]; it may end anywhere."""
    for c in CANDIDATE.finditer(t, lo, hi):
        if m := p.match(t, c.start()):
            return m
    return None


def _cased(name: str) -> bool:
    """A name written all in lower case needs given and family name; others a capital."""
    return not name.islower() or " " in name and "." not in name


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS], [PERSON_NAME] in place of the spans."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _staff_rows(staff: DataFrame, limit: int) -> list[tuple[str | None, str | None, str | None]]:
    rows = [tuple(r) for r in staff.select("given_name", "family_name", "local_name").distinct().limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError(f"the staff table holds more than {limit} names; raise max_staff if the workers can hold them")
    return rows


def find_personal(df: DataFrame, staff: DataFrame, model: LookalikeModel, key: str, columns: list[str], max_staff: int = 500_000) -> DataFrame:
    """(key, field_name, pii_kind, occurrence_no): occurrences of a kind count from 1 in reading order.

    Null and empty texts have none; a row delivered again counts once."""
    rows = _staff_rows(staff, max_staff)
    shared = df.sparkSession.sparkContext.broadcast((rows, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(*shared.value)
        memo: dict[str, list[str]] = {}
        for b in batches:
            out: dict[str, list] = {"k": [], "field_name": [], "pii_kind": [], "occurrence_no": []}
            ids = b.column(0).to_pylist()
            for c in columns:
                for k, text in zip(ids, b.column(c).to_pylist()):
                    if not text:
                        continue
                    kinds = memo.get(text)
                    if kinds is None:
                        kinds = [x for _, _, x in finder.find(text)]
                        if len(text) < 80:
                            if len(memo) > 50_000:
                                memo.clear()
                            memo[text] = kinds
                    n: dict[str, int] = {}
                    for kind in kinds:
                        n[kind] = n.get(kind, 0) + 1
                        for name, v in zip(out, (k, c, kind, n[kind])):
                            out[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["k"], pa.string()), pa.array(out["field_name"], pa.string()), pa.array(out["pii_kind"], pa.string()), pa.array(out["occurrence_no"], pa.int32())], names=list(out))

    cols = [F.col(key).cast("string").alias("__k"), *[F.col(c).cast("string").alias(c) for c in columns]]
    return df.select(*cols).mapInArrow(run, "k string, field_name string, pii_kind string, occurrence_no int").distinct().withColumnRenamed("k", key)


def redact_personal(df: DataFrame, staff: DataFrame, model: LookalikeModel, columns: list[str], suffix: str = "_safe", max_staff: int = 500_000) -> DataFrame:
    """Adds ``<column><suffix>``: the text with placeholders, all else unchanged; null stays null."""
    shared = df.sparkSession.sparkContext.broadcast((_staff_rows(staff, max_staff), model))
    held: list[Finder] = []

    @F.pandas_udf("string")
    def safe(s: pd.Series) -> pd.Series:
        if not held:
            held.append(Finder(*shared.value))
        return s.map(lambda t: redact(t, held[0].find(t)) if t else t)

    return df.withColumns({c + suffix: safe(F.col(c)) for c in columns})
