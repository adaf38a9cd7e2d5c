import unicodedata

import pytest
from hypothesis import given, settings, strategies as st

from opweave.llm.lookalikes import LookalikeModel, Rewriter, UnionFind, consistent_form, deviating_fields, fit_lookalikes, source_offset

PLAIN = LookalikeModel.fit({}, {"EXP": 500, "Case": 300, "データ一覧": 50, "デ一タ一覧": 2, "モニター": 40})
R = Rewriter(PLAIN)


@pytest.mark.parametrize(
    "text,form",
    [
        ("ＡＢ１２ ｃ", "AB12 c"), ("ﾀﾞｯｼｭﾎﾞｰﾄﾞ", "ダッシュボード"), ("ﾊﾟ", "パ"), ("café", "café"), ("が", "が"), ("a​b­c﻿", "abc"), ("a b　c d", "a b c d"),
        ("с​trl", "ctrl"), ("Wеbνіew", "Webview"), ("flօor", "floor"), ("расходoв", "расходов"), ("⾦額", "金額"), ("Å", "Å"), ("デ一タ一覧", "データ一覧"), ("モ二ター", "モニター"), ("ЕХР-12 paid", "EXP-12 paid"), ("Саѕе", "Case"),
    ],
)
def test_rewrites(text, form):
    assert R(text) == form


@pytest.mark.parametrize(
    "text",
    ["", "plain", "План А: отчёт за март", "ОТЧЁТ ЗА МАРТ", "Τιμολόγιο Σ 12", "می‌خواهم", "👩‍💻 ok", "क्‍ष", "（全角）：！", "x² ½ ①", "a\nb\r\n", "PDF-отчёт готов", "三ツ峰 二件 八重樫", "naïve Übung", "ビル八階", "don’t", "हिन्दी में", "ไทย"],
)
def test_kept(text):
    assert R(text) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aеｂ́é​が゙ﾀﾞ 二ニ Σσ\n", max_size=25))
def test_idempotent_and_composed(text):
    once, anchors = R.rewrite(text)
    assert R(once) == once and unicodedata.is_normalized("NFC", once)
    offs = [source_offset(anchors, i) for i in range(len(once))]
    assert offs == sorted(offs) and all(0 <= o < max(1, len(text)) for o in offs)


def test_union_is_transitive():
    u = UnionFind()
    for a, b in (("a", "b"), ("c", "d"), ("b", "c")):
        u.union(a, b)
    assert {frozenset(c) for c in u.classes().values()} == {frozenset("abcd")}


def test_spark(spark):
    rows = [("1", "ＡＢ", None, "x"), ("1", "ＡＢ", None, "again"), ("2", None, "", "x"), ("3", "ok", "ok​" * 5000, "x"), ("4", "ok", "ok", "x")]
    df = spark.createDataFrame(rows, "id string, text string, window string, text_form_other string")
    m = fit_lookalikes(df, ["text", "window"])
    got = {tuple(r) for r in deviating_fields(df, m, "id", ["text", "window"]).collect()}
    assert got == {("1", "text"), ("3", "window")}
    f = {r.id: (r.text_form, r.window_form) for r in consistent_form(df, m, ["text", "window"]).collect()}
    assert f["1"] == ("AB", None) and f["2"] == (None, "") and f["3"][1] == "ok" * 5000
    assert deviating_fields(df.limit(0), fit_lookalikes(df.limit(0), ["text"]), "id", ["text"]).count() == 0


@pytest.mark.parametrize("times", [1, 7, 1000])
def test_decisions_do_not_depend_on_size(times):
    words = {"ВЕСНА": 1 * times, "BECHA": 0, "СОР": 2 * times, "COP": 30 * times, "НОТА": 9 * times, "HOTA": 5 * times}
    m = LookalikeModel.fit({}, {w: n for w, n in words.items() if n})
    r = Rewriter(m)
    assert r("СОР") == "COP" and r("ВЕСНА") == "ВЕСНА" and r("НОТА") == "НОТА"


def test_long_words_have_classes(spark):
    long = "сорасеохсорасеохсорасеох"
    latin = "".join({"с": "c", "о": "o", "р": "p", "а": "a", "е": "e", "х": "x"}[c] for c in long)
    df = spark.createDataFrame([(latin,)] * 9 + [(long,), (None,), ("",)], "t string")
    m = fit_lookalikes(df, ["t"])
    assert Rewriter(m)(long) == latin
    assert fit_lookalikes(df.limit(0), ["t"]).strings == {}
