import pytest

from opweave.llm.sentences import SentenceModel, learn_sentences, sentence_spans, sentence_units

MODEL = SentenceModel(
    {"en": {"incl", "approx", "dr", "e.g", "ltd", "no"}, "de": {"nr", "z", "b", "okt"}, "fr": {"m"}, "es": {"sr"}, "ar": {"د"}, "hi": {"रु"}},
    {"en": {"The", "Nobody", "Stop"}, "de": {"Die"}},
    {"de": {("##", "Tag"), ("##", "März")}},
)


@pytest.mark.parametrize(
    "text,lang,units",
    [
        ("It was approx. 44 items, incl. Sales, by Orlin Ltd. Stop now! Really?! Yes.", "en", ["It was approx. 44 items, incl. Sales, by Orlin Ltd.", "Stop now!", "Really?!", "Yes."]),
        ("Dr. Who paid 92,075.99. Nobody knew ... the log ended... The end", "en", ["Dr. Who paid 92,075.99.", "Nobody knew ... the log ended...", "The end"]),
        ('The note said "Missing. Ask first." and nothing else. "Approved." The end.', "en", ['The note said "Missing. Ask first." and nothing else.', '"Approved."', "The end."]),
        ("1. Scope\r\n- a item. \n\n  x; y z", "en", ["1. Scope", "- a item.", "x; y", "z"]),
        ("Der Beleg Nr. 7 am 88. Tag. Die Datei z. B. am 3. März.", "de", ["Der Beleg Nr. 7 am 88. Tag.", "Die Datei z. B. am 3. März."]),
        ("Arrêtez l'envoi ! « Ne fermez pas. Elle enregistre », a écrit M. Ferrolli. La cause", "fr", ["Arrêtez l'envoi !", "« Ne fermez pas. Elle enregistre », a écrit M. Ferrolli.", "La cause"]),
        ("金額は３．５万円。「なぜですか？」と尋ねた。え！？版（詳細は見る。担当）。原因は不明…ログ", "ja", ["金額は３．５万円。", "「なぜですか？」と尋ねた。", "え！？", "版（詳細は見る。担当）。", "原因は不明…ログ"]),
        ("“先核对。再付款。”她写道。真的吗？！文件v2.1.txt；请复核。", "zh", ["“先核对。再付款。”她写道。", "真的吗？！", "文件v2.1.txt；请复核。"]),
        ("राशि रु. 50 है। “रसीद नहीं। देखें।” ऐसा लिखा था। अब!", "hi", ["राशि रु. 50 है।", "“रसीद नहीं। देखें।” ऐसा लिखा था।", "अब!"]),
        ("راجع د. سليم الملف. قال: «لا تغلق. إنها تحفظ.» ثم خرج.", "ar", ["راجع د. سليم الملف.", "قال: «لا تغلق. إنها تحفظ.» ثم خرج."]),
        ("กรุณาหยุด พนักงานแก้ไข PO-1 แล้ว", "th", ["กรุณาหยุด", "พนักงานแก้ไข PO-1 แล้ว"]),
        (" \t　\n", "en", []),
    ],
)
def test_units(text, lang, units):
    spans = sentence_spans(text, lang, MODEL)
    assert [text[a:b] for a, b in spans] == units


def test_learns_abbreviations(spark):
    texts = [(i, f"The clerk met Dr. Kovar{i % 7} on time. Nobody paid approx. {i} items! The office closed... Stop it! Nobody came?", "EN", "x") for i in range(60)] + [(100, None, "en", "x"), (101, "", None, "x"), (102, "  ", None, "x"), (103, "A. " * 50_000, "en", "x")]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, sent_start string")
    m = learn_sentences(df, "text", "lang")
    assert {"dr", "approx"} <= m.abbreviations["en"] and "time" not in m.abbreviations["en"] and "Nobody" in m.starters["en"]
    got = [r for r in sentence_units(df, "doc_id", "text", "lang", m).collect() if r.doc_id == 0]
    assert len(got) == 5
    assert sentence_units(df.limit(0), "doc_id", "text", "lang", m).count() == 0
    assert learn_sentences(df.limit(0), "text", "lang").abbreviations == {}


@pytest.mark.parametrize(
    "text,units",
    [
        ("ខ្ញុំទៅផ្សារ។គាត់ទៅសាលា។", ["ខ្ញុំទៅផ្សារ។", "គាត់ទៅសាលា។"]),
        ("Նա եկավ։ Մենք գնացինք։", ["Նա եկավ։", "Մենք գնացինք։"]),
        ("ကျွန်တော်သွားသည်။သူလာသည်။", ["ကျွန်တော်သွားသည်။", "သူလာသည်။"]),
        ("እኔ ሄድኩ። እሱ መጣ፧ አዎ።", ["እኔ ሄድኩ።", "እሱ መጣ፧", "አዎ።"]),
        ("Он пришёл. Мы ушли! Да?", ["Он пришёл.", "Мы ушли!", "Да?"]),
        ("میں آیا۔ وہ گیا؟ ہاں۔", ["میں آیا۔", "وہ گیا؟", "ہاں۔"]),
        ("그는 왔다. 우리는 갔다.", ["그는 왔다.", "우리는 갔다."]),
        ("x" * 3_000_000 + ". Next one. " + "A.b" * 1_000_000, ["x" * 3_000_000 + ".", "Next one.", "A.b" * 1_000_000]),
    ],
)
def test_scripts(text, units):
    assert [text[a:b] for a, b in sentence_spans(text, "", MODEL)] == units


def test_each_language_learns_its_own(spark):
    parts = {  # with an abbreviation, and sentences whose last words differ
        "it": (["Il dott. Rossi è arrivato alle {} ore.", "Anche il sig. Verdi ha visto il {} libro."], "Non ha detto {}! Questo è il {} della sala.", ["dott", "sig"]),
        "pt": (["O sr. Silva não viu o {} livro.", "Ele falou com a dra. Costa pela {} vez."], "Também não {}! Isso foi pelo {} motivo.", ["sr", "dra"]),
        "ru": (["Это г. Москва на {} карте.", "Мы видели стр. Пять в {} книге."], "Никто не {}! Она ушла {} домой.", ["г", "стр"]),
    }
    words = [a + b for a in "abcdefgh" for b in "klmnoprs"]
    docs = [(lg, " ".join([two[i % 2].format(w), rest.format(w, w), f"{w}."]).replace("{}", w)) for lg, (two, rest, _) in parts.items() for i, w in enumerate(words)]
    df = spark.createDataFrame([(i, t, lg) for i, (lg, t) in enumerate(docs)], "doc_id long, text string, lang string")
    m = learn_sentences(df, "text", "lang")
    for lg, (two, rest, abbr) in parts.items():
        assert set(abbr) <= m.abbreviations[lg], lg
        text = two[0].format("x") + " " + two[1].format("y")
        assert not any(text[a:b].endswith(f" {w}.") for a, b in sentence_spans(text, "", m) for w in abbr), lg
