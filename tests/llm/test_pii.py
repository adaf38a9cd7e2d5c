import pytest

from opweave.llm.lookalikes import LookalikeModel
from opweave.llm.pii import Finder, find_personal, fold, redact, redact_personal

STAFF = [("Sølvi", "Dunskaya", "榎森 琴葉"), ("Petra-Lou", "Nakasone-Rill", None), (None, "Uliveri", None), ("Joaquín", None, None)]
F = Finder(STAFF)


@pytest.mark.parametrize(
    "text,safe",
    [
        ("mail a.b+c@x-y.example, D (at) mail.x.example or e [at] x [dot] example.", "mail [EMAIL], [EMAIL] or [EMAIL]."),
        ("name@ missing; @finance; B91@Sheet9; 50 pcs @ 46,545.19", "name@ missing; @finance; B91@Sheet9; 50 pcs @ 46,545.19"),
        ("+1 748 555 0159 / (740) 555-0182 ext. 688 / +49 (0)30 23125-996 / 01.99.00.16.35", "[PHONE] / [PHONE] / [PHONE] / [PHONE]"),
        ("TEL 06（0914）0041 ０８０－００７２－０５１２ +81 3 0646 6673 内線427 07005255241 0120-087-116", "TEL [PHONE] [PHONE] [PHONE] [PHONE] [PHONE]"),
        ("order 6377-1023-1624, serial 090-6285-18, counter 0030-5445-9579, 10.217.70.34, 2024-08-23", "order 6377-1023-1624, serial 090-6285-18, counter 0030-5445-9579, 10.217.70.34, 2024-08-23"),
        ("SSN 912-15-7186, 970-94-3049, part no. 973-72-6338", "SSN [ID_NUMBER], [ID_NUMBER], part no. 973-72-6338"),
        ("passport no. XW4057652 / Steuer-ID 71 949 615 286 / NI number QQ 81 85 35 D / 個人番号：202794705690", "passport no. [ID_NUMBER] / Steuer-ID [ID_NUMBER] / NI number [ID_NUMBER] / 個人番号：[ID_NUMBER]"),
        ("Passport scanner offline; SSN column hidden in ledger_12345678.csv", "Passport scanner offline; SSN column hidden in ledger_12345678.csv"),
        ("54 Willowmere Court, Apt 21C, Kettering Falls ok", "[ADDRESS] ok"),
        ("Flat 8, 18 Alder Mill Road, Saltmarsh Bay ZQ2 6XX; P.O. Box 6416, Fernvale 99934", "[ADDRESS]; [ADDRESS]"),
        ("Am Mühlgraben 64b, 99920 Neu-Erlenbach; 18 bis, rue des Tilleuls, 99932 La Chênaie", "[ADDRESS]; [ADDRESS]"),
        ("〒997-3527 東雲県緑町本町2-6-16 / 青葉県霧ヶ原市本町8丁目9番6号 コーポ楓376", "[ADDRESS] / [ADDRESS]"),
        ("Row 12 of 480 Harbour Rise depot closed; 霧ヶ原市の統計", "Row 12 of 480 Harbour Rise depot closed; 霧ヶ原市の統計"),
        ("Dear Dr. DUNSKAYA, Solvi Dunskaya and Nakasone-Rill, Petra-Lou; S. Uliveri", "Dear [PERSON_NAME], [PERSON_NAME] and [PERSON_NAME]; [PERSON_NAME]"),
        ("Project Uliveri: Uliveri & Sons, Uliveri GmbH, Petra release, EMP-0012", "Project Uliveri: Uliveri & Sons, Uliveri GmbH, Petra release, EMP-0012"),
        ("榎森部長と榎森琴葉様、担当者様", "[PERSON_NAME]と[PERSON_NAME]、担当者様"),
        ("Dear Dr. Kowalski, Mrs Ann Baker approved; Herr/Frau auswählen; Mr. Kovar GmbH", "Dear [PERSON_NAME], [PERSON_NAME] approved; Herr/Frau auswählen; Mr. Kovar GmbH"),
        ("petra-lou.nakasone-rill@x.example", "[EMAIL]"),
        ("a​b@x.exаmple ​!", "[EMAIL] ​!"),
    ],
)
def test_redaction(text, safe):
    assert redact(text, F.find(text)) == safe


def test_fold_keeps_length():
    for t in ("İstanbul", "Ærø ǅ", "ﬁ", "É"):
        assert len(fold(t)) == len(t)


def test_long_and_empty():
    assert F.find("") == [] and F.find("x" * 200_000) == []
    assert len(F.find("a@b.example " * 3000)) == 3000
    assert Finder([], LookalikeModel()).find("榎森部長 Uliveri") == []


def test_spark(spark):
    rows = [("1", "a@b.example c@d.example", None, "z"), ("1", "a@b.example c@d.example", None, "z"), ("2", None, "", "z"), (None, "ok", "SSN 912-15-7186", "z")]
    df = spark.createDataFrame(rows, "activity_id string, text string, screen_text string, pii_kind string")
    staff = spark.createDataFrame([("A", "B", None)], "given_name string, family_name string, local_name string")
    got = {tuple(r) for r in find_personal(df, staff, LookalikeModel(), "activity_id", ["text", "screen_text"]).collect()}
    assert got == {("1", "text", "email", 1), ("1", "text", "email", 2), (None, "screen_text", "id_number", 1)}
    safe = [r.text_safe for r in redact_personal(df, staff, LookalikeModel(), ["text"]).collect()]
    assert safe.count("[EMAIL] [EMAIL]") == 2 and None in safe
    assert find_personal(df.limit(0), staff, LookalikeModel(), "activity_id", ["text"]).count() == 0
    with pytest.raises(ValueError):
        find_personal(df, staff, LookalikeModel(), "activity_id", ["text"], max_staff=0)


def _safe(finder, text):
    return redact(text, finder.find(text))


def test_no_window_ends_an_address():
    f = Finder([("Anna", "Smith", "山田 太郎"), ("Jean Luc", "Picard", None)])
    for c in (30, 38, 46, 400, 40_000):
        assert _safe(f, f"to {'a' * 30}@{'b' * 60}.{'c' * c}.example.com end") == "to [EMAIL] end"
    assert _safe(f, "l" * 300 + "@example.com") == "[EMAIL]"
    assert _safe(f, "see " + ("word " * 2_000_000) + "x@example.com") == "see " + ("word " * 2_000_000) + "[EMAIL]"


@pytest.mark.parametrize(
    "text,want",
    [
        ("Calle Mayor 12, 28013 Madrid", "[ADDRESS]"),
        ("地址：北京市朝阳区建国路88号", "地址：[ADDRESS]"),
        ("call 5551234567", "call [PHONE]"),
        ("联系我 13812345678 谢谢", "联系我 [PHONE] 谢谢"),
        ("order 13812345678 谢谢", "order 13812345678 谢谢"),
        ("call 2024-07-17 x", "call 2024-07-17 x"),
        ("user at example dot com", "[EMAIL]"),
        ("john.doe at mail dot example dot com now", "[EMAIL] now"),
        ("メールはtaro@example.comまで", "メールは[EMAIL]まで"),
        ("müller@bücher.de!", "[EMAIL]!"),
        ("a@b and @ and x@", "a@b and @ and x@"),
        ("x@a.b.c.d.e.org.", "[EMAIL]."),
        ("see Jean Luc Picard", "see [PERSON_NAME]"),
        ("Dr. A. Smith and Smith, Anna", "[PERSON_NAME] and [PERSON_NAME]"),
        ("山田太郎さんと山田様", "[PERSON_NAME]と[PERSON_NAME]"),
    ],
)
def test_kinds_beyond_one_country(text, want):
    assert _safe(Finder([("Anna", "Smith", "山田 太郎"), ("Jean Luc", "Picard", None)]), text) == want
