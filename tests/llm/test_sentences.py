import pytest

from strandmill.llm.sentences import sentence_units, units


def parts(text, tag=None):
    return [text[a:z] for a, z in units(text, tag)]


CASES = [
    ("en", "Dr. A. B. Smith paid 3.50 to Foo Inc. in May. He left at 5 p.m. Then it rained.", ["Dr. A. B. Smith paid 3.50 to Foo Inc. in May.", "He left at 5 p.m.", "Then it rained."]),
    ("en", "“Is it late?” asked the man. “Go!” He went... and came... Then slept", ["“Is it late?” asked the man.", "“Go!”", "He went... and came...", "Then slept"]),
    ("en", "1. See Sec. 4.2 (Fig. 3) of it.Next one. (All done.) Bye", ["1. See Sec. 4.2 (Fig. 3) of it.", "Next one.", "(All done.)", "Bye"]),
    ("de", "Er kam am 7. Mai, z. B. mit Hr. Meyer usw. »Gut?« Er ging.", ["Er kam am 7. Mai, z. B. mit Hr. Meyer usw.", "»Gut?«", "Er ging."]),
    ("fr", "« Oui ? » dit M. Blanc. Voir p. ex. le vol. 3 ! Fin", ["« Oui ? » dit M. Blanc.", "Voir p. ex. le vol. 3 !", "Fin"]),
    ("es", "«¿Vas?» dijo la Sra. Paz. ¿Y tú? ¡No!", ["«¿Vas?» dijo la Sra. Paz.", "¿Y tú?", "¡No!"]),
    ("ru", "Он жил на ул. Мира в г. Омск и т. д. Потом уехал. «Да?» спросила та.", ["Он жил на ул. Мира в г. Омск и т. д.", "Потом уехал.", "«Да?» спросила та."]),
    ("el", "Τι είναι; Ο κ. Νίκος λέει π.χ. ναι. Α;", ["Τι είναι;", "Ο κ. Νίκος λέει π.χ. ναι.", "Α;"]),
    ("hi", "डॉ. राम आए। “क्या?” उसने पूछा। फिर गए।", ["डॉ. राम आए।", "“क्या?” उसने पूछा।", "फिर गए।"]),
    ("ar", "قال د. علي نعم. “هل؟” قال زيد. انتهى؟ لا.", ["قال د. علي نعم.", "“هل؟” قال زيد.", "انتهى؟", "لا."]),
    ("zh", "他说：“好。”我走……了。真的？！是3.5元。", ["他说：“好。”", "我走……了。", "真的？！", "是3.5元。"]),
    ("ja", "「行く。」と言った。『花は！』と聞いた。雨だ（本）ね。", ["「行く。」と言った。", "『花は！』と聞いた。", "雨だ（本）ね。"]),
    ("th", "เขามาๆ แล้ว ไป 28.14 บาท Foo กิน นอน", ["เขามาๆ แล้ว", "ไป 28.14 บาท Foo กิน", "นอน"]),
    ("am", "ለምሳ. ይህ ነው። «ነው?» አለ ሰው። ሌላ።", ["ለምሳ. ይህ ነው።", "«ነው?» አለ ሰው።", "ሌላ።"]),
    (None, "Home | About | Help\r\n  © 2019 a-b.example \n\n　\nx", ["Home | About | Help", "© 2019 a-b.example", "x"]),
]


@pytest.mark.parametrize("tag,text,expected", CASES)
def test_units(tag, text, expected):
    assert parts(text, tag) == expected
    assert parts(text, "xx") == expected


def test_table(spark):
    rows = [(1, "A b. C d.", "en", "k"), (1, "A b. C d.", None, None), (2, None, "en", ""), (3, "", "en", ""), (4, " \n ", "zz", ""), (None, "😀 x", "", ""), (5, "w. " * 50000, "en", "")]
    df = spark.createDataFrame(rows, "doc long, body string, lang string, key string")
    found = [(r["doc"], r["start_char"], r["end_char"]) for r in sentence_units(df, "doc", "body", "lang").collect()]
    assert sorted((x for x in found if x[0] == 1)) == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9)]
    assert [x for x in found if x[0] in (2, 3, 4)] == []
    assert [x for x in found if x[0] is None] == [(None, 0, 3)]
    assert [x for x in found if x[0] == 5] == [(5, 0, 149999)]
    assert sentence_units(df.limit(0), "doc", "body").count() == 0


@pytest.mark.parametrize(
    "text, tag, expected",
    [
        ("He studied modern art. She paints.", "en", 2), ("He wore a cap. He left.", "en", 2), ("He is a nice chap. He left.", "en", 2),
        ("She ate a fig. It was ripe.", "en", 2), ("That is apt. We agree.", "en", 2), ("Das ist eine neue Art. Sie ist schön.", "de", 2),
        ("C'est de l'art. Elle peint.", "fr", 2), ("Born on Jan. 5 in Ohio.", "en", 1), ("John Smith Jr. Williams came home.", "en", 1),
        ("He met John Smith Jr. He left.", "en", 2), ("Am 3. Oktober war es. Dann nicht.", "de", 2), ("Vive en EE. UU. desde 1990.", "es", 1),
        ("See Fig. 3 and Art. 5 there.", "en", 1), ("Siehe Art. 5 des Gesetzes.", "de", 1), ("ខ្ញុំទៅផ្ទះ។ គាត់ទៅសាលា។", "km", 2), ("သူသွားသည်။ ကျွန်တော်လာသည်။", "my", 2),
    ],
)
def test_words_that_are_abbreviations_too(text, tag, expected):
    for given in (tag, None):
        assert len(units(text, given)) == expected
