import random

import pytest

from querent.llm import sentences as Z

from .helpers import frame, tuples

S = "doc_id long, text string, doc string, n int, cuts string"

CASES = {
    "en": ["Dr. A. Lee met Mr. Ray at 5 p.m. on Monday.", "The fee is 3.5 credits, i.e. less.", "Use form No. 15 (see Sec. 4.2) now.", "Did it close (at 1 p.m.) in time?!", '"Keep it dry."', "That is the rule.", "The sign says \"Closed. Sorry.\" and hangs.", "“Where?” asked the clerk.", "It opens at 11 a.m.", "The office opens later.", "Bring tape, etc.", "Everything else is here.", "Wait... the rest moved."],
    "de": ["Am 31. März zieht das Labor um.", "Dort liegen z. B. Muster usw. im Regal.", "Laut Abs. 17 Nr. 4 gilt das.", "„Die Muster sind da.“", "Das Büro bleibt zu.", "Es steht „Bitte warten. Nicht klopfen.“ in Rot."],
    "fr": ["« Les badges sont prêts. »", "Le bureau ouvre.", "M. Paul signe à 7 h. 30 env. chaque jour.", "Qui ouvre ?", "L'affiche dit « Merci. Adieu. » en rouge."],
    "es": ["¿Ya cerró?", "Sí.", "Son las 12 p. m. en Vigo.", "Véase la pág. 12, art. 9, antes.", "¡No dejen nada!"],
    "ru": ["С 2031 г. архив находится на ул. Lirabave.", "Там лежат ярлыки и т. д. до вечера.", "«Все готовы».", "Потом откроется."],
    "el": ["Άνοιξε η αίθουσα;", "Όχι.", "Βλ. σελ. 15 του οδηγού."],
    "ar": ["من يفتح المستودع؟", "توجد الأشرطة، إلخ. في المكتب.", "تقول «أغلق الباب. شكرا.» بخط أحمر."],
    "hi": ["क्या गोदाम बंद है?", "हाँ।", "पृ. 24 देखें।"],
}


def split(text):
    events = Z._events(text, 0, len(text), True)
    _, cuts = Z._run(text, events, Z.BLOCK, 0, len(text))
    at, out = len(text) - len(text.lstrip()), []
    for e, s in [*cuts, (len(text.rstrip()), None)]:
        if at < e:
            out.append(text[at:e])
        at = s
    return out


@pytest.mark.parametrize("lang", sorted(CASES))
def test_languages(lang):
    assert split(" ".join(CASES[lang])) == CASES[lang]
    assert split("\n".join(CASES[lang])) == CASES[lang]


def test_scripts_without_spaces():
    assert split("他说：“样品在哪里？”便离开了。“收据到了。”然后开门。请看第9页……再问。关了吗？！关了。") == ["他说：“样品在哪里？”便离开了。", "“收据到了。”", "然后开门。", "请看第9页……再问。", "关了吗？！", "关了。"]
    assert split("「許可証が届きました。」その後で開きます。係員は「どこ？」と尋ねました。") == ["「許可証が届きました。」", "その後で開きます。", "係員は「どこ？」と尋ねました。"]
    assert split("ห้ามวาง หนัก 8.9 กิโล ป้ายว่า“ปิด ขอบคุณ”แดง") == ["ห้ามวาง", "หนัก 8.9 กิโล", "ป้ายว่า“ปิด ขอบคุณ”แดง"]


def test_layout():
    assert split("# Head\n\nOne two\nthree. Four.\n\n- a. b\n- c, d\n\n1. x\n2. y\n\nHeading\r\n\r\nEnd") == ["# Head", "One two\nthree.", "Four.", "- a. b", "- c, d", "1. x", "2. y", "Heading", "End"]
    assert split("Store it here.Nobody lends. See list.txt v1.2.3 now.") == ["Store it here.", "Nobody lends.", "See list.txt v1.2.3 now."]
    assert split("Am\n31. März zieht um.") == ["Am\n31. März zieht um."]


def test_chunks_compose_to_the_whole(spark):
    rng = random.Random(9)
    every = [s for c in CASES.values() for s in c] + ["「許可証が届きました。」", "他说：“样品在哪里？”便离开了。", "ห้ามวาง ห้าม"]
    docs = []
    for i in range(25):
        text = ""
        for _ in range(rng.randrange(1, 60)):
            text += rng.choice(every) + rng.choice([" ", "  ", "\n", "\n\n", "\n\n- item one\n- item two\n\n", " "])
        docs.append((i, text, "c", 1, "c"))
    whole = tuples(Z.sentences(frame(spark, docs, S)))
    want = []
    for i, t, *_ in docs:
        at = 0
        for s in split(t):
            at = t.index(s, at)
            want.append((i, at, at + len(s)))
            at += len(s)
    assert whole == sorted(want)
    for size in (700, 97):
        assert tuples(Z.sentences(frame(spark, docs, S), chunk_chars=size)) == whole


def test_nulls_blanks_repeats_and_long(spark):
    rows = [(1, None, None, None, None), (2, "", None, None, None), (3, " \n　 ", None, None, None), (None, "No id.", None, None, None), (4, "Twice. Yes.", None, None, None), (4, "Twice. Yes.", None, None, None), (5, "word " * 60_000, None, None, None), (6, "\n\n  One.  ", None, None, None)]
    got = Z.sentences(frame(spark, rows, S)).collect()
    assert sorted(((r[0] is None, r[0] or 0, *r[1:]) for r in got)) == sorted([(True, 0, 0, 6), *[(False, 4, 0, 6), (False, 4, 7, 11)] * 2, (False, 5, 0, 299_999), (False, 6, 4, 8)])
    assert Z.sentences(frame(spark, [], S)).count() == 0


def test_rows_do_not_depend_on_chunks_with_unclosed_marks(spark):
    rng = random.Random(4)
    parts = ["He said “never closed. ", "«нет. ", "(open. And ", "closed) here. ", "end.” ", "「開く。", "。」", '"Half. ', 'said" once. ', "Plain one. ", "\n\n", "\n- item. x\n", "!!!", "1. ", " " * 40, "ห้าม วาง ", "word "]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(5, 400))), "c", 1, "c") for i in range(12)]
    docs += [(50, "“Open. " + "Still in it. " * 400 + "\n\nNew block. " + "More. " * 300, "c", 1, "c"), (51, "A b." + " " * 5000 + "C d.\n" + " " * 3000 + "\n" + "." * 3000 + " E" + "!" * 700 + ")" * 90 + " F.", "c", 1, "c")]
    whole = tuples(Z.sentences(frame(spark, docs, S)))
    assert len(whole) > 500
    for size in (64, 900, 4097):
        assert tuples(Z.sentences(frame(spark, docs, S), chunk_chars=size)) == whole


def test_the_table_has_a_rule_for_every_state_and_class():
    assert len(Z.TABLE) == Z.STATES and {len(r) for r in Z.TABLE} == {Z.CLASSES}
    assert all(0 <= x < 3 * Z.STATES for r in Z.TABLE for x in r)


def test_more_chunks_than_one_level_of_the_scan(spark):
    text = ("“Open. " + "In it. " * 30 + "Closed.” After. " + "\n\n" * 2 + "Next one. ") * 90
    whole = tuples(Z.sentences(frame(spark, [(1, text, "c", 1, "c")], S)))
    assert len(text) // 32 > 2 * Z.FAN and tuples(Z.sentences(frame(spark, [(1, text, "c", 1, "c")], S), chunk_chars=32)) == whole
