"""Problem 8: garbled texts planted among clean ones."""

import random

import pytest

from siltstone.llm import mojibake
from siltstone.llm.garble import LOST, Chain, chains, garble, garbled_forms, restore
from siltstone.llm.mojibake import Mojibake, pieces_of, restored_line, words_of

CLEAN = {
    "de": "Die Brücke gehört jetzt zur Bäckerei, das müsste für Größe früher geprüft werden",
    "fr": "Le garçon a oublié la clé près du marché, l’été dernier à côté du café",
    "ru": "Пекарня осталась в подвале до пятницы, старый кран стоит возле мельницы",
    "pl": "Piekarnia została zamknięta było później źle, proszę spóźnić się również",
    "ja": "パン屋は霧のため閉まったままです。倉庫の鍵は金曜日まで届きました。",
    "zh": "仓库钥匙星期五之前还没有回复。面包店因为大雾一直关着。",
}
UNUSUAL = ["ÞETTA ER RÉTT: ýsa, þýða, ðð, Ñandú, Ærø", "≈ ∑ │ ± · … À €", "x́ ÿ zero​width"]


def corpus():
    rnd = random.Random(4)
    docs = {}
    for i in range(240):
        words = CLEAN[rnd.choice(list(CLEAN))].split()
        docs[i] = f"Subject: {i}\r\n\r\n{' '.join(words)} {rnd.choice(UNUSUAL)} {i}"
    return docs


def planted():
    c = lambda *s, lost=False: Chain(tuple(s), lost)
    return {
        1000: (CLEAN["de"], c(("utf-8", "cp1252"))),
        1001: (CLEAN["fr"], c(("utf-8", "latin-1"), ("utf-8", "cp1252"))),
        1002: (CLEAN["ru"], c(("cp1251", "koi8-r"))),
        1003: (CLEAN["ru"], c(("utf-8", "cp1251"))),
        1004: (CLEAN["pl"], c(("cp1250", "cp1252"))),
        1005: (CLEAN["ja"], c(("utf-8", "cp1252"))),
        1006: (CLEAN["zh"], c(("gbk", "latin-1"))),
        1007: (CLEAN["de"], c(("latin-1", "utf-8"), lost=True)),
        1008: (CLEAN["fr"], c(("utf-8", "mac-roman"))),
        1009: (CLEAN["de"], c(("utf-8", "cp850"))),
    }


@pytest.fixture(scope="module")
def found(spark):
    docs = corpus() | {i: f"Hello\n\n> {garble(t, c)}\n" for i, (t, c) in planted().items()}
    docs |= {2000: None, 2001: "", 2002: "plain ascii =C3=BC", 2003: docs[1000], 2004: " "}
    rows = [(i, t, "x", "y") for i, t in docs.items()]
    return Mojibake(spark.createDataFrame(rows, "doc_id bigint, text string, word string, h string"))


def test_planted_cases_and_nothing_else(found):
    assert sorted(r["doc_id"] for r in found.found().collect()) == sorted([*planted(), 2003])


def test_restored_as_written(found):
    got = {r["doc_id"]: r for r in found.restored().collect()}
    for i, (text, chain) in planted().items():
        if chain.lost:
            assert LOST in got[i]["restored"] and got[i]["n_restored"] < got[i]["n_garbled"]
        else:
            assert got[i]["restored"] == f"Hello\n\n> {text}\n"


def test_no_evidence_no_cases(spark):
    for rows in ([], [(1, None)], [(1, "für"), (2, "fÃ¼r")]):
        assert Mojibake(spark.createDataFrame(rows, "doc_id bigint, text string")).found().count() == 0


def test_forms_match_one_by_one():
    words = ["für", "кран", "金曜日", "ł"]
    for chain, own, forms in garbled_forms(words, chains()):
        for i, f in zip(own, forms, strict=True):
            assert f == garble(words[i], chain) != words[i]


def test_round_trips():
    for chain in chains():
        for w in ("Größe", "côté", "кран", "仓库钥匙"):
            g = garble(w, chain)
            back = restore(g, chain)
            assert back is None or garble(back, chain) == g
            if "?" not in g and LOST not in g and g != w and not chain.dropped and back is not None:
                assert back == w


def test_words_and_pieces():
    assert words_of("a b-c für=Größe; für ðð".encode()) and set(words_of("für=Größe, x für".encode())) == {"für", "Größe"}
    assert ("ü", "run") in pieces_of("für") and ("金曜", "gram") in pieces_of("金曜日まで")


def test_whole_texts_are_read(spark):
    base = [(i, "schön und grün") for i in range(9)]
    text = "x " * 400_000 + "schÃ¶n"
    df = spark.createDataFrame([*base[:1], *[(i, f"schön {i}") for i in range(1, 9)], (99, text)], "doc_id bigint, text string")
    assert [r["doc_id"] for r in Mojibake(df).found().collect()] == [99]


def test_long_unspaced_texts(spark):
    """A word without a break of 300,000 characters, clean in one document and misread in another."""
    zh = CLEAN["zh"].replace("。", "")
    rows = [(i, f"{CLEAN['zh']} {i}") for i in range(12)] + [(50, zh * 12_000), (51, garble(zh * 300, Chain((("gbk", "latin-1"),), False)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [r["doc_id"] for r in Mojibake(df).found().collect()] == [51]


def test_a_source_that_misreads_all_its_mail(spark):
    """Forms as frequent as their originals: 40 of 70 texts read UTF-8 as cp1252 or cp1251."""
    clean = [(i, f"{CLEAN['de']} {CLEAN['ru']} {i}") for i in range(30)]
    bad = [(100 + i, garble(f"{CLEAN['de'] if i % 2 else CLEAN['ru']} {i}", Chain((("utf-8", e),), False)))
           for i, e in enumerate(["cp1252", "cp1251"] * 20)]
    m = Mojibake(spark.createDataFrame(clean + bad, "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in m.found().collect()) == [i for i, _ in bad]
    got = {r["doc_id"]: r["restored"] for r in m.restored().collect()}
    assert got[101] == f"{CLEAN['de']} 1" and got[100] == f"{CLEAN['ru']} 0"


def test_frequent_words_that_are_valid_utf8_stay(spark):
    assert garble("業", Chain((("utf-8", "cp866"),), False)) == "цен"
    rows = [(i, f"рост цен {i}") for i in range(20)] + [(50 + i, f"業 {i} 業務") for i in range(20)]
    assert Mojibake(spark.createDataFrame(rows, "doc_id bigint, text string")).found().count() == 0


def test_only_whole_garbled_words_are_replaced():
    known = {"МН": ("но", 0), "fÃ¼r": ("für", 1)}
    line = "МН прикмМНта обычная и ещё слова, (fÃ¼r) xfÃ¼r fÃ¼rMН МН"
    assert restored_line(line, known, chains()) == "но прикмМНта обычная и ещё слова, (für) xfÃ¼r fÃ¼rMН но"
    # What was put in is not looked at again.
    assert restored_line("ab é á é xy zé ké qé", {"é": ("á", 0), "á": ("ó", 0)}, chains()) == "ab á ó á xy zé ké qé"


def test_small_filters_in_several_passes_find_the_same(found, monkeypatch):
    want = {tuple(r) for r in found.words().select("word", "original").collect()}
    monkeypatch.setattr(mojibake, "FILTER_BITS_MOST", 1 << 11)
    again = Mojibake(found.spark.createDataFrame([], "doc_id bigint, text string"))
    again.texts = found.texts
    assert {tuple(r) for r in again.words().select("word", "original").collect()} == want and want


CLASSES = {
    "UTF-8 read once in one byte": [Chain((("utf-8", e),), False) for e in ("latin-1", "cp1252", "cp1251", "mac-roman", "cp850", "iso8859-2")],
    "UTF-8 read twice or more": [Chain((("utf-8", a), ("utf-8", b)), False) for a, b in (("latin-1", "latin-1"), ("cp1252", "cp1252"))]
    + [Chain((("utf-8", "latin-1"),) * 3, False)],
    "one byte read in another": [Chain(((a, b),), False) for a, b in (("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1250", "cp1252"), ("cp1252", "cp437"))],
    "several bytes read in one": [Chain(((a, "latin-1"),), False) for a in ("gbk", "cp932", "big5")],
    "controls dropped": [Chain((("utf-8", "latin-1"),), False, dropped=True)],
}


@pytest.fixture(scope="module")
def measured(spark):
    """Per class the words misread, of them restored, words changed, of them rightly."""
    rnd, docs, truth = random.Random(8), corpus(), {}
    for name, kinds in CLASSES.items():
        for c in kinds:
            for lang, text in CLEAN.items():
                garbled = garble(text, c)
                if "?" in garbled or LOST in garbled or garbled == text:
                    continue
                clean = CLEAN[rnd.choice(list(CLEAN))]
                no = 10_000 + len(truth)
                docs[no] = f"{clean}\n{garbled}\n{clean} {no}"
                truth[no] = (name, docs[no], f"{clean}\n{text}\n{clean} {no}")
    rows = Mojibake(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")).restored().collect()
    got = {r["doc_id"]: r["restored"] for r in rows}
    out = {name: [0, 0, 0, 0] for name in CLASSES}
    for no, (name, bad, right) in truth.items():
        for b, r, g in zip(bad.split(), right.split(), got.get(no, bad).split(), strict=False):
            out[name][0] += b != r
            out[name][1] += b != r and g == r
            out[name][2] += g != b
            out[name][3] += g != b and g == r
    return out


@pytest.mark.parametrize("name", list(CLASSES))
def test_restored_share_and_precision(measured, name):
    misread, restored, changed, rightly = measured[name]
    print(f"{name}: {misread} misread, {restored} restored, {changed} changed, {rightly} rightly")
    assert misread and rightly >= 0.99 * changed
    # What dropped or ASCII bytes took away can't be turned back word by word.
    least = {"controls dropped": 0.5, "several bytes read in one": 0.7}
    assert restored >= least.get(name, 0.95) * misread
