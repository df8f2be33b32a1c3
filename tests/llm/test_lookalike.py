import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from skarn.llm.lookalike import _tables, look, lookalike_classes, lookalike_pairs, normalized
from tests.brute import rows


def test_same_look():
    groups = [
        ["file", "ﬁle", "ｆｉｌｅ", "fi​le", "fi­le", "fіle", "fⅰle", "﻿file"],
        ["é", "é", "е́"],
        ["a b", "a b", "a b", "a　b"],
        ["non-stop", "non‑stop", "non‐stop", "non－stop"],
        ["KOPA", "KOPA", "КОРА", "ΚΟΡΑ"],
        ["ガ", "ｶﾞ", "ガ"],
    ]
    for g in groups:
        assert len({look(x) for x in g}) == 1, [ascii(look(x)) for x in g]
    assert len({look(g[0]) for g in groups}) == len(groups)


def test_visible_differences_stay():
    for a, b in [("a", "A"), ("e", "é"), ("2", "²"), ("1", "①"), ("a b", "a  b"), ("a\nb", "a b"), ("a-b", "a–b"), ("👨‍💻", "👨💻"), ("s", "ſ"), ("a\tb", "a b")]:
        assert look(a) != look(b), (a, b)
    assert look(None) is None and look("") == ""


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=30) | st.text(alphabet="aé̀​‍ﬁеіＡ  👨ガ", max_size=12))
def test_segments_give_what_whole_normalisation_gives(text):
    once = look(text)
    assert look(once) == once
    if "‍" not in text and "‌" not in text:  # where joiners stay, the context decides
        whole = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_tables()[0]))
        assert unicodedata.normalize("NFC", unicodedata.normalize("NFD", whole).translate(_tables()[0])) == once


def test_pairs(spark):
    data = [(1, "abc é", "x"), (2, "abc é", "x"), (3, "abc é", "x"), (4, "abc e", "x"), (5, None, "x"), (6, "", "x"), (7, "---", "x"), (8, "‑--", "x"), (2, "abc é", "x"), (9, "ａbc é", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, id string")  # an extra column named as an inner one
    want = [(a, b) for a in (1, 2, 3, 9) for b in (1, 2, 3, 9) if a < b and {a, b} != {1, 3}]
    assert rows(lookalike_pairs(docs, "doc_id", "text")) == sorted(want)
    # many copies are represented by the least id, and all are in the classes
    assert rows(lookalike_pairs(docs, "doc_id", "text", most_copies=1)) == [(1, 2), (1, 9), (2, 9)]
    assert rows(lookalike_classes(docs, "doc_id", "text").select("id").distinct()) == [(1,), (2,), (3,), (9,)]
    assert lookalike_pairs(docs.limit(0), "doc_id", "text").count() == 0
    out = {r["doc_id"]: r["text"] for r in normalized(docs, "doc_id", "text").collect()}
    assert out[2] == "abc é" and out[5] is None and out[9] == "abc é"


def test_very_long_text():
    text = ("Ünïcode ｔｅｘｔ with é " * 50_000)
    assert look(text) == unicodedata.normalize("NFC", text.replace("ｔｅｘｔ", "text"))


def test_letters_of_other_scripts_and_blocks():
    assert look("ꓮꓐꓢ ⲟⲣⲥ ᗷᒪ Ѵ Ԍ 𝖠𝚋𝟣") == "ABS opc BL V G Ab1"
    assert look("𝐀𝑏 ℕ") == "𝐀𝑏 ℕ"  # bold, italic and double-struck letters are seen
    assert look("a⁦b⁩ c‪d‬") == "ab cd"
    assert look("a‮b‬") == "a‮b‬" and look("⁧אב⁩ a") == "⁧אב⁩ a"
    assert look("a⠀b᠋") == "a b"
