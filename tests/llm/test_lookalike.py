import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from tavuflow.llm import lookalike as L

PAIRS = [
    ("Ｔａｌｏ", "Talo"),
    ("a b", "a b"),
    ("a　b c", "a b c"),
    ("ä", "ä"),
    ("iс̧", "iç"),
    ("со​с﻿", "coc"),
    ("ﬁnn", "finn"),
    ("Å", "Å"),
    ("Әә", "Əə"),
    ("ﾊﾟ", "パ"),
    ("ạ̈", "ạ̈"),
    ("ⅣⅫⅰ", "IVXIIi"),
    ("ᎪᏴꓐꓮⲔⲟ", "ABBAKo"),
]
KEPT = ["m²", "ı", "İ", "é", "e", "Ab", "“x”", "½", "a\nb\tc", "한글", "ſ"]


def test_pairs():
    for odd, plain in PAIRS:
        assert L.normalize_text(odd) == L.normalize_text(plain) == unicodedata.normalize("NFC", plain), odd
    for text in KEPT:
        assert L.normalize_text(text) == text
    assert L.normalize_text("m2") != L.normalize_text("m²") and L.normalize_text("A") != L.normalize_text("a")


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abcіос̧eouΑΌ̧̣̈̇ éﾊﾟÅﬁ²ạ​\n "), max_size=14))
def test_is_mapping_then_composition(text):
    expected = unicodedata.normalize("NFC", "".join(L._expansion(ord(c)) for c in text))
    assert L.normalize_text(text) == expected
    assert L.normalize_text(expected) == expected


def test_frames(spark):
    texts = ["Ta​lo", None, "", "​", "talo " * 50_000 + "Ａ", "Ta​lo"]
    df = spark.createDataFrame([(i, t, "kept", 5) for i, t in enumerate(texts)], "id long, t string, form string, consistent int")
    got = {r["id"]: (r["consistent"], r["form"]) for r in L.consistent_form(df, "t").collect()}
    assert got[0] == ("Talo", "kept") and got[1][0] is None and got[2][0] == "" and got[3][0] == "" and got[4][0] == "talo " * 50_000 + "A" and got[5] == got[0]
    assert L.consistent_form(df.limit(0), "t").count() == 0


def test_pairs_of_rows(spark):
    df = spark.createDataFrame([(1, "talo"), (2, "tal\u043e"), (3, "talo"), (4, None), (5, "kyl\u00e4"), (6, "kyla\u0308"), (7, "muu"), (7, "muu")], "id long, t string")
    assert sorted(tuple(r) for r in L.same_look_pairs(df, "id", "t").collect()) == [(1, 2), (2, 3), (5, 6)]
    clean = spark.createDataFrame([(10, "talo"), (11, "kylä"), (12, None)], "id long, t string")
    assert sorted(tuple(r) for r in L.same_look_words(df, "id", "t", clean, "id", "t").collect()) == [(2, 10), (6, 11)]


def test_classes_of_rows(spark):
    df = spark.createDataFrame([(1, "talo"), (2, "tal\u043e"), (3, "talo"), (4, None), (5, ""), (6, "\u200b"), (7, "muu"), (7, "muu")], "id long, t string")
    got = sorted(tuple(r) for r in L.same_look_classes(df, "id", "t").collect())
    assert got == [(1, 1, 2), (2, 1, 2), (3, 1, 2), (5, 5, 2), (6, 5, 2), (7, 7, 1), (7, 7, 1)]
    assert L.same_look_classes(df.limit(0), "id", "t").count() == 0


def test_a_crowd_of_copies(spark):
    rows = [(i, "talo kylä") for i in range(500)] + [(1000, "talo kylä"), (1001, "talo​ kylä")]
    got = L.same_look_pairs(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    assert got.count() == 500 * 2 + 1
