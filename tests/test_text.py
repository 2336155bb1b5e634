import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tavuflow.functions import text as T
from tavuflow.operators import tokenize as K

ODD = ["a b", "a b", "ä", "ä", "a\U0001f600b", "", " ", "x", " a b ", "\x1ca\x1fb", "　x y", None]


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in df.select("i", expression(F.col("t")).alias("x")).orderBy("i").collect()]


def test_words_are_python_split(spark):
    assert column(spark, ODD, T.words) == [None if t is None else t.split() for t in ODD]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_ngrams(spark, n):
    expected = [None if t is None else [t[i : i + n] for i in range(len(t) - n + 1)] for t in ODD]
    assert column(spark, ODD, lambda c: T.ngrams(c, n)) == expected


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x00"), max_size=12), min_size=1, max_size=30))
def test_trigrams_of_any_text(spark, values):
    assert column(spark, values, lambda c: T.ngrams(c, 3)) == [[t[i : i + 3] for i in range(len(t) - 2)] for t in values]


def test_names(spark):
    assert column(spark, ['a<b>:"c/d\\e|f?g*h', "x y  z", None], T.title_slug) == ["a_b___c_d_e_f_g_h", "x_y_z", None]
    assert column(spark, ["a/b\\c d"], T.safe_tag) == ["a_b_c_d"]
    assert column(spark, ["BPE25k", "Word", None], T.vocabulary_size) == [25000, None, None]
    assert column(spark, ["  a ", "\n"], T.strip) == ["a", ""]


def test_unknown_strategy():
    with pytest.raises(ValueError):
        K.tokenizer("7grams")
    with pytest.raises(ValueError):
        K.tokenizer("BPE5k")


def test_propagation_and_support_agree(spark):
    rows = spark.createDataFrame([("talossa", "B-LOC"), ("on", "O"), ("x", "O"), ("", "O")], "word string, tag string")
    made = {s: K.propagate(rows, "word", s).groupBy("tag").count().collect() for s in ("Bigrams", "5grams", "Char")}
    by = {(r["strategy"], r["tag"]): r["support"] for r in K.support(rows, "word", ["tag"]).collect()}
    for s, counted in made.items():
        got = {r["tag"]: r["count"] for r in counted}
        assert all(by[s, tag] == got.get(tag, 0) for tag in ("B-LOC", "O"))
    vanished = {r["n"]: r["vanished"] for r in K.vanished(rows, "word", []).collect()}
    assert vanished == {2: 2, 3: 3, 4: 3, 5: 3}
