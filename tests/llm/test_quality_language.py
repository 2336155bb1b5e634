import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tavuflow.llm import langnames, language, quality, queries

SF = "/root/testdata/sf0.01"
VERBS = ["on", "oli", "ja", "mutta", "koska", "joka", "vuonna", "myös"]


def prose(rnd, n=6):
    return " ".join(" ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(300)}sana {rnd.choice(VERBS)}".replace("0", "o") for _ in range(5)).capitalize() + "." for _ in range(n))


def test_types(spark, rnd):
    rows = [(i, prose(rnd)) for i in range(60)]
    junk = ["|-\n" + "\n".join(f"| nimi{i} || {i} || {i * 7}" for i in range(30)), "\n".join(f"* Kohta{i}: paikka{i}" for i in range(30)), "~ #:~-=}/:. %%^-] {\\].| {**#></} ^@:# " * 20, "meli miti, meli! miti meli " * 30]
    rows += [(1000 + i, t) for i, t in enumerate(junk * 6)]
    rows += [(2000, None), (2001, ""), (2002, " \n "), (2003, prose(rnd, 2000)), (0, rows[0][1])]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "id long, t string, label string, prose int")
    got = {r["id"]: (r["type"], r["prose"], r["n_lines"]) for r in quality.text_types(df.select("id", "t", "label"), "id", "t", F.col("label")).collect()}
    assert all(got[i][0] == "prose" for i in range(60)) and got[2003][0] == "prose"
    assert all(got[1000 + i][0] not in ("prose", None) for i in range(len(junk) * 6))
    assert got[2000][0] is None and got[2001][0] is None and got[2002][0] is None
    empty = df.select("id", "t", "label").limit(0)
    assert quality.text_types(empty, "id", "t", F.col("label")).count() == 0


def test_labels_of_few_texts(spark, rnd):
    rows = [(i, prose(rnd), "x") for i in range(60)]
    other = lambda t: " ".join(f"q{w}" for w in t.lower().split()).capitalize()
    rows += [(100 + i, other(prose(rnd)), "y") for i in range(6)] + [(200, other(prose(rnd)).replace("q", "z"), "z")]
    rows += [(300 + i, "meli miti, meli! miti meli " * 30, "x") for i in range(6)]
    df = spark.createDataFrame(rows, "id long, t string, label string")
    common, labels = quality.common_words(df, "t", F.col("label"))
    assert len(common) and labels == ["x", "y"]
    got = {r["id"]: r for r in quality.text_types(df, "id", "t", F.col("label")).collect()}
    assert all(got[i]["common_share"] > 0.2 for i in range(100, 106))
    assert all((got[i]["type"] == "prose") == (i < 300) for i in got)


def test_counts_do_not_depend_on_the_spread(spark, rnd):
    rows = [(i, prose(rnd) + (" harva tässä." if i % 6 == 0 else ""), "x") for i in range(240)]
    df = spark.createDataFrame(rows, "id long, t string, label string")
    one = quality.common_words(df.coalesce(1), "t", F.col("label"))
    # All texts with the word in one task, and none of it in the others; and one task for a few texts.
    for spread in (df.repartitionByRange(2, F.col("id") % 6), df.repartition(40)):
        other = quality.common_words(spread, "t", F.col("label"))
        assert (other[0] == one[0]).all() and other[1] == one[1]


def test_learning_keeps_the_types_apart():
    histogram = {0b111: 500, 0b11: 300, 1 << 3: 50, 1 << 3 | 1 << 4: 80, 1 << 6 | 1 << 7: 90, 1 << 10 | 1 << 11: 40}
    share, chance, post = quality.learn(histogram)
    best = dict(zip(sorted(histogram), post.argmax(1), strict=True))
    assert best[0b111] == best[0b11] == 0 and best[1 << 3 | 1 << 4] == 2 and best[1 << 6 | 1 << 7] == 1 and best[1 << 10 | 1 << 11] == 3
    assert abs(share.sum() - 1) < 1e-9 and ((chance > 0) & (chance < 1)).all()


def test_labels(spark):
    df = spark.createDataFrame([(" FI ",), ("Finnish",), ("Turkish ",), ("und",), ("",), (None,)], "l string")
    assert [r[0] for r in df.select(langnames.language_code(F.col("l"))).collect()] == ["fi", "fi", "tr", None, None, None]


@pytest.fixture(scope="module")
def labelled():
    table = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return [(r["text"], r["lang"]) for r in table if r["text"] and r["lang"] in ("fi", "tr", "hu", "sw", "en") and len(r["text"]) > 200]


def test_held_out_accuracy(labelled):
    train, test = labelled[::2], labelled[1::2]
    model = language.fit([t for t, _ in train], [x for _, x in train])
    segments = language.Segments(pa.array([t for t, _ in test]))
    found = language.tell(model, segments, len(test))["main"]
    right = sum(model.languages[k] == x for k, (_, x) in zip(found, test, strict=True))
    assert right / len(test) > 0.97


def test_mixed_and_odd(spark, labelled):
    model = language.fit([t for t, _ in labelled], [x for _, x in labelled])
    fi = next(t for t, x in labelled if x == "fi").split("\n")[0]
    en = "The old bridge was built in 1820. The museum describes the quiet river and its engines."
    df = spark.createDataFrame([(1, f"{fi}\n\n{en}"), (2, None), (3, ""), (4, "12 34 !!"), (5, f"{fi}\n{en.split('. ')[0]}.")], "id long, t string")
    got = {r["id"]: (r["language"], [(s["line_no"], s["language"]) for s in r["segments"]]) for r in language.identify(df, "id", "t", model).collect()}
    assert got[1] == ("fi", [(2, "en")]) and got[2] == got[3] == got[4] == (None, []) and got[5] == ("fi", [])


def test_every_article_has_its_language(spark, labelled, tmp_path):
    fi = next(t for t, x in labelled if x == "fi").split("\n")[0]
    en = "The old bridge was built in 1820 beside the quiet river and its engines."
    odd = [(f"{fi}\n{en}", "fi"), ("Talo on uusi ja kylä on vanha.", "fi"), (None, "fi"), ("", None), ("| 1 || 2 || 3\n" * 30, "fi"), ("12 34 !!", None)]
    rows = [(i, x, "t", t) for i, (t, x) in enumerate([*odd, *labelled])]
    spark.createDataFrame(rows, "article_id long, lang string, Title string, Cleaned_Text string").coalesce(1).write.parquet(f"{tmp_path}/articles.parquet")
    got = {r["article_id"]: r for r in queries.p2_languages(spark, str(tmp_path)).collect()}
    assert got.keys() == {r[0] for r in rows}
    assert got[0]["language"] == "fi" and [(s["line_no"], s["language"]) for s in got[0]["segments"]] == [(1, "en")]
    assert got[1]["language"] == "fi" and [got[i]["language"] for i in (2, 3, 4, 5)] == [None] * 4


def test_nothing_to_fit_on(spark):
    model = language.fit([], [])
    df = spark.createDataFrame([(1, "Talo on uusi ja kylä vanha."), (2, None)], "id long, t string")
    assert [(r["language"], r["segments"]) for r in language.identify(df, "id", "t", model).collect()] == [(None, []), (None, [])]
    assert language.identify(df.limit(0), "id", "t", model).count() == 0


def test_short_forms_do_not_part():
    texts = ["Ks. myös prof. Mäki ja N. K. Salo, s. 12. Toinen lause on tässä.", "A művet N. K. Kavufa írta. II. Pál király a 12. Kisház körzetbe ment."]
    segments = language.Segments(pa.array(texts))
    cut = ["".join(map(chr, segments.codes[a:b])).strip() for a, b in zip(segments.start, segments.end, strict=True)]
    assert cut == ["ks. myös prof. mäki ja n. k. salo, s. 12. toinen lause on tässä.", "a művet n. k. kavufa írta.", "ii. pál király a 12. kisház körzetbe ment."]


def test_sample_is_bounded(spark):
    df = spark.createDataFrame([(i, f"t{i}", "fi" if i % 3 else "tr") for i in range(90)] + [(1000, None, "fi"), (1001, "x", None)], "id long, t string, l string")
    texts, labels = language.sample_texts(df, "id", "t", "l", 10)
    assert len(texts) == 20 and labels.count("fi") == 10
    assert (texts, labels) == language.sample_texts(df.repartition(5), "id", "t", "l", 10)


def test_catalog_names():
    names = list(queries.queries())
    assert [n for n in names if n.endswith("_found") or n == "p8_ids"] == ["p1_found", "p2_found", "p3_found", "p5_found", "p6_found", "p8_ids", "p10_found"]
