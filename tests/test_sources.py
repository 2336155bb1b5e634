import bz2
import glob
import os

import pytest
from pyspark.sql import functions as F

from tavuflow.sources import conll, corpus, results, wiki
from tavuflow.streaming import counts

DUMP = """<mediawiki>
<page><title>Talo</title><revision><id>1</id><text xml:space="preserve">vanha</text></revision><revision><id>2</id><text>'''Talo''' on [[rakennus|rakennuksia]] {{malli|{{sisä}}}}&lt;ref&gt;x&lt;/ref&gt;.
== Lähteet ==
[[Luokka:Talot]]</text></revision></page>
<page><revision><id>3</id><text/></revision></page>
<page><title>Rikki</title><revision><id>x</id></page>
</mediawiki>
"""


def test_wiki(spark, tmp_path):
    (tmp_path / "dump.xml.bz2").write_bytes(bz2.compress(DUMP.encode()))
    rows = wiki.extract_articles(spark, f"{tmp_path}/dump.xml.bz2").collect()
    assert rows[0]["Title"] == "Talo" and rows[0]["Cleaned_Text"] == "Talo on rakennuksia .\nLähteet"
    assert rows[1]["Title"] is None and rows[1]["Cleaned_Text"] == ""
    counted = wiki.page_counts(wiki.read_pages(spark, f"{tmp_path}/dump.xml.bz2")).first()
    assert counted["pages"] == counted["skipped"] + len(rows)


def test_articles_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"Title": "T", "Cleaned_Text": "yksi kaksi\\nyksi"}\n{broken\n{"Title": null, "Cleaned_Text": "ä"}\n')
    assert corpus.read_articles(spark, str(folder)).count() == 2
    assert corpus.existing(spark, [str(folder), f"{folder}/none"]) == [str(folder)]
    query = counts.running_token_counts(counts.article_stream(spark, str(folder))).writeStream.format("memory").queryName("tokens_").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r["token"], r["n"]) for r in spark.table("tokens_").collect()} == {("yksi", 2), ("kaksi", 1), ("ä", 1)}
    corpus.write_articles(corpus.read_articles(spark, str(folder)), f"{tmp_path}/out")
    assert corpus.read_articles(spark, f"{tmp_path}/out").count() == 2


def test_sample_and_vocabulary(spark, tmp_path):
    sample = spark.createDataFrame([("fi", 1, "A b", "x\ny")], "lang string, ordinal int, Title string, Cleaned_Text string")
    corpus.write_sample(sample, f"{tmp_path}/s", "lang")
    lines = corpus.sample_lines(spark.read.parquet(f"{tmp_path}/s"), ["lang"]).orderBy("line_no").collect()
    assert [r["text"] for r in lines] == ["Title: A b", "x", "y", ""]
    corpus.write_vocabulary(spark.createDataFrame([(1, "b"), (0, "a")], "id int, token string"), f"{tmp_path}/v")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/v").collect()] == ["0\ta", "1\tb"]
    (tmp_path / "article_1.txt").write_text("yksi\n\nkaksi")
    assert corpus.read_lines(spark, f"{tmp_path}/article_*.txt").count() == 3


CONLL = "Talo\tB-LOC\non O\nkolme kenttää tässä\n\n<HEADLINE>\nei\tO\n\n\nviimeinen\tO"


def test_conll_readers(spark, tmp_path):
    (tmp_path / "a.conll").write_text(CONLL)
    got = [(r["sent_id"], r["pos"], r["word"], r["tag"]) for r in conll.read_conll(spark, f"{tmp_path}/a.conll").orderBy("sent_id", "pos").collect()]
    assert got == [(1, 0, "Talo", "B-LOC"), (1, 1, "on", "O"), (2, 0, "ei", "O"), (3, 0, "viimeinen", "O")]
    loose = conll.read_conll(spark, f"{tmp_path}/a.conll", conll.HISTOGRAM).groupBy("tag").count().collect()
    assert {r["tag"]: r["count"] for r in loose} == {"B-LOC": 1, "O": 3, "tässä": 1}
    (tmp_path / "b.conllup").write_text("# c\na\t1\t2\t3\t4\tB-PER\nb\tx\n\nc\t1\t2\t3\t4\tO\n")
    plus = conll.read_conll(spark, str(tmp_path), conll.PLUS, "*.conllup").orderBy("sent_id").collect()
    assert [(r["word"], r["tag"]) for r in plus] == [("a", "B-PER"), ("c", "O")]
    (tmp_path / "t.tsv").write_text("<HEADLINE>\nx\tO\tmore\ny\n")
    assert [r["word"] for r in conll.read_conll(spark, f"{tmp_path}/t.tsv", conll.TABULAR).collect()] == ["x"]
    (tmp_path / "s.json").write_text('[["yksi kaksi", "m"], ["kolme", "m"]]')
    assert [(r["sent_id"], r["word"]) for r in conll.read_sentence_json(spark, f"{tmp_path}/s.json").orderBy("sent_id", "pos").collect()] == [(1, "yksi"), (1, "kaksi"), (2, "kolme")]


@pytest.mark.parametrize("trailing", [True, False])
def test_conll_round_trip(spark, tmp_path, trailing):
    tokens = spark.createDataFrame([(1, 0, "a", "O"), (1, 1, "b", "B-X"), (2, 0, "c", "O")], "sent_id long, pos int, word string, tag string")
    conll.write_conll(tokens.repartition(3), f"{tmp_path}/o", trailing)
    text = "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/o/part-*")))
    assert text == "a\tO\nb\tB-X\n\nc\tO\n" + ("\n" if trailing else "")
    back = spark.read.text(f"{tmp_path}/o")
    n = back.count()
    conll.overwrite(spark, back, f"{tmp_path}/o", lambda df, p: df.write.text(p))
    assert spark.read.text(f"{tmp_path}/o").count() == n


V1 = '{"accuracy": 0.5, "classification_report": {"A": {"precision": 1.0, "recall": 0.5, "f1-score": 0.67, "support": 4}, "accuracy": 0.5, "macro avg": {"precision": 1, "recall": 1, "f1-score": 1, "support": 4}}, "confusion_matrix": [[2, 2], [0, 0]], "labels": ["A", "B"]}'
V4 = '{"average_accuracy": 0.8, "average_sentence_accuracy": 0.3, "classification_report": {"A": {"precision": 0.9, "recall": 0.8, "f1-score": 0.85, "support": 4.0}}, "training_duration_seconds": 3.5, "average_epochs": 200, "labels": ["A"]}'


def test_results(spark, tmp_path):
    for run, body, task in ((1, V1, "POS"), (5, V4, "NER"), (4, "{broken", "NER")):
        folder = tmp_path / f"Finnish Run {run}" / "Finnish Evaluation"
        folder.mkdir(parents=True)
        (folder / f"Finnish_Word_{task}_results.json").write_text(body)
    found = results.read_results(spark, str(tmp_path))
    rows = {(r["run"], r["label"]): (r["strategy"], r["task"], r["f1"], r["support"]) for r in results.reports(found).collect()}
    assert rows == {(1, "A"): ("Word", "POS", 0.67, 4), (5, "A"): ("Word", "NER", 0.85, 4)}
    stats = {r["run"]: (r["accuracy"], r["sentence_accuracy"], r["train_seconds"], r["epochs"]) for r in results.run_stats(found).collect()}
    assert stats == {1: (0.5, None, None, None), 5: (0.8, 0.3, 3.5, 200)}
    assert {(r["true_label"], r["pred_label"], r["n"]) for r in results.confusions(found).collect()} == {("A", "A", 2), ("A", "B", 2), ("B", "A", 0), ("B", "B", 0)}
    assert '"f1-score"' in results.result_json(results.reports(found), ["run"]).first()["json"]


def test_delta_files(spark, tmp_path):
    deltas = spark.createDataFrame([("A", 0.1, 0.2, 0.3)], "label string, precision_change double, recall_change double, f1_change double")
    results.write_deltas(deltas, f"{tmp_path}/Word")
    back = results.read_deltas(spark, {("Finnish", "Word"): f"{tmp_path}/Word"}).first()
    assert (back["Entity"], back["F1 Change"], back["Language"]) == ("A", 0.3, "Finnish")
    assert results.read_deltas(spark, {}).count() == 0


SMALL = "Talo\tB-LOC\non\tO\nuusi\tO\n\nKavumäki\tB-LOC\njärvi\tI-LOC\n\n<HEADLINE>\na\tO\nyö\tO\n\nolut\tB-PRO\n"
# Tokens and sentences; support by strategy; words shorter than each window; support of 5grams if empty sentences shift the pairs.
EXPECTED = {
    "small": (8, 4, {"Word": 8, "Char": 30, "Bigrams": 22, "Trigrams": 15, "4grams": 10, "5grams": 5}, {2: 1, 3: 3, 4: 3, 5: 6}, 0),
    "GOLDEN_CONLL": (
        36503, 2342, {"Word": 36503, "Char": 240504, "Bigrams": 204001, "Trigrams": 173089, "4grams": 144506, "5grams": 117702}, {2: 5591, 3: 7920, 4: 9699, 5: 12585}, 98044,
    ),
}


@pytest.mark.parametrize("name", ["small", *(["GOLDEN_CONLL"] if os.environ.get("GOLDEN_CONLL") else [])])
def test_known_numbers(spark, tmp_path, name):
    from tavuflow.operators import tokenize as K
    from tavuflow.operators.sequences import paired

    (tmp_path / "small").write_text(SMALL)
    n, sentences, supports, vanished, shifted = EXPECTED[name]
    tokens = conll.read_conll(spark, os.environ[name] if name != "small" else f"{tmp_path}/small")
    assert tokens.count() == n and tokens.select("sent_id").distinct().count() == sentences
    assert {r["strategy"]: r["support"] for r in K.support(tokens, "word", []).collect()} == supports
    assert {r["n"]: r["vanished"] for r in K.vanished(tokens, "word", []).collect()} == vanished
    sizes = tokens.groupBy("sent_id").agg(F.sum(F.greatest(F.char_length("word") - 4, F.lit(0))).alias("k"))
    have = sizes.filter("k > 0")
    pairs = paired(tokens, have, "sent_id", "compat").join(have.select(F.col("sent_id").alias("embedded_sent"), F.col("k").alias("a")), "embedded_sent").join(sizes, "sent_id")
    assert pairs.agg(F.sum(F.least("a", "k"))).first()[0] == shifted


def test_large_files_are_split(spark, tmp_path):
    """Line numbers and pages do not depend on where a file is cut."""
    lines = [f"sana{i}\tO" if i % 7 else "" for i in range(3000)]
    (tmp_path / "a.conll").write_text("\r\n".join(lines) + "\r\n")
    pages = [f"<page><title>t{i}</title><revision><id>{i if i % 10 else 'x'}</id><text>{'sana ' * (i % 40)}</text></revision></page>" for i in range(400)]
    (tmp_path / "plain.xml").write_text("\n".join(pages))
    (tmp_path / "packed.xml.bz2").write_bytes(bz2.compress("".join(f"<mediawiki>{p}</mediawiki>" for p in pages).encode()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = conll.file_lines(spark, f"{tmp_path}/a.conll")
        assert rows.rdd.getNumPartitions() > 3
        assert [(r["line_no"], r["line"]) for r in rows.orderBy("line_no").collect()] == [*enumerate(lines)]
        for name in ("plain.xml", "packed.xml.bz2"):
            got = wiki.read_pages(spark, f"{tmp_path}/{name}")
            counted = wiki.page_counts(got).first()
            assert (counted["pages"], counted["skipped"]) == (400, 40)
            assert {r["title"] for r in got.filter("_corrupt_record is null").collect()} == {f"t{i}" for i in range(400) if i % 10}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_failed_overwrite_loses_nothing(spark, tmp_path):
    spark.createDataFrame([("a",)], "value string").write.text(f"{tmp_path}/o")

    def fails(df, path):
        raise ValueError

    with pytest.raises(ValueError):
        conll.overwrite(spark, spark.read.text(f"{tmp_path}/o"), f"{tmp_path}/o", fails)
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/o").collect()] == ["a"]
    with pytest.raises(OSError):  # nothing was written beside it: the old one comes back
        conll.overwrite(spark, spark.read.text(f"{tmp_path}/o"), f"{tmp_path}/o", lambda df, path: None)
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/o").collect()] == ["a"]


def test_kept_tables(spark):
    import uuid

    from tavuflow.session import keyed

    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    name = uuid.uuid4().hex
    assert [keyed(spark, name, {"lang": "fi", "run": r}, build).count() for r in ("1", "1", "2")] == [3, 3, 3] and len(calls) == 2


def test_command_line(spark, tmp_path, monkeypatch):
    from tavuflow import __main__ as command

    monkeypatch.setattr(command, "release", lambda spark: None)  # other tests' tables lie there too
    command.main(["--data", "/root/testdata/sf0.001", "--out", f"{tmp_path}/rows", "--query", "fold_sizes"])
    assert spark.read.parquet(f"{tmp_path}/rows").count() > 0
    command.main(["--data", "/root/testdata/sf0.001", "--out", f"{tmp_path}/study", "--mode", "test", "--strategies", "Word", "--run", "7"])
    stats = results.run_stats(results.read_results(spark, f"{tmp_path}/study")).collect()
    assert {(r["strategy"], r["run"]) for r in stats} == {("Word", 7)} and all(r["train_seconds"] > 0 and 0 < r["accuracy"] <= 1 for r in stats)
    with pytest.raises(SystemExit):
        command.main(["--data", "x"])
