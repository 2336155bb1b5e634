import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tavuflow.operators import analytics as A
from tavuflow.operators import bpe, crf, sampling
from tavuflow.operators import metrics as M
from tavuflow.operators import sequences as S


def brute_sample(rows, target, top_kb, least_kb):
    """Passes over the tiers, each in file order."""
    taken, titles = [], set()
    for tier in range(top_kb, least_kb - 1, -1):
        for title, text in rows:
            title, text = (title or "").strip(), (text or "").strip()
            if title and text and title not in titles and len(text.encode()) >= tier * 1024 and len(taken) < target:
                titles.add(title)
                taken.append(title)
    return taken


def test_tiered_sample(spark):
    rnd = random.Random(1)
    rows = [(f"t{rnd.randrange(60)}" if rnd.random() > 0.1 else rnd.choice([None, "", " "]), rnd.choice(["ä", "x"]) * rnd.randrange(1, 5200)) for _ in range(150)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "pos long, Title string, Cleaned_Text string")
    for target in (7, 1000):
        got = [r["Title"] for r in sampling.tiered_sample(df, "Title", "Cleaned_Text", "pos", target).orderBy("ordinal").collect()]
        assert got == brute_sample(rows, target, 4, 1)


def test_latest_and_sentence_ids(spark):
    rows = spark.createDataFrame([(1, "a", 5), (1, "b", 7), (2, "c", None), (2, "d", 1)], "token_id long, word string, loaded_at int")
    assert {(r["token_id"], r["word"]) for r in S.latest(rows, "token_id", "loaded_at").collect()} == {(1, "b"), (2, "d")}
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(["a", "", "", "b", "c", ""])], "p string, n int, t string").selectExpr("p", "n", "t", "t = '' as blank")
    got = [(r["t"], r["sent_id"], r["pos"]) for r in S.sentence_ids(lines, "p", "n", "blank").orderBy("n").collect()]
    assert got == [("a", 1, 0), ("b", 2, 0), ("c", 2, 1)]


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_sentence_ids_over_blocks(spark, block):
    rnd = random.Random(block)
    rows, expected = [], {}
    for part in ("f", None, "g"):
        sent, pos, open_ = 0, 0, False
        for n in range(90):
            blank = rnd.random() < (0.05 if n < 40 else 0.5)
            rows.append((part, n, blank))
            if blank:
                open_ = False
                continue
            sent, pos = (sent, pos + 1) if open_ else (sent + 1, 0)
            open_ = True
            expected[part, n] = (sent, pos)
    lines = spark.createDataFrame(rows, "p string, n int, blank boolean").repartition(3)
    assert {(r["p"], r["n"]): (r["sent_id"], r["pos"]) for r in S.sentence_ids(lines, "p", "n", "blank", block).collect()} == expected
    assert S.sentence_ids(lines.limit(0), "p", "n", "blank", block).count() == 0


def test_exact_splits(spark):
    rows = spark.createDataFrame([(i % 37,) for i in range(100)], "sent_id long").repartition(5)
    split = S.split_exactly(rows, "sent_id").distinct().groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"train": 33, "test": 4} and S.split_exactly(rows, "sent_id").count() == 100
    assert sorted(r["count"] for r in S.equal_folds(rows, "sent_id").groupBy("fold").count().collect()) == [12, 12, 13]
    assert S.equal_folds(rows.limit(0), "sent_id").count() == 0


def brute_report(pairs):
    out = {}
    for label in {t for t, _ in pairs}:
        hit = sum(t == p == label for t, p in pairs)
        predicted, support = sum(p == label for _, p in pairs), sum(t == label for t, _ in pairs)
        precision, recall = hit / predicted if predicted else 0, hit / support
        out[label] = (precision, recall, 2 * precision * recall / (precision + recall) if precision + recall else 0, support)
    return out


def test_report_and_confusion(spark):
    rnd = random.Random(2)
    pairs = [(rnd.choice("ABC"), rnd.choice("ABCD")) for _ in range(300)] + [("E", "A")]
    df = spark.createDataFrame(pairs, "t string, p string")
    got = {r["label"]: tuple(r)[1:] for r in M.report(df, "t", "p").collect()}
    expected = brute_report(pairs)
    assert got.keys() == expected.keys() and all(np.allclose(got[k], expected[k]) for k in got)
    assert sum(r["n"] for r in M.confusion(df, "t", "p").collect()) == len(pairs)
    mean = M.averages(M.report(df, "t", "p")).first()
    assert math.isclose(mean["macro_f1"], np.mean([v[2] for v in expected.values()]))


def test_early_stop_and_loss(spark):
    values = [1.0, 0.5, 0.49995, 0.6, 0.7, 0.4, 0.4]
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "run string, epoch int, loss double")
    assert M.early_stop(df, ["run"], "epoch", "loss", patience=3).first()["stop_epoch"] == 4
    assert M.early_stop(df, ["run"], "epoch", "loss", patience=8).first()["stop_epoch"] is None
    chances = spark.createDataFrame([(1.0,), (0.5,)], "p double")
    assert math.isclose(M.log_loss(chances, "p", []).first()["loss"], math.log(2) / 2, rel_tol=1e-9)


def test_delta_keeps_old_labels(spark):
    rows = [("fi", "Word", 1, "A", 0.5, 0.5, 0.5, 3), ("fi", "Word", 1, "B", 0.2, 0.2, 0.2, 3), ("fi", "Word", 2, "A", 0.7, None, 0.6, 3), ("fi", "Word", 2, "C", 1.0, 1.0, 1.0, 1), ("fi", "Word", 4, "A", 1.0, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows + rows[:1], "lang string, strategy string, run int, label string, precision double, recall double, f1 double, support long")
    got = {(r["run"], r["label"]): (round(r["precision_change"], 6), round(r["recall_change"], 6)) for r in A.run_delta(df, ["lang", "strategy"]).collect()}
    assert got == {(2, "A"): (0.2, -0.5), (2, "B"): (-0.2, -0.2)}


def test_ranking_ties_go_backwards(spark):
    df = spark.createDataFrame([("a", 0.5), ("c", 0.5), ("b", None)], "strategy string, v double").selectExpr("1 as g", "*")
    assert [r["strategy"] for r in A.ranking(df, ["g"], "v", "strategy").orderBy("place").collect()] == ["c", "a", "b"]


def test_fold_plan():
    plan = S.fold_plan(list(range(10)))
    assert sorted(s for s, _ in plan) == list(range(10)) and sorted([f for _, f in plan].count(k) for k in range(3)) == [3, 3, 4]
    assert plan == S.fold_plan(list(range(10)))


def test_pairing_modes(spark):
    words = spark.createDataFrame([(1,), (2,), (3,)], "sent_id long")
    have = words.filter("sent_id <> 2")
    pair = lambda mode: sorted(tuple(r) for r in S.paired(words, have, "sent_id", mode).collect())
    assert pair("correct") == [(1, 1), (3, 3)] and pair("compat") == [(1, 1), (2, 3)]
    with pytest.raises(ValueError):
        S.paired(words, have, "sent_id", "other")


def merged(words, ranks):
    """Brute force: the pair of least rank at all places from the left, until none is left."""
    out = []
    for word in words:
        symbols = [*word[:-1], word[-1] + "</w>"] if word else []
        while True:
            pairs = [ranks[p] for p in zip(symbols, symbols[1:], strict=False) if p in ranks]
            if not pairs:
                break
            i, new = 0, []
            while i < len(symbols):
                two = tuple(symbols[i : i + 2])
                hit = len(two) == 2 and ranks.get(two) == min(pairs)
                new.append("".join(two) if hit else symbols[i])
                i += 2 if hit else 1
            symbols = new
        out.append(symbols)
    return out


def test_merges_of_brute_force():
    rnd = random.Random(5)
    ranks, known = {}, ["a", "b", "c", "a</w>", "b</w>", "c</w>"]
    while len(ranks) < 60:
        pair = (rnd.choice([x for x in known if not x.endswith("</w>")]), rnd.choice(known))
        if pair not in ranks:
            ranks[pair] = len(ranks)
            known.append("".join(pair))
    words = ["".join(rnd.choice("aaabbcd") for _ in range(rnd.randrange(0, 30))) for _ in range(300)] + ["a" * 1001, "", "d"]
    made = bpe.Merger([(r, a, b) for (a, b), r in ranks.items()], "</w>", "").encode(pa.array(words))
    assert made.to_pylist() == merged(words, ranks)
    assert bpe.Merger([], "", "_").encode(pa.array(["ab"])).to_pylist() == [["_a", "b"]]


def test_bpe_is_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = "/opt/tokenizers/word_bpe_49k.json"
    library = tokenizers.Tokenizer.from_file(path)
    texts = ["the lower bridges", "museum", "a", "tietokone kirjasto"]
    merges, vocabulary = bpe.read_vocabulary_file(spark, path)
    encode = bpe.encoder(spark, merges, lower=True)
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = [r[0] for r in df.select(encode(df["t"])).collect()]
    assert got == [library.encode(t, add_special_tokens=False).tokens for t in texts] + [None]
    assert vocabulary.count() == len({r["id"] for r in vocabulary.collect()})


def brute_likelihood(unary, transitions, gold):
    n, k = unary.shape
    score = lambda path: sum(unary[i, y] for i, y in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:], strict=False))
    return math.log(sum(math.exp(score(p)) for p in itertools.product(range(k), repeat=n))) - score(gold)


def test_crf_likelihood_and_gradient():
    rnd = np.random.default_rng(0)
    unary, transitions = rnd.normal(size=(2, 4, 3)), rnd.normal(size=(3, 3))
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)
    gold = rnd.integers(0, 3, (2, 4))
    value, by_unary, by_transitions = crf.likelihood(unary, transitions, mask, gold)
    assert math.isclose(value, brute_likelihood(unary[0], transitions, gold[0]) + brute_likelihood(unary[1, :2], transitions, gold[1, :2]), rel_tol=1e-9)
    for i in range(3):
        moved = transitions.copy()
        moved[i, 1] += 1e-6
        assert math.isclose((crf.likelihood(unary, moved, mask, gold)[0] - value) / 1e-6, by_transitions[i, 1], abs_tol=1e-4)
    moved = unary.copy()
    moved[1, 1, 2] += 1e-6
    assert math.isclose((crf.likelihood(moved, transitions, mask, gold)[0] - value) / 1e-6, by_unary[1, 1, 2], abs_tol=1e-4)


def test_crf_learns_context():
    rnd = random.Random(4)
    sentences, tags = [], []
    for _ in range(60):
        words, own = [], []
        for _ in range(rnd.randrange(2, 7)):
            if rnd.random() < 0.4:
                words += ["rouva", rnd.choice("abcd")]
                own += ["O", "B-PER"]
            else:
                words.append(rnd.choice(["on", "ja", "a", "b"]))
                own.append("O")
        sentences.append([{zlib.crc32(w.encode()) % 1000: 1.0, 1001: 1.0} for w in words])
        tags.append(own)
    tokens = crf.Tokens.of(sentences, tags)
    model = crf.fit(tokens, rounds=60)
    found = model.predict(tokens)
    assert (np.array(model.labels)[found] == tokens.tags).mean() > 0.85 and len(crf.top_weights(model)) == 10
    # The best path of each sentence is that of brute force.
    unary, at = model.scores(tokens), 0
    for n in tokens.lengths:
        paths = itertools.product(range(len(model.labels)), repeat=int(n))
        score = lambda p: sum(unary[at + i, y] for i, y in enumerate(p)) + sum(model.transitions[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        assert math.isclose(score(tuple(found[at : at + n])), max(map(score, paths)), rel_tol=1e-9)
        at += n
    unseen = crf.Tokens.of([[{5000: 1.0}, {}], []])
    assert len(model.predict(unseen)) == 2


def test_shared_tables(spark):
    from tavuflow import session

    df = spark.range(5).toDF("id")
    kept = session.materialize(df, "t")
    assert kept.count() == 5 and session.bounded(kept, 3).count() == session.bounded(kept, 30).count() == 5
    session.release(spark)
    assert not session.hadoop_exists(spark, session.shared_dir(spark) + "/tavuflow")
