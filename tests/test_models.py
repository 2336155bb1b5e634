"""Models: full settings in the registered queries, training, application."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from tavuflow.config import VECTOR_SIZE
from tavuflow.operators import crf, embed, tagger
from tavuflow.operators import metrics as M
from tavuflow.operators import sequences as S
from tavuflow.plans import models


class Called(Exception):
    pass


@pytest.mark.parametrize(
    ("query", "module", "name", "wanted"),
    [
        (models.crf_tagger_eval, crf, "cross_validate", {"sample": crf.SAMPLE_SENTENCES, "fitted": crf.fit}),
        (models.sgd_tagger_eval, crf, "cross_validate", {"sample": crf.SAMPLE_SENTENCES, "fitted": crf.fit_sgd}),
        (models.lr_tagger_eval, tagger, "cross_validate", {"rounds": 500}),
        (models.word2vec_vectors, embed, "train_word2vec", {"size": VECTOR_SIZE}),
    ],
)
def test_full_settings(spark, monkeypatch, query, module, name, wanted):
    signature = inspect.signature(getattr(module, name))

    def record(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        raise Called({k: bound.arguments[k] for k in wanted})

    monkeypatch.setattr(module, name, record)
    with pytest.raises(Called) as found:
        query(spark, "/root/testdata/sf0.001")
    assert found.value.args[0] == wanted


def test_default_settings():
    assert {k: p.default for k, p in inspect.signature(crf.fit).parameters.items() if k != "tokens"} == {"c1": 0.05, "c2": 0.05, "rounds": 200}
    wanted = {"epochs": 500, "patience": 8, "delta": 1e-4}
    assert {k: inspect.signature(crf.fit_sgd).parameters[k].default for k in wanted} == wanted


def test_sgd_stops_early(spark):
    sentences = [[{i % 7: 1.0, 100 + i % 3: 0.5}] for i in range(300)]
    tokens = crf.Tokens.of(sentences, [["ABC"[i % 7 % 3]] for i in range(300)])
    model = crf.fit_sgd(tokens)
    assert (np.array(model.labels)[model.predict(tokens)] == tokens.tags).mean() == 1 and model.losses[0] > model.losses[-1]
    losses = spark.createDataFrame([(1, i, x) for i, x in enumerate(model.losses)], "g int, epoch int, loss double")
    stop = M.early_stop(losses, ["g"], "epoch", "loss").first()
    assert stop["stop_epoch"] is None and len(model.losses) == 500 or stop["stop_epoch"] == len(model.losses) - 1
    noise = np.random.default_rng(0)
    blind = crf.fit_sgd(crf.Tokens.of([[{0: 1.0}]] * 200, [[x] for x in noise.choice(list("AB"), 200)]))
    assert len(blind.losses) < 100
    assert crf.fit_sgd(crf.Tokens.of([], [])).predict(crf.Tokens.of([], [])).size == 0


def test_dense_and_sparse_columns_agree(monkeypatch):
    rnd = np.random.default_rng(1)
    sentences = [[{int(c): float(rnd.normal()) for c in rnd.choice(40, rnd.integers(0, 9), replace=False)} for _ in range(rnd.integers(1, 6))] for _ in range(50)]
    tokens = crf.Tokens.of(sentences, [["O"] * len(s) for s in sentences])
    made = []
    for share in (0.0, 0.12, 2.0):
        monkeypatch.setattr(crf, "DENSE_SHARE", share)
        made.append(crf.Design(tokens))
    weights, by_token = rnd.normal(size=(len(made[0].columns), 3)), rnd.normal(size=(made[0].n, 3))
    for d in made[1:]:
        assert np.allclose(d.times(weights), made[0].times(weights)) and np.allclose(d.transposed_times(by_token), made[0].transposed_times(by_token))


@pytest.mark.parametrize("part_bytes", [1, 1 << 28])
def test_cross_validation_keeps_all_rows(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(crf, "MODEL_BYTES", part_bytes)
    words = ["talo", "on", "Kavu", "ja", "Melo"]
    rows = [(lang, s, p, f"{words[(s + p) % 5]}", "B-X" if words[(s + p) % 5][0].isupper() else "O", s % 3) for lang in ("a", None) for s in range(12) for p in range(1 + s % 4)]
    rows += [("lone", 99, 0, "talo", "O", 1)]  # nothing to fit on but itself
    df = spark.createDataFrame(rows, "lang string, sent_id long, pos int, word string, tag string, fold int").withColumn("vector", F.array(F.length("word").cast("float"), F.lit(0.5).cast("float")))
    made = S.feature_rows(df.withColumn("sent_id", F.xxhash64("lang", "sent_id")), "sent_id", ["pos"], "word", "vector")
    got = crf.cross_validate(made, ["lang"]).collect()
    assert len(got) == len(rows) and {r["pred"] for r in got if r["lang"] == "lone"} == {None}
    told = [r for r in got if r["lang"] != "lone"]
    assert sum(r["pred"] == r["tag"] for r in told) / len(told) > 0.95
    assert crf.cross_validate(made.limit(0), ["lang"]).count() == 0


def test_word2vec_is_kept(spark, tmp_path):
    lines = spark.createDataFrame([(["talo", "on", "uusi"],), ([],), (None,)], "tokens array<string>")
    model = embed.train_word2vec(lines, "tokens", size=5)
    embed.save_model(model, f"{tmp_path}/m")
    embed.save_model(model, f"{tmp_path}/m")
    rows = lambda m: {r["token"]: r["vector"] for r in embed.vectors(m).collect()}
    assert rows(embed.load_model(f"{tmp_path}/m")) == rows(model) and len(rows(model)) == 3
    assert {r["token"]: r["id"] for r in embed.vocabulary_lines(spark.createDataFrame([(t,) for t in "bbacccc"], "t string"), "t").withColumnRenamed("t", "token").collect()} == {"c": 0, "b": 1, "a": 2}
