"""Every query with a SQL counterpart gives the same rows at the smallest scale; the others keep what must hold of them."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from tavuflow.plans import catalog
from verify import plain

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in sorted(os.listdir(SF)):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'").fetchall()
    return con


@pytest.mark.parametrize("name", sorted(set(entry.queries()) & set(entry.oracle_sql())))
def test_same_as_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    theirs = Counter(plain(tuple(r[i] for i in at)) for r in rel.fetchall())
    assert Counter(plain(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()) == theirs


def _scores(rows):
    """A report: shares between 0 and 1, and the support of all labelled tokens."""
    assert all(0 <= r[c] <= 1 for r in rows for c in ("precision", "recall", "f1"))
    assert all(min(r["precision"], r["recall"]) - 1e-9 <= r["f1"] <= max(r["precision"], r["recall"]) + 1e-9 or r["f1"] == 0 for r in rows)
    keys = [(r.asDict().get("lang"), r["label"]) for r in rows]
    assert len(set(keys)) == len(keys)
    return {k: r["support"] for k, r in zip(keys, rows, strict=True)}


LABELLED = "(select * from (select * from ner_tokens qualify row_number() over (partition by token_id order by loaded_at desc nulls last) = 1) where word is not null and tag is not null)"


def _report_by_language(rows, con):
    assert _scores(rows) == {(a, b): n for a, b, n in con.sql(f"select lang, tag, count(*) from {LABELLED} group by all").fetchall()}
    right = sum(r["recall"] * r["support"] for r in rows) / sum(r["support"] for r in rows)
    assert right > 0.6  # more than the share of the outside label would need


def _report(rows, con):
    assert _scores(rows) == {(None, b): n for b, n in con.sql(f"select tag, count(*) from {LABELLED} group by all").fetchall()}


def _bpe_tokens(rows, con):
    """No character is lost or made."""
    made = sum(r["n"] * len(r["token"].removesuffix("</w>")) for r in rows)
    words = sum(r["n"] for r in rows if r["token"].endswith("</w>"))
    text = [t for (t,) in con.sql("select Cleaned_Text from articles where Cleaned_Text is not null").fetchall()]
    lower = [w for t in text for w in t.lower().split()]
    assert made == sum(map(len, lower)) and words == len(lower) and len({r["token"] for r in rows}) == len(rows)


def _training_runs(rows, con):
    assert {r["lang"] for r in rows} == {x for (x,) in con.sql("select distinct lang from ner_tokens").fetchall()}
    assert all(r["folds"] == 3 and r["right"] and 3 * 9 <= r["epochs"] <= 1500 and r["best_loss"] < r["first_loss"] for r in rows)


def _top_weights(rows, con):
    models = {(r["lang"], r["held_out"]) for r in rows}
    assert len(rows) == 10 * len(models) and {r["place"] for r in rows} == set(range(10)) and len(models) == 12
    for m in models:
        weights = [r["weight"] for r in sorted(rows, key=lambda r: r["place"]) if (r["lang"], r["held_out"]) == m]
        assert weights == sorted(weights, reverse=True) and weights[-1] > 0
    tags = {x for (x,) in con.sql("select distinct tag from ner_tokens").fetchall()}
    assert {r["label"] for r in rows} <= tags and all(r["feature"].split("=")[0].startswith(("token.lower", "emb_dim_", "position_ratio", "context_")) for r in rows)


INVARIANTS = {
    "bpe_tokens": _bpe_tokens, "lr_tagger_eval": _report, "crf_tagger_eval": _report_by_language, "sgd_tagger_eval": _report_by_language, "sgd_training_runs": _training_runs, "crf_top_weights": _top_weights,
}


@pytest.mark.parametrize("name", sorted(INVARIANTS))
def test_invariants(spark, con, name):
    INVARIANTS[name](catalog.queries()[name](spark, SF).collect(), con)


def test_every_query_is_compared():
    assert set(catalog.queries()) == set(catalog.oracle_sql()) | set(INVARIANTS)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
