"""What must hold of the queries that have no SQL beside them, over whole tables of the smallest scale."""

from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from tavuflow.llm import bytebpe, catalog, neardup, sentences
from tavuflow.llm.queries import CAPACITY

tokenizers = pytest.importorskip("tokenizers")
SF = "/root/testdata/sf0.001"


def rows_of(sql):
    return duckdb.sql(sql.replace("@", f"'{SF}/").replace("~", ".parquet'")).fetchall()


@pytest.fixture(scope="module")
def got(spark):
    kept = {}

    def run(name):
        if name not in kept:
            df = catalog.queries()[name](spark, SF)
            assert len(set(df.columns)) == len(df.columns)
            kept[name] = df.collect()
        return kept[name]

    return run


ARTICLES = dict(rows_of("select article_id, Cleaned_Text from @articles~"))
DOCUMENTS = dict(rows_of("select doc_id, text from @documents~"))


def test_text_types(got):
    rows = {r["article_id"]: r for r in got("p1_statistics")}
    assert rows.keys() == ARTICLES.keys() and len(got("p1_statistics")) == len(rows)
    for key, r in rows.items():
        blank = not (ARTICLES[key] or "").strip()
        assert (r["type"] is None) == blank == (r["n_lines"] == 0)
        if not blank:
            assert abs(sum(r[t] for t in ("prose", "list", "table", "junk")) - 1) < 1e-6 and 0 <= r["confidence"] <= 1
    assert {r["article_id"] for r in got("p1_found")} == {k for k, r in rows.items() if r["type"] not in (None, "prose")}


def test_languages(got):
    rows = {r["article_id"]: r for r in got("p2_languages")}
    assert rows.keys() == ARTICLES.keys() and len(got("p2_languages")) == len(rows)
    labels = {"fi", "tr", "sw", "hu", "en", "sv", "et", "az"}
    assert {r["language"] for r in rows.values()} <= labels | {None}
    told = [r for r in rows.values() if r["language"] and r["label"]]
    assert sum(r["language"] == r["label"] for r in told) / len(told) > 0.8  # some labels are wrong
    for r in rows.values():
        assert r["language"] is None or 0 < r["confidence"] <= 1
    found = got("p2_found")
    assert len(set(found)) == len(found)
    for r in found:
        text = ARTICLES[r["article_id"]]
        assert len(text) >= 200 and r["lang"] in labels and -1 <= r["line_no"] < len(text.split("\n"))
        whole = rows[r["article_id"]]
        if r["line_no"] < 0:
            assert r["lang"] == whole["language"] != whole["label"]
        else:
            assert r["lang"] != whole["language"] and r["lang"] in {s["language"] for s in whole["segments"] if s["line_no"] == r["line_no"]}


def test_links(got):
    pairs = {(r["article_id_a"], r["article_id_b"]) for r in got("p6_found")}
    links = got("p6_links")
    assert {(r["article_id_a"], r["article_id_b"]) for r in links} <= pairs
    for r in links:
        a, b = (neardup.normalize_codes(*neardup.to_codes(pa.array([ARTICLES[r[f"article_id_{s}"]]]))) for s in "ab")
        a, b = ("".join(map(chr, x[0])).lower().split() for x in (a, b))
        x, y = ({tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (a, b))
        assert abs(r["similarity"] - len(x & y) / len(x | y)) < 1e-9 and r["similarity"] >= 0.5
        if r["edits"] is not None:
            assert abs(r["edit_similarity"] - (1 - r["edits"] / max(len(a), len(b)))) < 1e-9
    groups = {r["article_id"]: r["group_id"] for r in got("p6_groups")}
    assert all(groups[a] == groups[b] for a, b in pairs)


@pytest.mark.parametrize("name", ["p7_token_budget", "p7_unigram_budget"])
def test_budgets(got, name):
    rows = got(name)
    each = {r["article_id"]: r for r in rows if r["level"] == "document"}
    assert each.keys() == ARTICLES.keys()
    for level in ("source", "language", "topic", "all"):
        own = [r for r in rows if r["level"] == level]
        assert sum(r["tokens"] for r in own) == sum(r["tokens"] for r in each.values()) and sum(r["documents"] for r in own) == len(each)
    for level in ("source", "language", "topic"):
        sums = Counter()
        for r in each.values():
            sums[r[level]] += r["tokens"]
        assert {r[level]: r["tokens"] for r in rows if r["level"] == level} == sums
    if name == "p7_token_budget":
        library = tokenizers.Tokenizer.from_file(bytebpe.vocabulary_path())
        library.encode_special_tokens = True
        assert all(each[k]["tokens"] == len(library.encode(t or "", add_special_tokens=False).ids) for k, t in ARTICLES.items())


def test_ids(got):
    library = tokenizers.Tokenizer.from_file(bytebpe.vocabulary_path())
    library.encode_special_tokens = True
    rows = got("p8_ids")
    assert len(rows) == len(DOCUMENTS)
    assert all(r["ids"] == library.encode(DOCUMENTS[r["doc_id"]] or "", add_special_tokens=False).ids for r in rows)


def test_packing(got):
    sizes = {r["doc_id"]: len(r["ids"]) for r in got("p8_ids")}
    parts, boxes = defaultdict(list), defaultdict(int)
    for r in got("p9_packing"):
        parts[r["doc_id"]].append((r["part"], r["start_at"], r["n"]))
        boxes[r["container_id"]] += r["n"]
    assert parts.keys() == {k for k, n in sizes.items() if n} and max(boxes.values()) <= CAPACITY
    for key, own in parts.items():
        at = 0
        for i, (part, start, n) in enumerate(sorted(own)):
            assert (part, start) == (i, at)
            at += n
        assert at == sizes[key] and (len(own) == 1 or at > CAPACITY)
    # No packing needs fewer than the whole size asks for; first-fit decreasing needs at most 11/9 of the best and one more.
    least = -(-sum(sizes.values()) // CAPACITY)
    assert least <= len(boxes) <= 11 / 9 * least + 1


def test_sentence_units(got):
    places = defaultdict(list)
    for r in got("p10_sentences"):
        text = DOCUMENTS[r["doc_id"]]
        assert text[r["start_at"] : r["end_at"]] == r["unit"] and r["unit"].strip(sentences._TRIM) == r["unit"] != ""
        places[r["doc_id"]].append((r["start_at"], r["end_at"]))
    for key, text in DOCUMENTS.items():
        at, own = 0, sorted(places.get(key, []))
        for start, end in own:  # nothing but white space is left out, nothing is told twice
            assert at <= start < end and not text[at:start].strip(sentences._TRIM)
            at = end
        assert not (text or "")[at:].strip(sentences._TRIM)
    assert {(r["doc_id"], r["start_at"], r["end_at"]) for r in got("p10_found")} == {(k, s, e) for k, own in places.items() for s, e in own}


def test_every_query_is_compared():
    own = {"p1_found", "p1_statistics", "p2_found", "p2_languages", "p6_links", "p7_token_budget", "p7_unigram_budget", "p8_ids", "p9_packing", "p10_found", "p10_sentences"}
    assert set(catalog.queries()) == own | set(catalog.oracle_sql())
