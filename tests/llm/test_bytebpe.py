import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import pyarrow as pa
from tavuflow.llm import budget, bytebpe, packing, unigram

tokenizers = pytest.importorskip("tokenizers")
PATH = bytebpe.vocabulary_path()


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def own():
    return bytebpe.Encoder(PATH)


def both(own, library, texts):
    ids, at = own.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert own.count(pa.array(texts)).tolist() == [b - a for a, b in zip(at[:-1], at[1:], strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("ab 's't're've'll'd'm\n\t 12é日.,!½'’"), st.characters(exclude_categories=["Cs"])), max_size=30), min_size=1, max_size=5))
def test_is_the_library(own, library, texts):
    both(own, library, texts)


def test_long_and_special(own, library):
    both(own, library, ["<|endoftext|> x", "", None, "a" * 4000, " " * 3000, "ทะเลสาบ" * 200, "x" * 50 + "\n\n\n  y", "don't'll 'tis ''s"])
    rnd = random.Random(3)
    letters = ["".join(rnd.choice(own_) for _ in range(n)) for own_ in ("etaoinshrd", "ab", "aé湖", "lorem") for n in (1023, 1025, 1026, 6000)]
    both(own, library, [*letters, "ab" * 3000 + "a", "aab" * 2001, "=" * 5001])


def test_a_long_piece_costs_little(own):
    rnd = random.Random(4)
    text = "".join(rnd.choice("etaoinshrdlucmfw") for _ in range(60_000))
    began = time.perf_counter()
    own.count(pa.array([text]))
    assert time.perf_counter() - began < 8


def test_frames(spark, library):
    df = spark.createDataFrame([(1, "yksi kaksi", "k"), (2, None, "k"), (3, "", "k"), (1, "yksi kaksi", "k")], "id long, t string, ids string")
    rows = bytebpe.token_ids(df, "t", PATH).collect()
    assert sorted((r["id"], tuple(r["ids"])) for r in rows) == sorted((i, tuple(library.encode(t or "").ids)) for i, t in [(1, "yksi kaksi"), (2, ""), (3, ""), (1, "yksi kaksi")])
    assert bytebpe.token_counts(df.limit(0), "t", PATH).count() == 0


def test_budget(spark):
    rows = [(1, "s1", "fi", None, 3), (2, "s1", None, "x", 4), (3, None, "fi", "x", None)]
    df = spark.createDataFrame(rows, "id long, source string, language string, topic string, n_tokens long")
    got = {(r["level"], r["id"], r["source"], r["language"], r["topic"]): (r["documents"], r["tokens"]) for r in budget.budget(df, "id", "n_tokens", ["source", "language", "topic"]).collect()}
    assert got["document", 3, None, "fi", "x"] == (1, 0)
    assert got["source", None, "s1", None, None] == (2, 7) and got["source", None, None, None, None] == (1, 0)
    assert got["language", None, None, "fi", None] == (2, 3) and got["topic", None, None, None, "x"] == (2, 4)
    assert got["all", None, "s1", "fi", None] == (1, 3) and sum(k[0] == "all" for k in got) == 3


def pack(spark, sizes, capacity):
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "id long, n_tokens long, part string").repartition(3)
    return packing.pack(df, "id", "n_tokens", capacity).collect()


def test_packing_keeps_everything(spark, rnd):
    sizes = [rnd.choice([0, 1, 5, 60, 100, 101, 250, None]) if rnd.random() < 0.3 else rnd.randrange(1, 90) for _ in range(400)]
    rows = pack(spark, sizes, 100)
    parts = {}
    for r in rows:
        parts.setdefault(r["id"], []).append((r["part"], r["start_at"], r["n"]))
    assert sorted(parts) == [i for i, n in enumerate(sizes) if n]
    for i, own in parts.items():
        own.sort()
        assert sum(n for _, _, n in own) == sizes[i] and [s for _, s, _ in own] == list(range(0, sizes[i], 100)) and (sizes[i] > 100) == (len(own) > 1)
    filled = {}
    for r in rows:
        filled[r["container_id"]] = filled.get(r["container_id"], 0) + r["n"]
    assert max(filled.values()) <= 100 and sorted(filled) == list(range(len(filled)))
    assert len(filled) <= -(-sum(n or 0 for n in sizes) // 100) + 3


def test_packing_edges(spark):
    assert pack(spark, [], 10) == [] and pack(spark, [0, None], 10) == []
    assert len({r["container_id"] for r in pack(spark, [5] * 9, 10)}) == 5
    with pytest.raises(ValueError):
        pack(spark, [1], 0)


def best(pieces, segment, unknown, cost):
    """Brute force over ends: score and pieces of the best path, ties by fewer pieces."""
    at = [(0.0, 0)] + [(-1e300, 0)] * len(segment)
    for i in range(len(segment)):
        ends = [(i + 1, unknown, cost(segment[i]))] + [(j, pieces[segment[i:j]], 1) for j in range(i + 1, len(segment) + 1) if segment[i:j] in pieces]
        for j, score, n in ends:
            new = (at[i][0] + score, at[i][1] + n)
            if (new[0], -new[1]) > (at[j][0], -at[j][1]):
                at[j] = new
    return at[-1][1]


@pytest.mark.parametrize("fallback", [False, True])
def test_unigram_count_is_the_best_path(spark, rnd, fallback, monkeypatch):
    monkeypatch.setattr(unigram, "STEP_CHARACTERS", 200)
    pieces = {c: -rnd.uniform(2, 6) for c in "abc▁"}
    pieces |= {"".join(rnd.choice("abc▁") for _ in range(rnd.randrange(2, 6))): -rnd.uniform(1, 8) for _ in range(60)} | {"▁" + x: -3.0 for x in ("a", "ab")}
    trie = unigram.DoubleArrayTrie(pieces, fallback)
    texts = [" ".join("".join(rnd.choice("abcé湖") for _ in range(rnd.randrange(1, 14))) for _ in range(rnd.randrange(6))) for _ in range(150)]
    texts += [None, "", " \n ", "ab" * 3000, "ab ba", "ab ba"]
    cost = lambda c: len(c.encode()) if fallback else 1
    expected = [sum(best(pieces, "▁" + w, trie.unknown, cost) for w in (t or "").split()) for t in texts]
    own = unigram.Counter(trie)
    assert own.count(pa.array(texts)).tolist() == expected == own.count(pa.array(texts)).tolist()
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "id long, t string, n_tokens string").repartition(3)
    assert [r["n_tokens"] for r in unigram.counts(df, "t", trie).orderBy("id").collect()] == expected
    assert unigram.counts(df.limit(0), "t", trie).count() == 0


def test_scored_pieces():
    scores, fallback = unigram.scored_pieces(f"{bytebpe.DEFAULT_DIR}/piece_bpe_32k.model")
    assert fallback and len(scores) == 32000 - 3 - 256 and scores["▁t"] > scores["om"] > scores["ң"]
    counter = unigram.Counter(unigram.DoubleArrayTrie(scores, fallback))
    assert counter.count(pa.array(["Hello", "Hello Hello", None, "\U0010fffd"])).tolist() == [1, 2, 0, 5]
