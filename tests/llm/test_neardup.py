import numpy as np
import pytest

from tavuflow.llm import neardup as N


def words(text):
    return text.lower().split()


def jaccard(a, b, k=3):
    x, y = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (words(a), words(b)))
    return len(x & y) / len(x | y)


def corpus(rnd, n=60):
    texts = []
    for _ in range(n):
        base = [f"w{rnd.randrange(4000)}" for _ in range(rnd.randrange(22, 60))]
        texts.append(" ".join(base))
        for _ in range(rnd.randrange(3)):
            own = list(base)
            for _ in range(rnd.randrange(1, 5)):
                at = rnd.randrange(len(own))
                kind = rnd.random()
                if kind < 0.4:
                    own[at] = f"w{rnd.randrange(4000)}"
                elif kind < 0.7:
                    own.insert(at, "uusi")
                else:
                    own = own[at:] + own[:at]
            texts.append(" ".join(own))
    texts += texts[:4] + [texts[0].upper(), texts[1].replace(" ", " \n ")]
    return texts


def test_all_pairs_of_brute_force(spark, rnd):
    texts = corpus(rnd)
    rows = [*enumerate(texts), (9000, None), (9001, ""), (9002, "liian lyhyt"), (9003, " ".join(["sama"] * 40)), (9004, " ".join(["sama"] * 41))]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "id long, t string, fp int").repartition(3)
    members, links = N.near_duplicates(df, "id", "t")
    got = {tuple(r) for r in N.record_pairs(members, links).collect()}
    long = [(i, t) for i, t in rows if t and len(t.split()) >= 20]
    expected = {(a, b) for a, x in long for b, y in long if a < b and jaccard(x, y) >= 0.5}
    assert got == expected and (9003, 9004) in got
    # Groups are the connected components.
    parent = {i: i for i, _ in long}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in expected:
        parent[find(a)] = find(b)
    named = {r["id"]: r["group_id"] for r in N.groups(members, links).collect()}
    assert named.keys() == parent.keys()
    assert len({(find(i), named[i]) for i in parent}) == len({find(i) for i in parent}) == len(set(named.values()))


def test_empty(spark):
    df = spark.createDataFrame([], "id long, t string")
    members, links = N.near_duplicates(df, "id", "t")
    assert members.count() == 0 and links.count() == 0 and N.record_pairs(members, links).count() == 0 and N.groups(members, links).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distances(rnd):
    pairs = []
    for _ in range(120):
        a = [rnd.randrange(1, 5) for _ in range(rnd.randrange(1, 14))]
        b = list(a) if rnd.random() < 0.5 else [rnd.randrange(1, 5) for _ in range(rnd.randrange(1, 14))]
        if rnd.random() < 0.5:
            b.insert(rnd.randrange(len(b) + 1), 9)
        pairs.append((a, b))
    got = N.banded_distances([np.array(a, np.uint64) for a, _ in pairs], [np.array(b, np.uint64) for _, b in pairs], 0.5)
    for (a, b), d in zip(pairs, got, strict=True):
        true = distance(a, b)
        assert d == true if true <= 0.5 * max(len(a), len(b)) else d >= true or d > 0.5 * max(len(a), len(b))


def test_alignment_verifies(spark, rnd):
    base = [f"w{i}" for i in range(40)]
    near = base[:10] + ["uusi"] + base[10:]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(f"x{i}" for i in range(40)))], "id long, t string")
    links = N.near_duplicates(df, "id", "t", threshold=0.8, verify="alignment")[1].collect()
    assert len(links) == 1 and abs(links[0]["similarity"] - (1 - 1 / 41)) < 1e-9


def linked(spark, pairs):
    """How many of the pairs of texts are found."""
    df = spark.createDataFrame([(2 * i + j, t) for i, pair in enumerate(pairs) for j, t in enumerate(pair)], "id long, t string")
    got = {tuple(r) for r in N.record_pairs(*N.near_duplicates(df, "id", "t")).collect()}
    return sum((2 * i, 2 * i + 1) in got for i in range(len(pairs)))


def test_reversed_sentences_are_found(spark, rnd):
    pairs = []
    for i in range(12):
        own = [" ".join(f"w{i}x{rnd.randrange(10**6)}" for _ in range(12)) for _ in range(30)]
        pairs.append((" ".join(own), " ".join(reversed(own))))
    assert all(jaccard(*p) >= 0.5 for p in pairs) and linked(spark, pairs) == 12


def test_repeated_selves_are_found(spark, rnd):
    pairs = []
    for i in range(12):
        own = " ".join(f"w{i}x{rnd.randrange(10**6)}" for _ in range(60))
        pairs.append((own, " ".join([own] * (6 + i))))
    pairs.append((" ".join(["sama"] * 40), " ".join(["sama"] * 40 + ["uusi"])))  # one k-mer in both, two in either
    assert all(jaccard(*p) >= 0.5 for p in pairs) and linked(spark, pairs) == 13


def test_alignment_and_bounds(rnd):
    pairs = []
    for _ in range(200):
        a = [rnd.randrange(60) for _ in range(rnd.randrange(3, 60))]
        b = list(a)
        for _ in range(rnd.randrange(6)):
            b[rnd.randrange(len(b))] = rnd.randrange(60)
            b.insert(rnd.randrange(len(b) + 1), rnd.randrange(60))
        pairs.append((a, b))
    flat = lambda rows: (np.array([x for r in rows for x in r], np.uint64), np.append(0, np.cumsum([len(r) for r in rows])))
    (x, at_x), (y, at_y) = flat([a for a, _ in pairs]), flat([b for _, b in pairs])
    edits = N.aligned(x, at_x, y, at_y, 0.4)
    sets = [N.distinct(*N.runs(v, at, 3)) for v, at in ((x, at_x), (y, at_y))]
    both = N.common_values(*sets[0], *sets[1])
    bits = [N.bit_sets(*s) for s in sets]
    for i, (a, b) in enumerate(pairs):
        true, most = distance(a, b), int(0.4 * max(len(a), len(b)))
        assert edits[i] == (true if true <= most else -1)
        ka, kb = ({tuple(w[j : j + 3]) for j in range(len(w) - 2)} for w in (a, b))
        assert both[i] == len(ka & kb)
        if edits[i] >= 0:
            assert N.similarity_at_least(len(ka), len(kb), 3 * edits[i]) <= both[i] / max(1, len(ka | kb)) + 1e-12
        common = sum(bin(int(p & q)).count("1") for p, q in zip(bits[0][i], bits[1][i], strict=True))
        spare = [n - sum(bin(int(p)).count("1") for p in own[i]) for n, own in zip((len(ka), len(kb)), bits, strict=True)]
        assert both[i] <= common + min(spare)
    assert (N.aligned(x, at_x, y, at_y, 0.4) == edits).all() and (edits >= 0).any() and (edits < 0).any()


def test_long_pairs_are_left_to_the_exact_check(spark, monkeypatch, rnd):
    monkeypatch.setattr(N, "CELLS", 100)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(base[:100] + ["uusi"] + base[100:]))], "id long, t string")
    link = N.near_duplicates(df, "id", "t")[1].collect()
    assert len(link) == 1 and link[0]["similarity"] > 0.9


def test_groups_that_do_not_settle(spark):
    chain = spark.createDataFrame([(i, i, i + 1, i + 1) for i in range(40)], "fp_a long, fp2_a long, fp_b long, fp2_b long")
    members = spark.createDataFrame([(i, i, i) for i in range(42)], "id long, fp long, fp2 long")
    named = {r["id"]: r["group_id"] for r in N.groups(members, chain).collect()}
    assert len({named[i] for i in range(41)}) == 1 and named[41] != named[0]
    with pytest.raises(RuntimeError):
        N.groups(members, chain, rounds=1)
