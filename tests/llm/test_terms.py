from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tavuflow.llm import terms


def brute(records, rare=2, common=0.1):
    n, seen, size = Counter(), Counter(), Counter()
    for scope, own in records:
        if own is None:
            continue
        size[scope] += 1
        n.update((scope, t) for t in own if t is not None)
        seen.update({(scope, t) for t in own if t is not None})
    return {k: (n[k], seen[k], "rare" if seen[k] <= rare else "common" if seen[k] >= common * size[k[0]] else None) for k in n}


def check(spark, records):
    df = spark.createDataFrame(records, "scope string, terms array<string>").repartition(3)
    got = {(r["scope"], r["term"]): (r["n"], r["records"], r["mark"]) for r in terms.term_frequencies(df).collect()}
    assert got == brute(records)


def test_counts(spark, rnd):
    check(spark, [(rnd.choice("xy"), [f"t{int(rnd.expovariate(0.1))}" for _ in range(rnd.randrange(30))]) for _ in range(300)] + [("x", None), ("x", []), ("y", ["a", None, "a", ""])])
    check(spark, [])


def test_oversized_partitions_are_split(spark, rnd):
    records = [("x", [f"t{rnd.randrange(400)}" for _ in range(20)]) for _ in range(60)] + [("y", None)]
    df = spark.createDataFrame(records, "scope string, terms array<string>").repartition(3)
    got = {(r["scope"], r["term"]): (r["n"], r["records"], r["mark"]) for r in terms.term_frequencies(df, leaf_bytes=300).collect()}
    assert got == brute(records)


@pytest.mark.parametrize("uri", ["mock:///spill", "{}"])
def test_spilling_on_any_file_system(tmp_path, rnd, uri):
    rows = [{"h": rnd.randrange(1 << 31) if i % 3 else 77, "scope": "x", "term": None, "n": i, "records": 1} for i in range(3000)]
    for r in rows:
        r["term"] = f"t{r['h']}"  # a third of the rows are one term
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 50], terms._ARROW) for i in range(0, 3000, 50)]
    got = [r for b in terms.totals(iter(batches), 0, uri.format(tmp_path), 4000) for r in b.to_pylist()]
    expected = Counter()
    for r in rows:
        expected[r["term"]] += r["n"]
    assert {r["term"]: r["n"] for r in got} == expected and len(got) == len(expected) and not any(tmp_path.iterdir())


def test_partial_counts_are_flushed(spark, rnd):
    # One worker-side flush for each few terms: the constants travel with the module, so a copy of the stage is run here.
    batch = pa.RecordBatch.from_pylist([{"scope": "x", "terms": ["a", "b", "a"]}, {"scope": "x", "terms": ["b"]}], pa.schema([("scope", pa.string()), ("terms", pa.list_(pa.string()))]))
    old, terms.FLUSH_TERMS = terms.FLUSH_TERMS, 0
    try:
        rows = [r for b in terms._partial(iter([batch, batch])) for r in b.to_pylist()]
    finally:
        terms.FLUSH_TERMS = old
    total = Counter()
    for r in rows:
        total[r["term"]] += r["n"]
    assert total == {"a": 4, "b": 4, None: 0} and len(rows) == 5 and rows[-1]["records"] == 4


def test_split_and_first_rows(spark):
    df = spark.createDataFrame([(1, "a b\x1cc　d ", 2), (1, "x", 1), (2, None, 0), (None, "y", 0)], "k long, t string, at int")
    assert [r[0] for r in df.filter("at = 2").select(terms.split_terms(F.col("t"))).collect()] == [["a", "b\x1cc", "d"]]
    assert sorted((r["k"] or 0, r["t"]) for r in terms.first_rows(df, "k", [F.col("at")], "t").collect()) == [(0, "y"), (1, "x")]
