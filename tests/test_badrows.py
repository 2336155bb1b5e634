import csv
import io
import random

import pytest

from tavuflow.operators.badrows import load_rows

LABELS = [("fi", "O"), ("fi", "B-PER")]
SCHEMA = "row_id long, lang string, delim string, line string, tag string"


def run(spark, lines):
    rows = spark.createDataFrame([(i, lang, delim, line, "clash") for i, (lang, delim, line) in enumerate(lines)], SCHEMA)
    loaded, failed = load_rows(rows, spark.createDataFrame(LABELS, "lang string, tag string"))
    return {r["row_id"]: (r["sent_id"], r["pos"], r["word"], r["tag"]) for r in loaded.collect()}, {r["row_id"]: r["reason"] for r in failed.collect()}


CASES = [
    (("fi", "comma", "1,2,sana,O"), (1, 2, "sana", "O")),
    (("fi", "tab", "1\t2\tsa,na\tO"), (1, 2, "sa,na", "O")),
    (("fi", "comma", '1,2,"sa,""na\\""",O'), (1, 2, 'sa,"na\\"', "O")),
    (("fi", "comma", '"1","2","""",O'), (1, 2, '"', "O")),
    (("fi", "comma", "0001,2,\\d\\b,O"), (1, 2, "\\d\\b", "O")),
    (("fi", "comma", '1,2,"sana,O'), "quoting"),
    (("fi", "comma", '1,2,sa"na,O'), "quoting"),
    (("fi", "comma", '1,2,"sana"x,O'), "quoting"),
    (("fi", "comma", '1,2,"a" ,O,x"'), "quoting"),
    (("fi", "comma", "1,2,sana"), "columns"),
    (("fi", "tab", "1,2,sana,O"), "columns"),
    (("fi", "comma", "1,2,sana,O,"), "columns"),
    (("fi", None, "1,2,sana,O"), "columns"),
    (("fi", "comma", None), "columns"),
    (("fi", "comma", "1,2,,O"), "value"),
    (("fi", "comma", "-1,2,sana,O"), "value"),
    (("fi", "comma", "1,２,sana,O"), "value"),
    (("fi", "comma", "1\n,2,sana,O"), "value"),
    (("fi", "comma", "1,2,sa�na,O"), "value"),
    (("fi", "comma", "1,2,sana,B-LOC"), "value"),
    (("tr", "comma", "1,2,sana,O"), "value"),
    ((None, "comma", "1,2,sana,O"), "value"),
    (("fi", "comma", "9" * 30 + ",2,sana,O"), "value"),
    (("fi", "comma", ""), None),
    (("fi", "comma", "# text, more"), None),
    (("fi", "comma", "<BODY>"), None),
]


def test_cases(spark):
    loaded, failed = run(spark, [c for c, _ in CASES])
    for i, (_, expected) in enumerate(CASES):
        assert (loaded.get(i) or failed.get(i)) == expected, CASES[i]
        assert not (i in loaded and i in failed)


def test_round_trip_of_any_fields(spark):
    rnd = random.Random(3)
    rows = []
    for _ in range(400):
        word = "".join(rnd.choice('ab,"\t\\ x') for _ in range(rnd.randrange(1, 9)))
        delim = rnd.choice(["comma", "tab"])
        out = io.StringIO()
        csv.writer(out, delimiter="," if delim == "comma" else "\t", lineterminator="", quoting=rnd.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])).writerow([7, 3, word, "O"])
        rows.append((word, ("fi", delim, out.getvalue())))
    loaded, failed = run(spark, [r for _, r in rows])
    assert not failed and all(loaded[i] == (7, 3, word, "O") for i, (word, _) in enumerate(rows))


def test_long_lines_and_repeats(spark):
    long = "1,2," + '"' + '""' * 200_000 + '"' + ",O"
    loaded, failed = run(spark, [("fi", "comma", long), ("fi", "comma", "1,2,a,O"), ("fi", "comma", "1,2,a,O"), ("fi", "comma", '1,2,"' + "a" * 300_000)])
    assert len(loaded[0][2]) == 200_000 and loaded[1] == loaded[2] and failed == {3: "quoting"}


def test_empty(spark):
    rows = spark.createDataFrame([], SCHEMA)
    loaded, failed = load_rows(rows, spark.createDataFrame([], "lang string, tag string"))
    assert loaded.count() == 0 and failed.count() == 0


@pytest.mark.parametrize("clash", ["_fields", "reason", "detail"])
def test_clashing_names(spark, clash):
    rows = spark.createDataFrame([(1, "fi", "comma", "1,2,a,X", 5)], f"row_id long, lang string, delim string, line string, {clash} int")
    assert load_rows(rows, spark.createDataFrame(LABELS, "lang string, tag string"))[1].first()["reason"] == "value"
