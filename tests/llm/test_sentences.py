import time

import pytest

from tavuflow.llm import sentences

CASES = [
    ("Talo on uusi. Kylä on vanha!", ["Talo on uusi.", "Kylä on vanha!"]),
    ("Pinta-ala on 3.14 km. N. K. Salo ja prof. Mäki tuli 12.5.2020. Niin.", ["Pinta-ala on 3.14 km.", "N. K. Salo ja prof. Mäki tuli 12.5.2020.", "Niin."]),
    ("Bkz. Prof. Dr. Ada ve Doç. Su, s. 48. 13. Yüzyılda kuruldu.", ["Bkz. Prof. Dr. Ada ve Doç. Su, s. 48.", "13. Yüzyılda kuruldu."]),
    ("Ide tartozik a ház, a tó stb. II. Pál a 12. Kisház körzetbe ment.", ["Ide tartozik a ház, a tó stb.", "II. Pál a 12. Kisház körzetbe ment."]),
    ("“Ev güzel!” dedi Ali. “Yol uzun.” Sonra gitti.", ["“Ev güzel!” dedi Ali.", "“Yol uzun.”", "Sonra gitti."]),
    ("Ali totesi: ”Talo on uusi.” Kuitenkin (Näin on.) Loppu... mutta ei.", ["Ali totesi: ”Talo on uusi.”", "Kuitenkin (Näin on.)", "Loppu... mutta ei."]),
    ("Mji ulikua.Watu walikuja!Wapi?Hapa.", ["Mji ulikua.", "Watu walikuja!", "Wapi?", "Hapa."]),
    ("See www.example.com or e.g. St. Ives. Done", ["See www.example.com or e.g. St. Ives.", "Done"]),
    ("湖は古い。「本が見つかった。」と述べた。なぜ？", ["湖は古い。", "「本が見つかった。」と述べた。", "なぜ？"]),
    ("他说：“河流已经发现。”山脉仍在。", ["他说：“河流已经发现。”", "山脉仍在。"]),
    ("डॉ. वरक ने कहा, “नगर मिला था।” क्षेत्र 80.38 है।", ["डॉ. वरक ने कहा, “नगर मिला था।”", "क्षेत्र 80.38 है।"]),
    ("ป่าใหม่ใช้ที่โรโม หนังสือเล็ก  ในปี1981 สถานี", ["ป่าใหม่ใช้ที่โรโม", "หนังสือเล็ก", "ในปี1981", "สถานี"]),
    ("Title: Talo\r\nLauta on.\r\n\r\nHistoria\n* yksi\n* kaksi", ["Title: Talo", "Lauta on.", "Historia", "* yksi", "* kaksi"]),
    ("Tämä on pitkä lause joka jatkuu aina vain eteenpäin ja\nloppuu vasta tänne. Toinen pitkä lause alkaa täältä Mäkelän\nKylässä ja loppuu tänne seuraavan rivin keskelle kuten\nmuutkin.", ["Tämä on pitkä lause joka jatkuu aina vain eteenpäin ja\nloppuu vasta tänne.", "Toinen pitkä lause alkaa täältä Mäkelän\nKylässä ja loppuu tänne seuraavan rivin keskelle kuten\nmuutkin."]),
    ("| a | 12.5 | x. Y |\n|-\n |b. C! D || 湖。湖\nTalo. Kylä.", ["| a | 12.5 | x. Y |", "|-", "|b. C! D || 湖。湖", "Talo.", "Kylä."]),
    ("Talo...!”Kylä on.\"(Niin?)\" Ja ”on.”. Loppu", ["Talo...!”", "Kylä on.\"", "(Niin?)\"", "Ja ”on.”.", "Loppu"]),
    (None, []),
    ("", []),
    (" \n\t　", []),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_units(spark, text, expected):
    df = spark.createDataFrame([(1, text, "kept")], "id long, t string, raw string")
    rows = sentences.units(df.select("id", "t"), "id", "t").orderBy("start_at").collect()
    assert [r["unit"] for r in rows] == expected
    assert all(text[r["start_at"] : r["end_at"]] == r["unit"] for r in rows)


def test_long_repeated_empty(spark):
    long = "Talo on uusi. " * 20_000
    df = spark.createDataFrame([(1, long), (2, "A b."), (2, "A b."), (3, "x y.")], "id long, t string")
    got = sentences.units(df, "id", "t", with_text=False).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == {1: 20_000, 2: 2, 3: 1}
    units = sentences.units(df.filter("id = 1"), "id", "t").orderBy("start_at").collect()
    assert [(r["start_at"], r["end_at"], r["unit"]) for r in units] == [(i * 14, i * 14 + 13, "Talo on uusi.") for i in range(20_000)]
    assert sentences.units(df.limit(0), "id", "t").count() == 0


DIGITS = " ".join(["7" * 400] * 3)


@pytest.mark.parametrize(
    "line",
    [
        f"{DIGITS} x x\nabc def",
        " ".join(["0123456789abcdef" * 16] * 3) + " x x\nabc def",
        "7a " * 33_000 + "x\nabc def",
        "sana " * 20_000 + "\nabc def",
        "sana sana sana sana sana sana sana sana" + " " * 100_000 + "x\nabc def",
        "a" + "." * 100_000 + "x",
        "a." + "\"" * 100_000 + "x",
        "湖" + "。" * 100_000 + "」" * 100_000 + "と",
        "a." + " " * 100_000 + "x",
        "|" + ". |" * 30_000,
    ],
    ids=["digits", "hex", "digit words", "words", "blanks", "stops", "quotes", "full stops", "spaces", "cells"],
)
def test_a_long_line_costs_no_more_than_its_length(spark, line):
    df = spark.createDataFrame([(i, line) for i in range(4)], "id long, t string").repartition(1)
    sentences.units(df, "id", "t", with_text=False).count()  # code is compiled
    began = time.perf_counter()
    assert sentences.units(df, "id", "t", with_text=False).count() >= 4
    assert time.perf_counter() - began < 3  # four lines and the cost of a Spark job
