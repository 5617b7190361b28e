import random

import pytest
from pyspark.sql import functions as F

from skuforge.functions import scalars as S
from skuforge.operators.fuzzy_join import resolve_aliases, similar_names, similar_texts


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def ratio(a, b):
    return round(100 * (1 - edits(a, b) / max(len(a), len(b))), 4)


def table(spark, texts):
    return spark.createDataFrame([(t, 1) for t in texts], "text string, other int")


@pytest.mark.parametrize("floor", (55, 70, 84, 100))
def test_pairs_against_brute_force(spark, floor):
    draw = random.Random(floor)
    make = lambda n: ["".join(draw.choice("abé\U0001f600 ") for _ in range(draw.randint(0, 12))) for _ in range(n)]
    left, right = [*make(120), None, "aaaaaaaaaa", "aaaaaaaaa"], [*make(120), None, "aaaaaaaaaa", "aaaaaaaaaa"]
    want = {(a, b, ratio(a, b)) for a in left for b in right if a and b and ratio(a, b) >= floor}
    assert {tuple(r) for r in similar_texts(table(spark, left), table(spark, right), floor).collect()} == want


def test_words_in_another_order_and_bad_floors(spark):
    got = {(r.a, r.b): r.score for r in similar_names(table(spark, ["bolt large", "plate"]), table(spark, ["large bolt", "plates"]), 80).collect()}
    assert got == {("bolt large", "large bolt"): 95.0, ("plate", "plates"): 83.3333}
    with pytest.raises(ValueError):
        similar_texts(table(spark, ["a"]), table(spark, ["a"]), 50)
    assert similar_names(table(spark, []), table(spark, ["a"]), 90).count() == 0


def test_resolution_with_floor_and_margin(spark):
    aliases = [("Warranty", "warranty"), ("warranties", "warranty"), ("diameter mm", "diameter"), ("diameter m", "depth"), ("length", "length"), ("Length", "long"), ("", "x"), (None, "y")]
    texts = ["WARRANTY", "warrantys", "diameter-mm", "diameter mn", "lenght", "zzz", "", None, "warrantys", "mm diameter"]
    got = {r.text: (r.key, r.score) for r in resolve_aliases(table(spark, texts), "text", spark.createDataFrame(aliases, "alias string, key string")).collect()}
    assert got["WARRANTY"] == ("warranty", 100.0) and got["warrantys"] == ("warranty", ratio("warrantys", "warranty"))
    assert got["diameter-mm"] == ("diameter", 100.0) and got["diameter mn"] == (None, None)  # as near to depth as to diameter
    assert got["lenght"] == (None, None) and got["zzz"] == (None, None) and got[""] == (None, None) and len(got) == 8
    assert got["mm diameter"] == ("diameter", 95.0)


def test_brute_force_of_resolution(spark):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abc") for _ in range(draw.randint(4, 9)))
    aliases = {word(): draw.choice("XYZ") for _ in range(60)}
    texts = {word() for _ in range(150)}
    got = {r.text: r for r in resolve_aliases(table(spark, texts), "text", spark.createDataFrame(list(aliases.items()), "alias string, key string")).collect()}
    for t in texts:
        top = sorted((-ratio(t, a), a) for a in aliases if ratio(t, a) >= 84)[:3]
        assert [(c.alias, -c.score) for c in got[t].closest] == [(a, s) for s, a in top]
        sure = top and (t in aliases or all(aliases[a] == aliases[top[0][1]] or s - top[0][0] >= 4 for s, a in top))
        assert got[t].key == (aliases[top[0][1]] if sure else None)


def test_options_snap(spark):
    rows = spark.createDataFrame([("Galvanised",), ("galvanized steel",), ("Stainles",), ("wood",), ("",), (None,)], "v string")
    options = ["Galvanized", "Stainless", "Brass"]
    got = {r.v: r.o for r in rows.select("v", S.to_enum(F.col("v"), options, snap=82.0).alias("o")).collect()}
    assert got["Galvanised"] == got["galvanized steel"] == "Galvanized" and got["Stainles"] == "Stainless" and got["wood"] is None and got[None] is None
    assert rows.select(S.to_enum(F.col("v"), options).alias("o")).first().o is None
