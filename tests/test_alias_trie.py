import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skuforge.operators import alias_trie
from skuforge.operators.alias_trie import NONE, Trie, longest_alias


def brute(text, aliases):
    best = None
    for alias, brand in aliases:
        run = alias.split()
        if run and any(text[i : i + len(run)] == run for i in range(len(text) - len(run) + 1)):
            best = min(best or (1, "", ""), (-len(alias), alias, brand))
    return best and (best[1], best[2])


def split(c):
    return F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"\s+"), lambda x: x != "")


@pytest.mark.parametrize("part_tokens", (1000, 20))
def test_random_texts_against_brute_force(spark, monkeypatch, part_tokens):
    monkeypatch.setattr(alias_trie, "PIECE", 16)
    draw = random.Random(part_tokens)
    word = lambda: draw.choice(("a", "b", "ab", "ba", "c#", "ö"))
    aliases = sorted({(" ".join(word() for _ in range(draw.randint(1, 6))), draw.choice(("X", "Y"))) for _ in range(40)}) + [("", "Z"), ("none here", "X"), ("a", "Z")]
    rows = [(i, " ".join(word() for _ in range(draw.choice((0, 1, 5, 200))))) for i in range(120)] + [(500, None), (None, "a b"), (7, "b")]
    got = longest_alias(spark.createDataFrame(rows, "id long, text string"), "id", split("text"), spark.createDataFrame(aliases, "alias string, brand string"), split("alias"), part_tokens=part_tokens)
    want = {}
    for i, t in rows:
        found = brute((t or "").split(), aliases)
        if found:
            want[i] = min(want.get(i, (1, "", "")), (-len(found[0]), *found))
    assert {r.id: (r.alias, r.brand) for r in got.collect()} == {i: w[1:] for i, w in want.items()}


def test_no_aliases_and_no_rows(spark):
    rows, none = spark.createDataFrame([(1, "a")], "id long, text string"), spark.createDataFrame([], "alias string, brand string")
    assert longest_alias(rows, "id", split("text"), none, split("alias")).count() == 0
    assert longest_alias(rows.limit(0), "id", split("text"), spark.createDataFrame([("a", "b")], "alias string, brand string"), split("alias")).count() == 0


def test_a_million_aliases():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 4, 1_000_000)
    flat = rng.integers(-(2**62), 2**62, 400_000)[rng.integers(0, 400_000, sizes.sum())]
    ends = np.cumsum(sizes)
    aliases = np.split(flat, ends[:-1])
    began = time.time()
    trie = Trie.of(aliases, np.arange(1, 1_000_001))
    assert time.time() - began < 60 and sum(getattr(trie, n).nbytes for n in Trie.NAMES) < 120e6
    texts = [np.concatenate([rng.integers(0, 9, 50), aliases[i], rng.integers(0, 9, 50)]) for i in range(0, 1_000_000, 500)]
    found = trie.search(np.concatenate(texts), np.append(0, np.cumsum([len(t) for t in texts])))
    assert all(f <= i + 1 for f, i in zip(found.tolist(), range(0, 1_000_000, 500), strict=True))


def test_a_text_of_one_repeated_token_is_read_in_linear_time():
    one = np.full(200_000, 7)
    trie = Trie.of([np.full(300, 7), np.append(np.full(299, 7), 8)], np.array([1, 2]))
    began = time.time()
    assert trie.search(one, np.array([0, len(one)])).tolist() == [1]
    assert trie.search(np.full(299, 7), np.array([0, 299])).tolist() == [NONE]
    assert time.time() - began < 20
