import random
import re

import numpy as np
import pytest

from skuforge.llm import common, ngram_join
from skuforge.llm.components import components


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def brute(rows, n, num, den):
    s = [(i, shingles(t, n)) for i, t in rows]
    parent = list(range(len(s)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            x, y = s[a][1], s[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(s):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(x), None if i is None else least[find(k)] if x else i) for k, (i, x) in enumerate(s)), key=str)


def corpus(seed, groups, copies, size, edits):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 4)))
    passage = [word() for _ in range(40)]
    out = []
    for _ in range(groups):
        base = [word() for _ in range(draw.randint(1, size))]
        if draw.random() < 0.3:
            base = base + passage
        for _ in range(draw.randint(1, copies)):
            w = list(base)
            for _ in range(draw.randint(0, edits)):
                w[draw.randrange(len(w))] = word()
            out.append(" ".join(x.upper() if draw.random() < 0.1 else x for x in w))
    draw.shuffle(out)
    return out


@pytest.mark.parametrize("few,group_sets", [(64, 256), (3, 6)])
def test_against_brute_force(spark, monkeypatch, few, group_sets):
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "GROUP_SETS", group_sets)
    texts = corpus(1, 40, 6, 120, 4) + corpus(2, 2, 60, 100, 3) + ["one two", "One  two", "a", "", None, " \t\n", "x " * 3000, "x " * 2000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3]), (5, "other text of a repeated id")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, key int").repartition(5)
    for n, num, den in ((3, 90, 100), (2, 80, 100)):
        got = sorted((tuple(r) for r in ngram_join.near_duplicates(df, n=n, num=num, den=den).collect()), key=str)
        assert got == brute(rows, n, num, den)


def test_nothing_to_link(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.near_duplicates(empty).count() == 0
    few = spark.createDataFrame([(1, "a b c d e f"), (2, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join.near_duplicates(few).collect()) == [(1, 2, 1), (2, 0, 2)]
    assert ngram_join.keep_one(few).columns == few.columns and ngram_join.keep_one(few).count() == 2


def test_components_of_random_graphs(spark):
    draw = random.Random(4)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(70)] + [(2000, 2001 + i) for i in range(50)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), common.Workspace(spark, "t")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in nodes}


def test_connect_skips_no_pair():
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 2**63, 60).astype(np.uint64))
    tokens = [np.unique(np.append(base[rng.random(len(base)) > 0.06], rng.integers(0, 2**63, rng.integers(0, 4)).astype(np.uint64))) for _ in range(80)]
    found = ngram_join.connect(np.arange(80), tokens, 80, 100)
    parent = list(range(80))

    def find(p, x):
        while p[x] != x:
            x = p[x]
        return x

    want = list(range(80))
    for a in range(80):
        for b in range(a):
            i = len(np.intersect1d(tokens[a], tokens[b]))
            if 100 * i >= 80 * (len(tokens[a]) + len(tokens[b]) - i):
                want[find(want, a)] = find(want, b)
    for a, b in found:
        parent[find(parent, a)] = find(parent, b)
    assert len({(find(want, x), find(parent, x)) for x in range(80)}) == len({find(want, x) for x in range(80)}) == len({find(parent, x) for x in range(80)})


def test_keep_one_decides_by_row(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue white black grey")
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (7, c, "x"), (7, c, "x"), (8, c, "x"), (9, "", "x"), (9, "", "x"), (None, a, "x"), (None, a, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(tuple, ngram_join.keep_one(docs).collect()), key=str)
    assert got == sorted([(1, a, "x"), (5, b, "x"), (7, c, "x"), (9, "", "x"), (9, "", "x"), (None, a, "x"), (None, a, "x")], key=str)
    assert sorted(r.doc_id for r in ngram_join.keep_one(docs.filter("doc_id < 7")).collect()) == [1, 5]


def test_pairs_are_verified_once_and_copies_are_not_expanded(spark):
    draw = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(120):  # near-copies: each has one word of its own
        w = list(base)
        w[draw.randrange(len(w))] = f"own{k}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    work = common.Workspace(spark, "ngram-test")
    got = ngram_join.near_duplicates(docs, n=3, num=90, den=100, work=work).collect()
    assert {r.component_id for r in got} == {0}
    pairs = [(r.ka, r.kb) for r in spark.read.parquet(f"{work.path}/*-pairs").collect()]
    assert len(pairs) == len({frozenset(p) for p in pairs}) and len(pairs) < 120 * 119 / 8


def test_one_prefix_ngram_in_very_many_unlike_sets(spark):
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(4))
    texts = ["the same three " + " ".join(word() for _ in range(draw.randint(3, 40))) for _ in range(10_000)]
    texts += [t + " more" for t in texts[:3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    work = common.Workspace(spark, "ngram-test")
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs, n=3, num=80, den=100, work=work).collect()}
    size = lambda t: len(shingles(t, 3))
    for i, t in enumerate(texts[:3]):
        linked = 100 * size(t) >= 80 * (size(t) + 1)
        assert got[10_000 + i] == (i if linked else 10_000 + i)
    assert sum(i != c for i, c in got.items()) <= 3
    assert spark.read.parquet(f"{work.path}/*-pairs").count() < 100_000


def test_look_alikes_of_a_polynomial_hash_are_not_linked(spark):
    a = "".join("ab"[i.bit_count() & 1] for i in range(1 << 10))
    docs = spark.createDataFrame([(1, f"{a} x y"), (2, f"{a.translate(str.maketrans('ab', 'ba'))} x y")], "doc_id long, text string")
    assert {tuple(r) for r in ngram_join.near_duplicates(docs, n=3, num=90, den=100).collect()} == {(1, 1, 1), (2, 1, 2)}


def test_what_the_first_round_connected_is_not_connected_again(spark, monkeypatch):
    seen, find = [], ngram_join.components

    def components(edges, work, what="components"):
        seen.append(work.save(edges, "asked"))
        return find(seen[-1], work, what)

    monkeypatch.setattr(ngram_join, "components", components)
    texts = corpus(3, 12, 30, 120, 4)
    got = ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), n=3, num=80, den=100)
    assert sorted(map(tuple, got.collect()), key=str) == brute(list(enumerate(texts)), 3, 80, 100)
    first, again = ({tuple(r) for r in e.collect()} for e in seen)
    assert first and not first & again


def test_a_written_step_lets_garbage_go(spark):
    beans = [b for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName()]
    before = sum(b.getCollectionCount() for b in beans)
    common.Workspace(spark, "t").save(spark.range(3), "t")
    assert sum(b.getCollectionCount() for b in beans) > before
