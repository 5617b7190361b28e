import hashlib
import random
import re

from skuforge.llm import decontaminate
from skuforge.llm.decontaminate import SuffixAutomaton

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(text, items, window):
    w, hit, which = WORD.findall(lower(text)), set(), set()
    for item, t in items:
        x = WORD.findall(lower(t))
        n = min(window, len(x))
        wins = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                which.add(str(item))
    return len(w), len(hit), sorted(which)


def test_automaton_accepts_exactly_the_subsequences():
    draw = random.Random(7)
    for _ in range(60):
        items = [(k, [draw.randint(0, 2) for _ in range(draw.randint(0, 12))]) for k in range(4)]
        a = SuffixAutomaton(items, 4)
        subs = {tuple(w[i:j]) for _, w in items for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
        text = [draw.randint(0, 3) for _ in range(40)]
        state = length = 0
        for i, x in enumerate(text):
            state, length = a.step(state, length, x, 1000)
            want = max((n for n in range(i + 2) if n == 0 or tuple(text[i + 1 - n : i + 1]) in subs), default=0)
            assert length == want


def make(draw, n):
    return " ".join(draw.choice(["The", "a", "b", "é", "Zz", "9", "x-y"]) + draw.choice(["", ".", ","]) for _ in range(n))


def test_against_brute_force(spark):
    draw = random.Random(8)
    items = [(k, make(draw, draw.randint(0, 9))) for k in range(12)] + [(k, make(draw, draw.randint(3, 7))) for k in range(20, 30)] + [(40, None), (None, "a b c"), (41, "  ..")]
    good = [(i, t) for i, t in items if i is not None and t is not None]
    texts = [make(draw, draw.randint(0, 60)) for _ in range(150)] + [None, "", "a " * 5000]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, hit string").repartition(3)
    for options in ({}, {"block_words": 20}):
        got = {r.doc_id: r for r in decontaminate.report(docs, bench, window=5, **options).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            n, hit, which = brute(t, good, 5)
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(which), hit > 0)
            assert r.items_sha256 == hashlib.sha256(",".join(which).encode()).hexdigest()


def test_cleaning_removes_spans_and_covered_documents(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"Before, {item.upper()}! " + "after it comes much more text that stays here, word by word by word", "a"), (2, item, "b"), (3, "clean", "c"), (4, None, "d")], "doc_id long, text string, hit string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate.clean(docs, bench).collect()}
    assert set(out) == {1, 3, 4} and out[1].text == "Before, ! after it comes much more text that stays here, word by word by word" and out[3].text == "clean" and out[4].text is None
    assert decontaminate.clean(docs, bench).columns == docs.columns
    assert decontaminate.report(docs.limit(0), bench).count() == 0
    assert decontaminate.report(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_look_alikes_of_a_polynomial_hash_are_no_hits(spark):
    a = "".join("ab"[i.bit_count() & 1] for i in range(1 << 10))
    b = a.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"x {a} y"), (2, f"x {b} y"), (3, f"{a}{b}")], "doc_id long, text string")
    got = {r.doc_id: r.n_hit for r in decontaminate.report(docs, spark.createDataFrame([(7, a)], "item_id long, text string")).collect()}
    assert got == {1: 1, 2: 0, 3: 0}


def test_a_word_with_the_hash_of_an_items_word_is_no_hit(monkeypatch, spark):
    from skuforge.llm import common

    docs = [(1, "p q r"), (2, "p x r"), (3, "p q r p q r s")]
    items = [("i", decontaminate.words_of(b"p q r"))]
    real = common.span_hashes
    monkeypatch.setattr(common, "span_hashes", lambda d, s, e: real(d, s, e) % 2)  # nearly all words collide
    m = decontaminate.Matcher(items, 10)
    for i, text in docs:
        data = decontaminate.np.frombuffer(text.encode(), decontaminate.np.uint8)
        ends = decontaminate.np.array([0, len(data)])
        hashes, starts, stops = common.words(data, ends, common.ALNUM)
        got = [sum(b - a for a, b in s) for _, s, _ in m.match(data, hashes, starts, stops, common.per_text(starts, ends))]
        assert got == {1: [3], 2: [], 3: [6]}[i]
