import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from skuforge.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def base(text):
    digits = lambda x: re.sub("[^0-9]", "", x)
    tests = [
        ("email", EMAIL, lambda x: True),
        ("ip", IP, lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", CARD, lambda x: 14 <= len(digits(x)) <= 19 and luhn(digits(x))),
        ("phone", PHONE, lambda x: 10 <= len(digits(x)) <= 15),
    ]
    found = sorted((m.start(), r, m.end(), k) for r, (k, p, ok) in enumerate(tests) for m in p.finditer(text or "") if ok(m[0]))
    return [(k, a, b) for a, _, b, k in found]


def text_of(draw):
    card = "4111 1111 1111 1111"
    parts = ["a@b.co", "x.y%z@mail-1.example.org", "a@b.com%q@y.z", "10.0.0.255", "1.2.3.4.5.6.7.8", "300.1.1.1", "0000255.1.1.01", card, card.replace(" ", "-"), "4111111111111112", "1234567890123456789012", "+1 (555) 010-9999", "+49.30.1234567", "+1 2", "+12345678901234567", "é", "漢字", "😀", " ", "\n", "-", ".", "@", "+", "word", "7", "12"]
    return "".join(draw.choice(parts) + draw.choice(["", " ", ", "]) for _ in range(draw.randint(0, 25)))


def test_base_spans_against_plain_patterns(spark):
    draw = random.Random(5)
    texts = [text_of(draw) for _ in range(400)] + [None, "", "1 2 3 4 5 6 7 8 9 0 " * 5000, "a" * 50_000, "x@y.z " * 3000, "+" + "1 " * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = base(text)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), (text or "")[:300]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in want) for k in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(filter(None, r.spans.split(",")))


def test_disclosing_terms(spark):
    rows = [(i, f"the lab of Zorblatt{"abc"[i]} writes to boss@x.org about the plan Quixote daily", "s") for i in range(3)]
    rows += [(10 + i, f"the plan of the day {i} and about daily work, lab writes", "s") for i in range(60)] + [(None, None, "s"), (99, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.report(docs, id_col="doc_id").collect()}
    text = rows[0][1]
    at = text.index("Quixote")
    assert f"term:{at}:{at + 7}" in got[0].spans.split(",")  # only in documents with the address, in three texts
    assert got[0].n_term == 1 and got[10].n_term == 0 and got[None].spans == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[0] == "the lab of Zorblatta writes to [EMAIL] about the plan [NAME] daily"
    assert clean[10] == rows[3][1] and clean[None] is None and clean[99] == ""
    assert pii.sanitise(docs).columns == docs.columns
    assert pii.report(docs.limit(0)).count() == 0


def test_entity_of_a_single_text_has_disclosing_terms(spark):
    rows = [(1, "write to Zorblatt at boss@x.org about the plan"), (2, "call Quixote on +1 555 010 9999 about the plan"), (3, "call Quixote on +1 555 010 9999 about the plan")]
    rows += [(10 + i, f"write to us and call about the plan, part {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[1] == "write to [NAME] at [EMAIL] about the plan"
    assert clean[2] == clean[3] == "call [NAME] on [PHONE] about the plan"  # two copies are one text
    assert clean[10] == rows[3][1]


def test_disclosing_terms_anywhere_in_the_document(spark):
    far = "about the plan and the work of the day " * 10
    rows = [(1, f"Dear Zorblatt, {far}write to boss@x.org, ZORBLATT! zorblatts aren't meant"), (2, f"Quixote {far}10.0.0.1"), (3, f"10.0.0.1 Quixote {far}"), (4, f"Quixote {far}10.0.0.1"), (4, f"Quixote {far}10.0.0.1"), (None, f"10.0.0.1 {far}Quixote")]
    rows += [(10 + i, f"Dear all, write {far}zorblatts aren't meant") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = [r.text for r in pii.sanitise(docs).orderBy("doc_id").collect()]
    assert clean[1] == f"Dear [NAME], {far}write to [EMAIL], [NAME]! zorblatts aren't meant"
    assert clean[0] == f"[IP] {far}[NAME]" and clean[2] == f"[NAME] {far}[IP]" and clean[3] == f"[IP] [NAME] {far}"
    assert clean[4] == clean[5] == clean[2]
    assert clean[6:] == [r[1] for r in rows[6:]]


def brute_terms(rows, threshold=0.8, support=2):
    """Term spans of each (id, text), all different, by counting over all rows."""
    words = lambda x: [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", x)]
    entities = lambda x: {(k, x[a:b].lower()) for k, a, b in base(x)}
    n, n_t, n_e, n_te, texts_e, texts = len(rows), Counter(), Counter(), Counter(), defaultdict(set), defaultdict(set)
    for key in rows:
        terms = {w for w, _, _ in words(key[1])}
        n_t.update(terms)
        for e in entities(key[1]):
            n_e[e] += 1
            texts_e[e].add(key[1])
            for t in terms:
                n_te[t, e] += 1
                texts[t, e].add(key[1])
    telling = {te for te, c in n_te.items() if n_e[te[1]] < n and len(texts[te]) >= min(support, len(texts_e[te[1]])) and math.log2(c * n / (n_t[te[0]] * n_e[te[1]])) / math.log2(n / n_e[te[1]]) >= threshold}
    out = {}
    for key in rows:
        own, held = base(key[1]), entities(key[1])
        clear = lambda a, b: not any(x < b and a < y for _, x, y in own)
        out[key] = {(a, b) for w, a, b in words(key[1]) if any((w, e) in telling for e in held) and clear(a, b)}
    return out


def test_terms_against_counting_over_a_corpus(spark):
    draw = random.Random(8)
    common, rare, who = ["plan", "Work", "the", "daily", "über"], [f"name{a}{b}".replace("name", "Zor") for a in "abcdef" for b in "xyz"], ["a@b.co", "c@d.org", "10.0.0.1", "+49 30 1234567"]
    texts = [" ".join(draw.choice(common) if draw.random() < 0.8 else draw.choice(rare + who) for _ in range(draw.randint(0, 30))) for _ in range(250)]
    texts += [f"Zorunique{i} éZorunique@x{i}.org zorUNIQUE{i} über" for i in range(3)] + ["Zorlone " * 3000 + "lone@x.org " + " ".join("Zor" + "".join(draw.choices("abc", k=6)) for _ in range(800))]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = brute_terms(rows)
    assert sum(map(len, want.values())) > 800
    for key in rows:
        assert {tuple(map(int, x.split(":")[1:])) for x in got[key[0]].split(",") if x.startswith("term")} == want[key], key[1][:200]


def test_text_of_very_many_hits(spark):
    docs = spark.createDataFrame([(1, "x@y.z " * 40_000), (2, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    assert got[1].n_email == 40_000 and got[1].spans.endswith("email:239994:239999")
