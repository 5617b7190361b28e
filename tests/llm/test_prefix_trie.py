import hashlib
import math
import random
import zlib

from skuforge.llm import prefix_trie as trie_of
from skuforge.llm.prefix_trie import prefix_trie
from skuforge.llm.query import op13
from tests.oracle import connect, differ

SCHEMA = "conv_id long, turn long, role string, text string, digest string, `Pos` int"


def brute(rows):
    """rows: (conv, turn, role, text). Set of result rows, written from the definition."""
    by = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            by.setdefault(c, []).append(((t is not None, t or 0), hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), (r, x)))
    own = {c: [v[2] for v in sorted(vs)] for c, vs in by.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(members) if len(whole[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted((tuple(r)[:8] for r in prefix_trie(df, **more).collect()), key=repr)


def test_random_conversations_with_nulls_ties_repeats_and_absent_hosts(spark):
    draw = random.Random(1)
    rows = [(draw.choice([0, 1, 2, 3, 7, 101, 102, 205, 206, 300, 301]), draw.choice([None, 1, 2, 3, 4, 5, 6]), draw.choice(["user", "bot", None, ""]), draw.choice(["a", "b", "", None, "é\U0001f600"])) for _ in range(70)]
    rows += rows[:3] + [(None, 1, "user", "a"), (-105, 1, "user", "a"), (-5, 2, "bot", "b")]
    assert got(spark, rows) == brute(rows)


def test_long_conversations_over_several_levels_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie_of, "BLOCK", 4)
    monkeypatch.setattr(trie_of, "PIECE", 8)
    rows = [(c, t, "user", f"{t}" if t < cut else f"{c % 2}{t}") for c, n, cut in ((0, 40, 99), (1, 90, 99), (2, 90, 70), (3, 33, 99), (4, 16, 9), (5, 4, 9), (6, 3, 9), (107, 80, 44), (7, 90, 99), (8, 90, 70)) for t in range(n)]
    assert got(spark, rows) == brute(rows)


def test_copies_turnless_conversations_and_an_empty_table(spark):
    rows = [(c, t, "user", "same") for c in range(60) for t in range(3)] + [(c, 1, "u", "x") for c in range(1000, 1020)] + [(2001, 1, "u", "y"), (2002, 1, "u", "y")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []
    one = got(spark, [(7, None, None, None)])
    assert one == brute([(7, None, None, None)])


def test_one_conversation_of_many_equal_rows_is_numbered_by_many_tasks(spark):
    rows = [(5, None, "u", "t")] * 3000 + [(5, 1, "u", "z")]
    out = got(spark, rows)
    h = zlib.crc32(b"5") % 6
    assert len(out) == 3002 - h and max(r[1] for r in out) == 3001 - h and {r[5] for r in out} == {1}


def test_against_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert differ(spark, connect(sf), sf, op13.run, op13.SQL) is None
