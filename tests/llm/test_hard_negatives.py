import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from skuforge.llm import hard_negatives as hn
from skuforge.llm.hard_negatives import hard_negatives
from skuforge.llm.query import op11
from tests.oracle import connect, differ

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, w int"


def brute(rows, positives=5, negatives=3):
    """rows: (id, vector, label) without repeated anchors."""
    good = [(i, [math.floor(256 * x) for x in v], (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, q, lab in good:
        if a % 50:
            continue
        s = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, other == lab) for i, v, other in good if i != a and len(v) == len(q))
        for p, i, _ in [x for x in s if x[2]][:positives]:
            window = [(n, j) for n, j, same in s if not same and 50 * -p <= 100 * -n <= 95 * -p]
            out += [(a, i, r + 1, j, -p, -n) for r, (n, j) in enumerate(window[:negatives])]
    return sorted(out)


def got(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in hard_negatives(df, F.col("vec_id") % 50 == 0, label=label, **more).collect())


def test_ties_bad_vectors_other_lengths_and_repeated_rows(spark):
    draw = random.Random(5)
    rows = [(i, [draw.choice([-0.5, 0.0, 0.25, 0.3, 0.5]) for _ in range(4)], draw.choice([0, 1, 2])) for i in range(400)]
    rows += [(450, None, 1), (500, [1.0, None, 0.0, 0.0], 1), (550, [float("nan")] * 4, 1), (600, [float("inf")] * 4, 1), (650, [0.1] * 4, None), (None, [0.1] * 4, 1)]
    rows += [(700, [0.5, 0.5], 1), (701, [0.5, 0.4], 1), (702, [0.4, 0.3], 2), (750, [], 1), (751, [], 1), (752, [], 2)] + rows[3:6]
    want = brute(rows)
    assert len(want) > 50
    for sizes in ({}, {"block_rows": 40, "group_rows": 3}):
        assert got(spark, rows, **sizes) == want
    assert got(spark, []) == []


def test_one_very_common_vector_and_clusters(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 0.5, (5, 8))
    x = centres[rng.integers(0, 5, 900)] + rng.normal(0, 0.02, (900, 8))
    rows = [(i, [float(c) for c in v], int(rng.integers(0, 4))) for i, v in enumerate(x)] + [(2000 + i, [0.25] * 8, i % 2) for i in range(500)]
    monkeypatch.setattr(hn.inverted_lists, "__defaults__", (60, 300))
    assert got(spark, rows, block_rows=150, group_rows=8) == brute(rows)


def test_lists_are_skipped_by_bound_and_by_window():
    rng = np.random.default_rng(3)
    centres = np.rint(rng.normal(0, 100, (20, 16)))
    cluster = np.repeat(np.arange(20), 50)
    w = (centres[cluster] + rng.integers(-2, 3, (1000, 16))).astype(np.int64)
    radius = [np.sqrt(((w[cluster == c] - centres[c]) ** 2).sum(1)).max() for c in range(20)]
    rows = pd.DataFrame({"id": np.arange(1000), "label": np.arange(1000) % 2, "cluster": cluster, "w": list(w)})
    lists = pd.DataFrame({"cluster": np.arange(20), "centre": list(centres), "radius": radius})
    lo, hi = 1000, 20_000
    asks = pd.DataFrame({"key": [7], "id": [0], "label": [0], "w": [w[0]], "windows": [[{"tag": 1, "lo": lo, "hi": hi, "least": hn.LOW}]]})
    found, taken = hn.visit(rows, asks, lists, 3, False)
    s = w @ w[0]
    want = sorted((-int(s[i]), i) for i in range(1000) if i % 2 and lo <= s[i] <= hi)[:3]
    assert [(-x[3], x[2]) for x in found] == want and taken < 500
    open_ = asks.assign(windows=[[{"tag": 0, "lo": hn.LOW, "hi": hn.HIGH, "least": hn.LOW}]])
    found, taken = hn.visit(rows, open_, lists, 3, True)
    assert [(-x[3], x[2]) for x in found] == sorted((-int(s[i]), i) for i in range(2, 1000, 2))[:3] and taken < 200


def test_large_numbers_stay_exact():
    rng = np.random.default_rng(1)
    w = rng.integers(-(2**28), 2**28, (40, 4))
    rows = pd.DataFrame({"id": np.arange(40), "label": 0, "cluster": 0, "w": list(w)})
    lists = pd.DataFrame({"cluster": [0], "centre": [np.zeros(4)], "radius": [float(np.sqrt((w.astype(float) ** 2).sum(1)).max())]})
    asks = pd.DataFrame({"key": [0], "id": [0], "label": [0], "w": [w[0]], "windows": [[{"tag": 0, "lo": hn.LOW, "hi": hn.HIGH, "least": hn.LOW}]]})
    found, _ = hn.visit(rows, asks, lists, 5, True)
    assert [(x[3], x[2]) for x in found] == [(-s, i) for s, i in sorted((-sum(int(a) * int(b) for a, b in zip(w[0], w[i], strict=True)), i) for i in range(1, 40))[:5]]


def test_against_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert differ(spark, connect(sf), sf, op11.run, op11.SQL) is None
