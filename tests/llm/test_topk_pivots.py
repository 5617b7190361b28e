import math
import random

import numpy as np
from pyspark.sql import functions as F

from skuforge.llm.topk_pivots import best_of_block, exact_topk


def brute(rows, k):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in good:
        if q % 20 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q)[:k]
            out |= {(q, r + 1, i, -x) for r, (x, i) in enumerate(s)}
    return out


def test_against_brute_force_with_ties_and_bad_vectors(spark):
    draw = random.Random(3)
    rows = [(i, [draw.choice([-0.5, 0.0, 0.25, 0.3]) for _ in range(4)]) for i in range(140)]
    rows += [(200, None), (220, [1.0, None, 0.0, 0.0]), (240, [float("nan"), 0.0, 0.0, 0.0]), (260, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.1] * 4)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, is_query string")
    for sizes in ({}, {"block_rows": 30, "block_queries": 3}):
        got = {tuple(r) for r in exact_topk(df, F.col("vec_id") % 20 == 0, k=7, **sizes).collect()}
        want = brute([(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 7)
        assert got == want
    assert exact_topk(df.limit(0), F.lit(True)).count() == 0


def test_bounds_spare_evaluations_and_large_numbers_stay_exact():
    rng = np.random.default_rng(0)
    near = rng.integers(-5, 5, (3000, 8)) + 60 * (rng.integers(0, 2, (3000, 1)) * 2 - 1)
    found, evaluated = best_of_block(np.arange(3000), near, np.arange(3), near[:3], 20, 16, step=64)
    assert evaluated < 3 * 3000 and len(found) == 60
    big = rng.integers(-(2**28), 2**28, (50, 4))
    found, _ = best_of_block(np.arange(50), big, np.arange(2), big[:2], 3, 4)
    for q in (0, 1):
        want = sorted((-sum(int(a) * int(b) for a, b in zip(big[q], big[i], strict=True)), i) for i in range(50) if i != q)[:3]
        assert [(s, i) for qq, i, s in found if qq == q] == [(-s, i) for s, i in want]


def test_clustered_vectors_are_eliminated_by_block_and_by_candidate_spread_ones_are_not(spark):
    from skuforge.llm import common

    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (6, 16))
    near = centres[rng.integers(0, 6, 3000)] + rng.normal(0, 0.02, (3000, 16))
    spread = rng.normal(0, 0.25, (1200, 16))
    shares = []
    for x, few in ((near, True), (spread, False)):
        w = np.floor(64 * x).astype(np.int64)
        ids = np.arange(len(w))
        asks = ids % 20 == 0
        found, evaluated = best_of_block(ids, w, ids[asks], w[asks], 20, 16)
        shares.append(evaluated / (len(w) * asks.sum()))
        rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        work = common.Workspace(spark, "topk-test")
        got = {tuple(r) for r in exact_topk(df, F.col("vec_id") % 20 == 0, block_rows=500, block_queries=40, work=work).collect()}
        assert got == brute(rows, 20)
        pairs = spark.read.parquet(f"{work.path}/*-pairs").count()
        cells = spark.read.parquet(f"{work.path}/*-cells").collect()
        every = sum(c.n_blocks for c in cells) * sum(c.n_groups for c in cells)
        if few:
            assert pairs < 0.5 * every
    assert shares[0] < 0.5 < shares[1]


def test_vectors_of_several_lengths_and_one_very_common_vector(spark):
    draw = random.Random(9)
    rows = [(i, [draw.choice([-0.5, 0.1, 0.3]) for _ in range(2 + i % 3)]) for i in range(240)]
    rows += [(300 + i, [0.5, 0.5, 0.5]) for i in range(400)] + [(1000, []), (1020, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in exact_topk(df, F.col("vec_id") % 20 == 0, k=5, block_rows=50, block_queries=7).collect()}
    want = set()
    for n in (0, 2, 3, 4):
        want |= brute([(i, v) for i, v in rows if len(v) == n], 5)
    assert got == want
