"""Exact top-k by inner product with pivot tables.

Vectors become integers floor(scale * x). With M the largest squared norm, x' = (x, sqrt(M - |x|^2)) and q' = (q, 0) turn the
inner product into a distance: d(q', x')^2 = |q|^2 + M - 2 q.x. Pivots are vectors of a bounded sample, each the farthest
from those before it. The distances of every x' and q' to the pivots are computed once and written: the pivot table. The
largest |d(q', p) - d(x', p)| over all pivots is a lower bound of d(q', x'), hence an upper bound of q.x.

* Rows and queries (a stated set) lie in blocks of bounded size, by their nearest pivot. Every group of queries meets first
  one block of its own cell, which gives each of its queries a k-th score to begin with.
* A block can hold a query group's result only if the bound from the blocks' ranges of pivot distances reaches the smallest
  of the group's k-th scores; other pairs of blocks never meet.
* Within a pair of blocks, bounds of all candidates are taken for many queries at once; candidates are evaluated in the order
  of their bounds, in rounds of growing size, until no bound reaches the query's k-th best score so far.

Equal scores go to the smaller id, so equal bounds are still evaluated. Scores are exact integers. A query's best k of each
block are merged by rank: a task keeps k of a query at most before the shuffle, and the rest is a sort that can spill.

Pivots eliminate what the data allow: clustered vectors need few evaluations; vectors spread evenly over many dimensions have
nearly equal distances to all pivots, so that almost every bound reaches the k-th score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuforge.llm import common

#: Components up to this give exact sums of products in float64 for up to 2^13 dimensions.
EXACT = 1 << 20
#: Added to bounds, times the magnitude, for rounding in float32; above LARGE, float64 is used.
SLACK, LARGE = 4e-6, 1e30
#: Queries of a block whose bounds are taken at once.
CHUNK = 64
#: Vectors that pivots are chosen from: the sample's expected size for vectors of one length.
SAMPLE = 1024


def scores_of(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of x with q; beyond 64 bits they stop at the largest or smallest long."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(q).max(initial=0)))
    if largest <= EXACT:
        return np.rint(x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return np.array([min(max(sum(a * b for a, b in zip(row, q.tolist(), strict=True)), -(2**63)), 2**63 - 1) for row in x.tolist()], np.int64)


def choose_pivots(x: np.ndarray, n_pivots: int) -> np.ndarray:
    """Rows of x, each the farthest from those before it; fewer where the rest are copies of them."""
    x = x.astype(np.float64)
    at, near = [0], np.full(len(x), np.inf)
    while len(at) < min(n_pivots, len(x)):
        near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(1))
        far = int(near.argmax())
        if near[far] <= 0:
            break
        at.append(far)
    return x[at]


def distances(x: np.ndarray, pivots: np.ndarray, top: float, as_query: bool) -> np.ndarray:
    """To each pivot (as a row), of rows of x taken as queries (0 for the added component) or as candidates."""
    x, own = x.astype(np.float64), (pivots * pivots).sum(1)
    norms = (x * x).sum(1)
    tail = np.zeros(len(x)) if as_query else np.sqrt(np.maximum(top - norms, 0))
    p_tail = np.sqrt(np.maximum(top - own, 0))
    return np.sqrt(np.maximum(norms[:, None] + own[None, :] - 2 * (x @ pivots.T), 0) + (tail[:, None] - p_tail[None, :]) ** 2)


class _Best:
    """The k best of each query so far."""

    def __init__(self, k: int, thresholds: np.ndarray):
        self.k, self.least = k, thresholds.copy()
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in thresholds]

    def add(self, j: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.append(self.found[j][0], scores), np.append(self.found[j][1], ids)
        if len(s) > 4 * self.k:  # whoever is below the k-th score goes before sorting
            keep = s >= np.partition(s, len(s) - self.k)[len(s) - self.k]
            s, i = s[keep], i[keep]
        order = np.lexsort((i, -s))[: self.k]
        self.found[j] = s[order], i[order]
        if len(order) == self.k:
            self.least[j] = max(self.least[j], float(s[order[-1]]))


def search_block(ids: np.ndarray, x: np.ndarray, to_x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, to_q: np.ndarray, top: float, thresholds: np.ndarray, k: int, step: int = 256) -> tuple[list[tuple[int, int, int]], int]:
    """((query, row, score) of the k best rows for each query that can reach its threshold, candidates evaluated).

    to_x and to_q: distances to the pivots, thresholds: scores that k other rows are known to reach (-inf where unknown)."""
    if not len(ids) or not len(query_ids):
        return [], 0
    xf, qf = x.astype(np.float64), q.astype(np.float64)
    exact = max(np.abs(xf).max(initial=0), np.abs(qf).max(initial=0)) <= EXACT
    small = np.float32 if top < LARGE else np.float64
    table, own = np.ascontiguousarray(to_x.T, small), to_q.astype(small)
    scale = (qf * qf).sum(1) + top
    slack = SLACK * (scale + 1) + 1e-6
    best, evaluated = _Best(k, thresholds), 0
    for lo in range(0, len(query_ids), CHUNK):
        part = np.arange(lo, min(lo + CHUNK, len(query_ids)))
        low = np.abs(table[0] - own[part, 0, None])
        for p in range(1, len(table)):
            np.maximum(low, np.abs(table[p] - own[part, p, None]), out=low)
        high = ((scale + 2 * slack)[part, None] - low.astype(np.float64) ** 2) / 2
        size = step
        while True:
            open_ = (high >= best.least[part, None]) & (high > -np.inf)
            left = open_.sum(1)
            if not left.any():
                break
            # the highest bounds of each query first
            size = min(size, len(ids))
            if size < len(ids):
                edge = -np.partition(-high, size - 1, axis=1)[:, size - 1]
                open_ &= high >= np.where(left > size, edge, -np.inf)[:, None]
            used = np.flatnonzero(open_.any(0))
            evaluated += int(open_.sum())
            if exact:
                together = np.rint(qf[part] @ xf[used].T).astype(np.int64)
            for r, j in enumerate(part.tolist()):
                mine = np.flatnonzero(open_[r, used])
                at = used[mine]
                s = together[r, mine] if exact else scores_of(x[at], q[j])
                keep = (ids[at] != query_ids[j]) & (s >= best.least[j])
                if keep.any():
                    best.add(j, s[keep], ids[at[keep]])
            high[open_] = -np.inf
            size *= 8
    found = [(query, i, s) for query, (ss, ii) in zip(query_ids.tolist(), best.found, strict=True) for i, s in zip(ii.tolist(), ss.tolist(), strict=True)]
    return found, evaluated


def best_of_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, n_pivots: int, step: int = 256) -> tuple[list[tuple[int, int, int]], int]:
    """search_block of one block with a pivot table of its own."""
    if not len(ids):
        return [], 0
    top = float((x.astype(np.float64) ** 2).sum(1).max())
    pivots = choose_pivots(x, n_pivots)
    return search_block(ids, x, distances(x, pivots, top, False), query_ids, q, distances(q, pivots, top, True), top, np.full(len(query_ids), -np.inf), k, step)


def _usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _matrix(column: pd.Series, kind=np.int64) -> np.ndarray:
    return np.array(column.tolist(), kind).reshape(len(column), -1)


TABLE = "id long, q boolean, dims int, w array<long>, to_row array<double>, to_query array<double>, cell int, top double"


def pivot_table(vectors: DataFrame, is_query: Column, work: common.Workspace, *, id_col: str, vector_col: str, scale: float, n_pivots: int, block_rows: int) -> DataFrame:
    """TABLE: each usable vector with its distances to the pivots, as a candidate and as a query, and its nearest pivot.

    Pivots belong to vectors of one length; a length with few vectors has few cells, so that blocks aren't needlessly small.
    """
    v = F.col("v")
    numbers = vectors.withColumn(q := common.free_name(vectors, "is_query"), is_query).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.coalesce(F.col(q), F.lit(False)).alias("q")
    )
    numbers = numbers.filter(F.col("id").isNotNull() & _usable(v))
    packed = numbers.select("id", "q", F.size("v").alias("dims"), F.transform("v", lambda x: F.floor(F.lit(scale) * x)).alias("w"))
    norm = F.aggregate(F.transform("w", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    lengths = work.save(packed.groupBy("dims").agg(F.count("*").alias("n"), F.max(norm).alias("top")), "lengths")
    shares = F.ceil(F.col("n") / block_rows).cast("int")
    # a bounded sample of each length, by a hash of the id
    of = F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.greatest(F.floor(F.col("n") / SAMPLE), F.lit(1))) == 0
    sample = packed.join(lengths, "dims").filter(of).groupBy("dims", "id").agg(F.min("w").alias("w"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        found = choose_pivots(_matrix(pdf["w"]), n_pivots)
        return pd.DataFrame({"dims": pdf["dims"].iloc[0], "pivot": list(found)})

    pivots = work.save(sample.groupBy("dims").applyInPandas(choose, "dims int, pivot array<double>"), "pivots")
    spread = packed.join(lengths, "dims").withColumn("share", F.pmod(F.xxhash64("id"), shares).cast("int")).select("id", "q", "dims", "w", "share", "top", shares.alias("shares"))
    each = pivots.join(lengths, "dims").select("dims", "pivot", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))

    def measure(pdf: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=["id", "q", "dims", "w", "to_row", "to_query", "cell", "top"])
        x, top = _matrix(pdf["w"]), float(pdf["top"].iloc[0])
        chosen = _matrix(chosen["pivot"], np.float64) if len(chosen) else np.zeros((1, x.shape[1]))
        to_row = distances(x, chosen, top, False)
        cell = to_row[:, : int(pdf["shares"].iloc[0])].argmin(1)
        return pd.DataFrame({"id": pdf["id"], "q": pdf["q"], "dims": pdf["dims"], "w": pdf["w"], "to_row": list(to_row), "to_query": list(distances(x, chosen, top, True)), "cell": cell, "top": top})

    return work.save(spread.groupBy("dims", "share").cogroup(each.groupBy("dims", "share")).applyInPandas(measure, TABLE), "pivot-table")


def exact_topk(
    vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: float = 64.0, n_pivots: int = 16, block_rows: int = 8_192, block_queries: int = 4_096, work: common.Workspace | None = None
) -> DataFrame:
    """The k rows of highest inner product for each query row, its own id excluded; ties go to the smaller id.

    Returns query_id, rank (from 1), vec_id, score. Vectors that are null, or hold a null or a component that isn't finite,
    take no part, nor do rows with a null id; an id given twice counts once for each of its rows. Vectors of another length
    than the query's aren't compared with it: each length is a search of its own. Extra columns aren't read.

    Cost: queries times rows at worst, in pairs of blocks of block_queries and block_rows that any executor can take, less the
    pairs and candidates that the pivot table rules out.
    """
    work = work or common.Workspace(vectors.sparkSession, "topk")
    table = pivot_table(vectors, is_query, work, id_col=id_col, vector_col=vector_col, scale=scale, n_pivots=n_pivots, block_rows=block_rows)
    cell = ["dims", "cell"]
    cells = work.save(table.groupBy(*cell).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("n_blocks"), F.greatest(F.ceil(F.count(F.when(F.col("q"), 1)) / block_queries), F.lit(1)).cast("int").alias("n_groups")), "cells")
    part = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    placed = table.join(cells, cell)
    rows = placed.select("id", "dims", "w", F.col("to_row").alias("to"), "top", F.col("cell").alias("row_cell"), part("n_blocks", 2).alias("block"))
    asked = placed.filter("q").select("id", "dims", "w", F.col("to_query").alias("to"), "top", "cell", part("n_groups", 3).alias("group"), "n_blocks")
    pair = ["dims", "cell", "group", "row_cell", "block"]

    def meet(rows: DataFrame, asked: DataFrame) -> DataFrame:
        def search(pdf: pd.DataFrame) -> pd.DataFrame:
            is_query = pdf["asks"].to_numpy(bool)
            ids, w, to, least = pdf["id"].to_numpy(np.int64), _matrix(pdf["w"]), _matrix(pdf["to"], np.float64), pdf["least"].to_numpy(np.float64)
            known = np.where(np.isnan(least), -np.inf, least)[is_query]
            found, _ = search_block(ids[~is_query], w[~is_query], to[~is_query], ids[is_query], w[is_query], to[is_query], float(pdf["top"].iloc[0]), known, k)
            return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64").assign(dims=pdf["dims"].iloc[0])

        columns = (*pair, "id", "w", "to", "top", "least", "asks")
        both = asked.withColumn("asks", F.lit(True)).select(*columns).unionByName(rows.withColumns({"asks": F.lit(False), "least": F.lit(None).cast("double")}).select(*columns))
        return both.groupBy(*pair).applyInPandas(search, "query_id long, vec_id long, score long, dims int")

    # each group of queries with one block of its own cell: the first thresholds
    home = asked.withColumn("row_cell", F.col("cell")).withColumn("block", F.pmod("group", "n_blocks")).drop("n_blocks")
    homes = home.select(*pair).distinct()
    first = work.save(meet(rows.join(homes, ["dims", "row_cell", "block"]), home.withColumn("least", F.lit(None).cast("double"))), "first")
    over = Window.partitionBy("dims", "query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.groupBy("dims", "query_id").agg(F.count("*").alias("c"), F.min("score").cast("double").alias("least")).filter(F.col("c") >= k)
    asked = work.save(asked.drop("n_blocks").join(kth.select("dims", F.col("query_id").alias("id"), "least"), ["dims", "id"], "left"), "asked")
    # which pairs of blocks can hold results: ranges of the distances to each pivot
    at = lambda to: [F.struct(*(f(F.get(to, F.lit(p))).alias(n) for n, f in (("lo", F.min), ("hi", F.max)))) for p in range(n_pivots)]
    square = F.aggregate(F.transform("w", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    blocks = rows.groupBy("dims", "row_cell", "block").agg(F.array(*at("to")).alias("rows_at"), F.first("top").alias("top"))
    groups = asked.groupBy("dims", "cell", "group").agg(F.array(*at("to")).alias("asked_at"), F.max(square).alias("norm"), F.min(F.coalesce("least", F.lit(float("-inf")))).alias("least"))
    apart = F.zip_with("rows_at", "asked_at", lambda r, a: F.coalesce(F.greatest(r["lo"] - a["hi"], a["lo"] - r["hi"], F.lit(0.0)), F.lit(0.0)))
    magnitude = F.col("norm") + F.col("top")
    bound = (magnitude - F.pow(F.array_max(apart), F.lit(2.0))) / 2 + 2 * SLACK * (magnitude + 1) + 1e-6
    pairs = blocks.join(groups, "dims").filter(bound >= F.col("least")).select(*pair)
    pairs = work.save(pairs.join(homes, pair, "left_anti"), "pairs")
    second = meet(rows.join(pairs, ["dims", "row_cell", "block"]), asked.join(pairs, ["dims", "cell", "group"]))
    merged = first.unionByName(second).withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")
