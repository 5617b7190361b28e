"""Hard negatives by k-means inverted lists, exact by Cauchy-Schwarz bounds.

Vectors become integers floor(scale * x). Centroids are fitted on a bounded sample; every row goes into the list of its nearest
centroid c, and each list keeps its radius r, the largest |x - c|. For an anchor q every score in a list lies within
q.c - |q| r and q.c + |q| r.

A search asks, for each anchor, for the k best scores inside each of its windows [lo, hi]. A list whose bounds lie outside a
window is skipped for it; the rest are visited from the highest bound on, until a bound falls strictly below the k-th score.
Equal scores go to the smaller id, so a bound equal to the k-th score is still visited.

* A list of more than block_rows rows is cut into blocks by a hash of the id; smaller lists share blocks. Anchors lie in groups.
  A group meets first the block with its highest bound, which gives k-th scores; then every block with a list that some window
  of the group still needs. Inside such a pair lists are again visited by bound, anchor by anchor.
* Positives are searched among the rows of the anchor's label, with one window open on both sides; negatives among all rows,
  those of the anchor's label left out, with one window for each positive.

Elimination depends on the data: vectors spread evenly over many dimensions have wide lists, and most of them are visited.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuforge.llm import common
from skuforge.llm.topk_pivots import EXACT, _usable, scores_of

#: Rows that centroids are fitted on: the sample's expected size for vectors of one length.
SAMPLE = 4096
#: Centroids of one length, at most, and numbers in them together.
CENTROIDS, CENTROID_NUMBERS = 1024, 1 << 20
LOW, HIGH = -(2**63), 2**63 - 1
#: Anchors whose scores are taken at once.
TOGETHER = 128


def _matrix(column: pd.Series, kind=np.float64) -> np.ndarray:
    return np.array(column.tolist(), kind).reshape(len(column), -1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1)[None, :] - 2 * (x @ centres.T)).argmin(1)


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means of the rows of x (Lloyd), started from rows far from each other; fewer where rows are copies."""
    x = np.unique(x.astype(np.float64), axis=0)
    at, near = [0], np.full(len(x), np.inf)
    while len(at) < min(k, len(x)):
        near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(1))
        at.append(int(near.argmax()))
    centres = x[at]
    for _ in range(rounds):
        of = _nearest(x, centres)
        n = np.bincount(of, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, of, x)
        moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def list_bounds(q: np.ndarray, norms: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) possible score of each anchor (rows) with the members of each list, widened by what float64 may lose."""
    at, lengths = q @ centres.T, np.sqrt((centres * centres).sum(1))
    reach = norms[:, None] * radii[None, :]
    reach = reach + 1e-9 * (reach + norms[:, None] * lengths[None, :]) + 1e-6
    return at - reach, at + reach


class _Windows:
    """The windows of a group of anchors, one after the other: whose, from where to where, k-th score so far."""

    def __init__(self, windows: pd.Series):
        sizes = [len(w) for w in windows]
        flat = [w for ws in windows for w in ws]
        self.of = np.repeat(np.arange(len(sizes)), sizes)
        self.tag, self.lo, self.hi, self.least = (np.array([w[n] for w in flat], np.int64) for n in ("tag", "lo", "hi", "least"))

    def open(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Highest score that each window can still get from each list, clipped to the window; -inf where the list is skipped."""
        low, high = low[self.of], high[self.of]
        hi, floor = self.hi[:, None].astype(np.float64), np.maximum(self.lo, self.least)[:, None].astype(np.float64)
        return np.where((high < floor) | (low > hi), -np.inf, np.minimum(high, hi))


def visit(rows: pd.DataFrame, asks: pd.DataFrame, lists: pd.DataFrame, k: int, same_label: bool) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """((anchor key, tag, row id, score, rank) of the k best of each window, scores taken) for rows of the lists given.

    rows: id, label, cluster, w; asks: key, id, label, w, windows; lists: cluster, centre, radius."""
    x, q = _matrix(rows["w"], np.int64), _matrix(asks["w"], np.int64)
    xf, qf = x.astype(np.float64), q.astype(np.float64)
    exact = max(np.abs(xf).max(initial=0), np.abs(qf).max(initial=0)) <= EXACT
    ids, labels, cluster = (rows[c].to_numpy() for c in ("id", "label", "cluster"))
    own, own_label, keys = (asks[c].to_numpy() for c in ("id", "label", "key"))
    windows = _Windows(asks["windows"])
    low, high = list_bounds(qf, np.sqrt((qf * qf).sum(1)), _matrix(lists["centre"]), lists["radius"].to_numpy(np.float64))
    members = [np.flatnonzero(cluster == c) for c in lists["cluster"].tolist()]
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(windows.of)
    taken = 0
    # lists by their highest bound for any window of the group; each anchor takes part where its own bounds ask for it
    order = np.argsort(-windows.open(low, high).max(0, initial=-np.inf), kind="stable")
    for j in order.tolist():
        still = windows.open(low[:, j : j + 1], high[:, j : j + 1])[:, 0] > -np.inf
        asking = np.unique(windows.of[still])
        if not len(asking) or not len(members[j]):
            continue
        mine = members[j]
        taken += len(asking) * len(mine)
        for r, a in enumerate(asking.tolist()):
            if exact and r % TOGETHER == 0:
                scores = np.rint(qf[asking[r : r + TOGETHER]] @ xf[mine].T).astype(np.int64)
            s = scores[r % TOGETHER] if exact else scores_of(x[mine], q[a])
            of_a = np.flatnonzero(still & (windows.of == a))
            floor = np.maximum(windows.lo[of_a], windows.least[of_a])
            fit = (s >= floor.min()) & (s <= windows.hi[of_a].max()) & (ids[mine] != own[a]) & ((labels[mine] == own_label[a]) == same_label)
            at = np.flatnonzero(fit)
            if not len(at):
                continue
            at = at[np.lexsort((ids[mine[at]], -1 - s[at]))]
            # scores downwards, as numbers of their order upwards (the negative of the lowest long isn't a long)
            down, found = -1 - s[at], ids[mine[at]]
            first = np.searchsorted(down, -1 - windows.hi[of_a], "left")
            last = np.minimum(np.searchsorted(down, -1 - floor, "right"), first + k)
            for w, lo, hi in zip(of_a.tolist(), first.tolist(), last.tolist(), strict=True):
                if hi > lo:
                    ss, ii = np.append(best[w][0], s[at[lo:hi]]), np.append(best[w][1], found[lo:hi])
                    keep = np.lexsort((ii, -1 - ss))[:k]
                    best[w] = ss[keep], ii[keep]
                    if len(keep) == k:
                        windows.least[w] = max(windows.least[w], ss[keep[-1]])
    return [(int(keys[windows.of[w]]), int(windows.tag[w]), i, s, n) for w, (ss, ii) in enumerate(best) for n, (s, i) in enumerate(zip(ss.tolist(), ii.tolist(), strict=True))], taken


def _numbers(vectors: DataFrame, label: Column, is_anchor: Column, id_col: str, vector_col: str, label_col: str, scale: float) -> DataFrame:
    v = F.col("v")
    given = vectors.withColumn(a := common.free_name(vectors, "is_anchor"), is_anchor).withColumn(l := common.free_name(vectors, "own_label"), label)
    rows = given.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.col(l).cast("long").alias("label"), F.coalesce(F.col(a), F.lit(False)).alias("anchor"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & _usable(v))
    return rows.select("id", "label", "anchor", F.size("v").alias("dims"), F.transform("v", lambda x: F.floor(F.lit(scale) * x)).alias("w"))


def inverted_lists(numbers: DataFrame, work: common.Workspace, rows_per_centroid: int = 2048, share_rows: int = 8192) -> tuple[DataFrame, DataFrame]:
    """(numbers with cluster and far: the distance to its centroid, (dims, cluster, centre)), both written."""
    n = work.save(numbers.groupBy("dims").agg(F.count("*").alias("n")), "lengths")
    most = F.least(F.lit(CENTROIDS), F.greatest(F.floor(F.lit(CENTROID_NUMBERS) / F.greatest("dims", F.lit(1))), F.lit(1)), F.ceil(F.col("n") / rows_per_centroid)).cast("int")
    of = F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.greatest(F.floor(F.col("n") / SAMPLE), F.lit(1))) == 0
    # equal vectors are one of the sample, so that a very common vector doesn't fill it
    sample = numbers.join(n, "dims").filter(of).groupBy("dims", "w").agg(F.max(most).alias("most"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        found = fit_centroids(_matrix(pdf["w"]), int(pdf["most"].iloc[0]))
        return pd.DataFrame({"dims": pdf["dims"].iloc[0], "cluster": np.arange(len(found)), "centre": list(found)})

    fitted = work.save(sample.groupBy("dims").applyInPandas(fit, "dims int, cluster int, centre array<double>"), "centroids")
    shares = F.ceil(F.col("n") / share_rows).cast("int")
    spread = numbers.join(n, "dims").withColumn("share", F.pmod(F.xxhash64("id", "label", F.lit(5)), shares).cast("int")).drop("n")
    each = fitted.join(n, "dims").select("dims", "cluster", "centre", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))

    def place(pdf: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pdf.assign(cluster=[], far=[]).drop(columns="share")
        x = _matrix(pdf["w"])
        c = _matrix(centres["centre"]) if len(centres) else np.zeros((1, x.shape[1]))
        names = centres["cluster"].to_numpy() if len(centres) else np.zeros(1, np.int64)
        of = _nearest(x, c)
        return pdf.drop(columns="share").assign(cluster=names[of], far=np.sqrt(((x - c[of]) ** 2).sum(1)))

    placed = spread.groupBy("dims", "share").cogroup(each.groupBy("dims", "share")).applyInPandas(place, "id long, label long, anchor boolean, dims int, w array<long>, cluster int, far double")
    return work.save(placed.select("id", "label", "anchor", "dims", "w", "cluster", "far"), "lists"), fitted


WINDOWS = "array<struct<tag: long, lo: long, hi: long, least: long>>"


def search(rows: DataFrame, asks: DataFrame, centres: DataFrame, space: list[str], k: int, same_label: bool, work: common.Workspace, *, block_rows: int, group_rows: int) -> DataFrame:
    """(key, tag, id, score, rank from 1) of the k best rows in each window of asks(key, id, label, dims, w, cluster, windows).

    Rows and asks meet only within a space (columns of both)."""
    lists = rows.groupBy(*space, "cluster").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    small = F.when(F.col("n") <= block_rows, F.col("n")).otherwise(0)
    lists = lists.withColumn("packs", F.greatest(F.ceil(F.sum(small).over(Window.partitionBy(*space)) / block_rows), F.lit(1)))
    # a: the list with blocks of its own, or -1 for a shared block; b: which block
    alone = F.col("n") > block_rows
    lists = lists.withColumns({"a": F.when(alone, F.col("cluster")).otherwise(-1).cast("int"), "slices": F.when(alone, F.ceil(F.col("n") / block_rows)).otherwise(1).cast("int"), "pack": F.when(alone, 0).otherwise(F.pmod(F.xxhash64("cluster"), "packs")).cast("int")})
    lists = work.save(lists.drop("packs"), "catalogue")
    blocked = rows.join(lists.select(*space, "cluster", "a", "slices", "pack"), [*space, "cluster"])
    blocked = blocked.select(*space, "a", F.when(F.col("a") < 0, F.col("pack")).otherwise(F.pmod(F.xxhash64("id", F.lit(7)), "slices")).cast("int").alias("b"), "id", "cluster", "w", *(["label"] if "label" not in space else []))
    # groups of about group_rows asks, neighbouring clusters together
    count = asks.groupBy(*space, "cluster").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy(*space).orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = count.withColumn("before", before)
    grouped = asks.join(groups, [*space, "cluster"]).withColumn("g", F.floor((F.col("before") + F.pmod(F.xxhash64("key", F.lit(9)), "m")) / group_rows).cast("int")).drop("m", "before", "cluster")
    grouped = work.save(grouped, "asks")
    known = work.save(lists.join(centres, ["dims", "cluster"]), "known")
    kind = {f.name: f.dataType.simpleString() for f in [*rows.schema, *asks.schema]}
    keys = ", ".join(f"{c} {kind[c]}" for c in space)

    def blocks_of(asks: DataFrame) -> DataFrame:
        """(space, g, a, b, bound): blocks that some window of the group needs."""
        each = asks.select(*space, "g").distinct().join(known, space)
        each = each.select(*(F.col(c).alias(f"of_{c}") for c in (*space, "g")), "a", "slices", "pack", "centre", "radius")

        def bound(pdf: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
            columns = [*space, "g", "a", "b", "bound"]
            if not len(pdf) or not len(of):
                return pd.DataFrame(columns=columns)
            q = _matrix(pdf["w"])
            low, high = list_bounds(q, np.sqrt((q * q).sum(1)), _matrix(of["centre"]), of["radius"].to_numpy(np.float64))
            top = _Windows(pdf["windows"]).open(low, high).max(0, initial=-np.inf)
            made = [(a, b, t) for a, slices, pack, t in zip(of["a"], of["slices"], of["pack"], top.tolist(), strict=True) if t > -np.inf for b in (range(slices) if a >= 0 else (pack,))]
            made = pd.DataFrame(made, columns=["a", "b", "bound"]).groupby(["a", "b"], as_index=False)["bound"].max()
            return made.assign(**{c: pdf[c].iloc[0] for c in (*space, "g")})[columns]

        return asks.select(*space, "g", "w", "windows").groupBy(*space, "g").cogroup(each.groupBy(*(f"of_{c}" for c in (*space, "g")))).applyInPandas(bound, f"{keys}, g int, a int, b int, bound double")

    def meet(pairs: DataFrame, asks: DataFrame) -> DataFrame:
        pair = [*space, "g", "a", "b"]
        none, zero = lambda t: F.lit(None).cast(t), lambda t: F.lit(0).cast(t)  # noqa: E731  # numbers aren't null: pandas would make them doubles
        label = [] if "label" in space else ["label"]
        columns = [*pair, "kind", "key", "id", *label, "cluster", "w", "windows", "centre", "radius"]
        there = blocked.join(pairs, [*space, "a", "b"]).withColumns({"kind": F.lit(0), "key": zero("long"), "windows": none(WINDOWS), "centre": none("array<double>"), "radius": zero("double")})
        here = asks.join(pairs, [*space, "g"]).withColumns({"kind": F.lit(1), "cluster": zero("int"), "centre": none("array<double>"), "radius": zero("double")})
        of = known.withColumn("b", F.explode(F.when(F.col("a") < 0, F.array("pack")).otherwise(F.sequence(F.lit(0), F.col("slices") - 1)))).join(pairs, [*space, "a", "b"])
        of = of.withColumns({"kind": F.lit(2), "key": zero("long"), "id": zero("long"), "w": none("array<long>"), "windows": none(WINDOWS)} | {c: zero("long") for c in label})
        every = there.select(*columns).unionByName(here.select(*columns)).unionByName(of.select(*columns))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            by = [pdf[pdf["kind"] == x] for x in range(3)]
            found = visit(by[0], by[1], by[2], k, same_label)[0] if len(by[0]) and len(by[1]) else []
            return pd.DataFrame(found, columns=["key", "tag", "id", "score", "place"]).astype("int64")[["key", "tag", "id", "score"]]

        return every.groupBy(*pair).applyInPandas(run, "key long, tag long, id long, score long")

    nearest = Window.partitionBy(*space, "g").orderBy(F.desc("bound"), "a", "b")
    first_pairs = work.save(blocks_of(grouped).withColumn("r", F.row_number().over(nearest)).filter("r = 1").select(*space, "g", "a", "b"), "first-pairs")
    first = work.save(meet(first_pairs, grouped), "first")
    kth = first.groupBy("key", "tag").agg(F.count("*").alias("c"), F.min("score").alias("least")).filter(F.col("c") >= k)
    least = kth.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("tag", "least"))).alias("reached"))
    fresh = F.transform("windows", lambda w: F.struct(w["tag"].alias("tag"), w["lo"].alias("lo"), w["hi"].alias("hi"), F.coalesce(F.try_element_at("reached", w["tag"]), w["least"]).alias("least")))
    again = work.save(grouped.join(least, "key", "left").withColumn("windows", fresh).drop("reached"), "asks-again")
    rest = work.save(blocks_of(again).select(*space, "g", "a", "b").join(first_pairs, [*space, "g", "a", "b"], "left_anti"), "rest-pairs")
    every = first.unionByName(meet(rest, again))
    best = Window.partitionBy("key", "tag").orderBy(F.desc("score"), "id")
    return every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, *, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0, positives: int = 5, negatives: int = 3, low_pct: int = 50, high_pct: int = 95,
    block_rows: int = 8_192, group_rows: int = 2_048, work: common.Workspace | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its first `positives` other rows of the same label by score, ties to the smaller id; for each, the
    first `negatives` rows of another label with low_pct * positive <= 100 * score <= high_pct * positive. A pair without
    such a row has none. Rows with a null id, label or vector, or a null or non-finite component, take no part. A row with
    the anchor's own id is never its positive or negative; else repeated rows count one by one. Anchors that are alike in
    id, label and vector are one; of one id with several labels or vectors, each is an anchor. Vectors of other lengths aren't
    compared. Scores beyond a long stop at the largest. Other columns aren't read.
    """
    work = work or common.Workspace(vectors.sparkSession, "hard-negatives")
    numbers = _numbers(vectors, F.col(f"`{label_col}`") if label is None else label, is_anchor, id_col, vector_col, label_col, scale)
    rows, centres = inverted_lists(work.save(numbers, "numbers"), work)
    anchors = rows.filter("anchor").groupBy("id", "label", "dims", "w").agg(F.min("cluster").alias("cluster")).withColumn("key", F.xxhash64("id", "label", "w"))
    anchors = work.save(anchors, "anchors")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("tag"), F.lit(LOW).alias("lo"), F.lit(HIGH).alias("hi"), F.lit(LOW).alias("least")))
    sizes = {"block_rows": block_rows, "group_rows": group_rows}
    near = search(rows, anchors.withColumn("windows", whole), centres, ["dims", "label"], positives, True, work, **sizes)
    near = work.save(near.select("key", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("tag").cast("long")), "positives")
    # exact whole-number limits of the window: products may pass a long
    share = lambda pct: F.lit(pct).cast("decimal(3,0)") * F.col("positive_score").cast("decimal(19,0)") / F.lit(100).cast("decimal(3,0)")
    lo, hi = F.ceil(share(low_pct)).cast("long"), F.floor(share(high_pct)).cast("long")
    asked = near.groupBy("key").agg(F.collect_list(F.struct("tag", lo.alias("lo"), hi.alias("hi"), F.lit(LOW).alias("least"))).alias("windows"))
    far = search(rows, anchors.join(asked, "key"), centres, ["dims"], negatives, False, work, **sizes)
    found = far.select("key", "tag", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    found = found.join(near, ["key", "tag"]).join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
