"""N-gram Jaccard self-join with rare-first prefix filtering, and the groups that its links make.

A text's set is its distinct word n-grams, as 64-bit hashes. Texts with equal sets are one node. For a threshold t, two sets
of sizes a and b can only reach it with an overlap of least(a, b) = ceil(t (a + b) / (1 + t)), so

* length: t a <= b for a >= b;
* prefix: with n-grams in one order for all sets, rare ones first, the first a - ceil(t a) + 1 of both hold a common one.
  The order is by a sketch of document frequencies (2^SKETCH_BITS counters, summed over the whole corpus), then by hash;
* position: a common n-gram at places i and j leaves at most min(i, j) + 1 + min(a - i - 1, b - j - 1) in common, and with c
  common n-grams in the prefixes at most c plus the longer rest;
* suffix: with the n-grams' range cut at fixed pivots, the parts' sizes differ by no more than the sets do, in sum.

Sets are joined on prefix n-grams in two rounds. In the first, every set meets one leader of each of its prefix n-grams, so
the pairs are as many as the prefix n-grams; what they link needs no more pairs. In the second, sets with a common prefix
n-gram that aren't connected yet meet each other:

* For n-grams of up to FEW such sets, the pairs are rows of a join. A pair that several n-grams bring together is one row.
* More frequent n-grams would make rows with the square of their sets. Their sets come in blocks instead, whoever isn't in
  the n-gram's largest component against all, and the same filters take pairs from two blocks. The least of the frequent
  n-grams that a pair has in common is the one that takes it.

So each pair that passes the filters is verified once, exactly, unless it is already known to be connected; no pair that
could connect two components goes untested, and nothing is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuforge.llm import common
from skuforge.llm.components import components

SKETCH_BITS = 20
#: Sets of a prefix n-gram whose pairs are rows.
FEW = 64
#: Sets, and n-grams of sets, on each side of a unit of verification.
GROUP_SETS, GROUP_NGRAMS = 512, 1_000_000
PARTS = 32


def sets(data: np.ndarray, offsets: np.ndarray, n: int, kind: np.ndarray = common.SPACED) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; with fewer words, the whole sequence is one; without words, none."""
    hashes, starts, _ = common.words(data, offsets, kind)
    first = common.per_text(starts, offsets)
    rolled = hashes
    for k in range(1, n):
        rolled = common.mix(rolled[: len(hashes) - k] * np.uint64(3) + hashes[k:])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            h = hashes[a : a + 1]
            for k in range(a + 1, b):
                h = common.mix(h * np.uint64(3) + hashes[k : k + 1])
            out.append(common.mix(h + np.uint64(b - a)))
        else:
            out.append(hashes[:0])
    return out


def _at_least(num: int, den: int, n: np.ndarray | int):
    """ceil(t n) for t = num / den."""
    return -(-num * n // den)


def _order(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    return s[np.lexsort((s, sketch[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))]


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.append(0, np.cumsum([len(a) for a in arrays])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64), kind))


def _sketch(texts: DataFrame, n: int) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, _, data, offsets in common.slices(batch.column(0)):
                found = sets(data, offsets, n)
                if found:
                    total += np.bincount((np.concatenate(found) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array([np.minimum(total, _MOST).astype(np.uint32).tobytes()], pa.binary())], ["part"])

    got = common.fold_arrays(texts.transform(common.arrow, count, "part binary"), "uint32", _add)
    # for an order, an eighth of a binary order of magnitude tells enough, in a byte
    return np.zeros(1 << SKETCH_BITS, np.uint8) if got is None else np.minimum(8 * np.log2(1.0 + got), 255).astype(np.uint8)


_MOST = np.uint64(2**32 - 1)


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums that stop at the largest number."""
    return np.minimum(a.astype(np.uint64) + b, _MOST).astype(np.uint32)


class _Group:
    """Sets that meet, with what is known to be connected."""

    def __init__(self, tokens: list[np.ndarray], num: int, den: int, labels: np.ndarray | None = None):
        self.num, self.den = num, den
        self.size = np.array([len(t) for t in tokens], np.int64)
        shift = np.uint64(64 - int(np.log2(PARTS)))
        self.parts = np.stack([np.bincount((t >> shift).astype(np.int64), minlength=PARTS) for t in tokens])
        vocabulary, self.where = np.unique(np.concatenate(tokens), return_inverse=True)
        self.ends = np.append(0, np.cumsum(self.size))
        self.mine = np.zeros(len(vocabulary), bool)
        self.parent = np.arange(len(tokens))
        if labels is not None:
            for same in pd.Series(range(len(tokens))).groupby(labels, sort=False).indices.values():
                self.parent[same] = same[0]

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def meet(self, u: int, others: np.ndarray) -> list[tuple[int, int]]:
        """Links of u with others, by length and suffix filters and then exactly, unless already connected."""
        size, num, den = self.size, self.num, self.den
        low, high = np.minimum(size[others], size[u]), np.maximum(size[others], size[u])
        need = -(-num * (low + high) // (num + den))
        apart = np.abs(self.parts[others] - self.parts[u]).sum(1)  # suffix: parts of the sets' range
        others = others[(high * num <= low * den) & (apart <= low + high - 2 * need)]
        root = self.find(u)
        others = [v for v in others.tolist() if self.find(v) != root]
        links = []
        if others:
            own = self.where[self.ends[u] : self.ends[u + 1]]
            self.mine[own] = True
            for v in others:
                if self.find(v) != self.find(u):
                    both = int(np.count_nonzero(self.mine[self.where[self.ends[v] : self.ends[v + 1]]]))
                    if den * both >= num * (size[u] + size[v] - both):
                        self.parent[self.find(v)] = self.find(u)
                        links.append((u, v))
            self.mine[own] = False
        return links


def connect(ids: np.ndarray, tokens: list[np.ndarray], num: int, den: int, pairs: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Links (places in ids) that connect what the pairs (places in ids; all, if None) can."""
    if len(tokens) < 2:
        return []
    group, links = _Group(tokens, num, den), []
    if pairs is None:
        for u in range(len(tokens)):
            links += group.meet(u, np.arange(u + 1, len(tokens)))
        return links
    both = np.array(pairs, np.int64).reshape(-1, 2)
    both = both[np.argsort(both[:, 0], kind="stable")]
    for part in np.split(both, np.flatnonzero(both[1:, 0] != both[:-1, 0]) + 1):
        if len(part):
            links += group.meet(int(part[0, 0]), part[:, 1])
    return links


LINK = "a long, b long"


def _verify(num: int, den: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = pdf[~pdf["is_pair"]].drop_duplicates("key", ignore_index=True)
        keys = sets["key"].tolist()
        place = {k: i for i, k in enumerate(keys)}
        asked = pdf[pdf["is_pair"]]
        pairs = [(place[a], place[b]) for a, b in zip(asked["key"], asked["other"], strict=True)]
        tokens = [np.asarray(t, np.int64).view(np.uint64) for t in sets["tokens"]]
        found = connect(np.arange(len(keys)), tokens, num, den, pairs)
        return pd.DataFrame([(keys[a], keys[b]) for a, b in found], columns=["a", "b"])

    return run


def _verify_blocks(num: int, den: int):
    """Of one n-gram h: the sets of a block that are outside its largest component (left) against a block of all its sets."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("left", ascending=False, kind="stable").drop_duplicates("key", ignore_index=True)
        keys, left, n, pos = pdf["key"].tolist(), pdf["left"].to_numpy(bool), pdf["n"].to_numpy(np.int64), pdf["pos"].to_numpy(np.int64)
        right, label = pdf["right"].to_numpy(bool), pd.factorize(pdf["label"])[0]
        tokens = [np.asarray(t, np.int64).view(np.uint64) for t in pdf["tokens"]]
        # which frequent n-grams each set has in its prefix, the least first
        flat = np.concatenate([np.asarray(x, np.int64) for x in pdf["hots"]])
        known, at = np.unique(flat, return_inverse=True)
        has = np.zeros((len(keys), len(known)), bool)
        has[np.repeat(np.arange(len(keys)), [len(x) for x in pdf["hots"]]), at] = True
        here = int(np.searchsorted(known, pdf["h"].iloc[0]))
        key, outside = pdf["key"].to_numpy(np.int64), pdf["outside"].to_numpy(bool)
        group, links = _Group(tokens, num, den, label), []
        for u in np.flatnonzero(left).tolist():
            may = right & (label != label[u]) & ~(outside & (key <= key[u]))  # two outside sets meet in two units
            need = -(-num * (n + n[u]) // (num + den))
            may &= np.minimum(pos, pos[u]) + 1 + np.minimum(n - pos - 1, n[u] - pos[u] - 1) >= need
            others = np.flatnonzero(may)
            others = others[(has[others] & has[u]).argmax(1) == here]
            links += group.meet(u, others)
        return pd.DataFrame([(keys[a], keys[b]) for a, b in links], columns=["a", "b"])

    return run


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def links(docs: DataFrame, work: common.Workspace, *, id_col: str, text_col: str, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(base, nodes, first, links): id, n, set_key and text_hash of every row; key (a number), set_key and least id of every set;
    key and label of the sets that the first round connected; links (a, b) between keys that with those connect all linked sets."""
    df = common.only(docs, id=id_col, text=text_col).select("id", "text", _text_hash(F.col("text")).alias("text_hash"))
    sketch = docs.sparkSession.sparkContext.broadcast(_sketch(df.select("text"), n))  # 1 MB whatever the input
    kind = df.schema["id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, keys, prefix = [], [], []
            for _, _, data, offsets in common.slices(batch.column(1)):
                for s in sets(data, offsets, n):
                    size.append(len(s))
                    keys.append(_key(s) if len(s) else None)
                    prefix.append(_signed(_order(s, sketch.value)[: len(s) - _at_least(num, den, len(s)) + 1 if len(s) else 0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(keys, pa.binary()), _lists(prefix, pa.int64()), batch.column(2)], ["id", "n", "set_key", "prefix", "text_hash"])

    common.release()
    base = work.save(df.transform(common.arrow, describe, f"id {kind}, n long, set_key binary, prefix array<long>, text_hash long"), "sets")
    row = F.xxhash64("id", "text_hash")
    nodes = base.filter("n > 0").groupBy("set_key").agg(F.min(F.struct("n", "prefix")).alias("s"), F.min(F.struct("id", "text_hash")).alias("r"), F.min("id").alias("least"))
    nodes = work.save(nodes.select(F.monotonically_increasing_id().alias("key"), "set_key", "least", F.xxhash64("r.id", "r.text_hash").alias("row"), "s.*"), "nodes")
    postings = nodes.select("key", "n", F.posexplode("prefix").alias("pos", "h"))
    blocks = F.ceil(F.greatest(F.count("*") / GROUP_SETS, F.sum("n") / GROUP_NGRAMS)).cast("int")
    counts = postings.groupBy("h").agg(F.count("*").alias("cnt"), blocks.alias("blocks")).filter("cnt > 1")
    shared = work.save(postings.join(counts, "h"), "shared")
    # a pair is (a, b) with a the smaller set, by key where sizes are equal
    ahead = lambda x, y: (F.col(f"{x}.n") < F.col(f"{y}.n")) | ((F.col(f"{x}.n") == F.col(f"{y}.n")) & (F.col(f"{x}.key") < F.col(f"{y}.key")))
    need = lambda na, nb: F.ceil((F.col(na) + F.col(nb)) * num / (num + den) - 1e-9)
    na, nb, pa_, pb = F.col("a.n"), F.col("b.n"), F.col("a.pos"), F.col("b.pos")
    near = (na * den >= nb * num) & (F.least(pa_, pb) + 1 + F.least(na - pa_ - 1, nb - pb - 1) >= need("a.n", "b.n"))
    rest = lambda x: F.ceil(F.col(x) * num / den - 1e-9) - 1
    enough = F.col("c") + F.greatest(rest("na"), rest("nb")) >= need("na", "nb")

    def pairs_of(meetings: DataFrame) -> DataFrame:
        """(ka, kb, unit) once for each pair with enough n-grams in common; unit: the most frequent of them."""
        unit = F.max(F.struct(F.col("a.cnt").alias("cnt"), F.col("a.h").alias("h"), F.col("a.blocks").alias("blocks"))).alias("unit")
        pairs = meetings.groupBy(F.col("a.key").alias("ka"), F.col("b.key").alias("kb")).agg(unit, F.count("*").alias("c"), F.first("a.n").alias("na"), F.first("b.n").alias("nb"))
        return pairs.filter(enough).select("ka", "kb", "unit")

    rows = df.select("text", row.alias("row"))
    standing = lambda pairs: pairs.select(F.explode(F.array("ka", "kb")).alias("key")).distinct().join(nodes.select("key", "set_key", "row"), "key")
    # first round: with the leader of each prefix n-gram. Other n-grams that the two have in common aren't counted, so a pair
    # may be left to the second round
    columns = ["h", "key", "n", "pos", "cnt", "blocks"]
    led = shared.groupBy("h").agg(F.min(F.struct(F.xxhash64("key").alias("r"), *columns[1:])).alias("l")).select("h", *(F.col(f"l.{c}").alias(f"l_{c}") for c in columns[1:]))
    both = shared.join(led, "h").filter(F.col("key") != F.col("l_key")).select(F.struct(*columns).alias("x"), F.struct("h", *(F.col(f"l_{c}").alias(c) for c in columns[1:])).alias("y"))
    both = both.select(F.when(ahead("x", "y"), F.col("x")).otherwise(F.col("y")).alias("a"), F.when(ahead("x", "y"), F.col("y")).otherwise(F.col("x")).alias("b"))
    first = work.save(pairs_of(both.filter(near)), "pairs")
    stands = work.save(standing(first), "stand")
    full = work.save(_full(rows, stands, n), "full")
    found = work.save(_verified(first, full, num, den), "links")
    # second round: whoever has a prefix n-gram in common and isn't connected yet
    label = work.save(components(found, work, "connected").withColumnRenamed("node", "key"), "labels")
    named = work.save(shared.join(label, "key", "left").withColumn("label", F.coalesce("label", "key")), "named")
    by_label = named.groupBy("h", "label").agg(F.count("*").alias("c"))
    by_ngram = by_label.groupBy("h").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("m"))
    by_ngram = work.save(by_ngram.select("h", "m", F.col("top.label").alias("main"), (F.col("m") - F.col("top.c")).alias("n_outside")).filter("n_outside > 0"), "ngrams")
    hot = named.join(by_ngram.filter(F.col("m") > FEW), "h")
    hots = work.save(hot.groupBy("key").agg(F.array_sort(F.collect_set("h")).alias("hots")), "hots")
    few = named.join(hots, "key", "left").withColumn("hots", F.coalesce("hots", F.array().cast("array<bigint>")))
    few = few.join(by_ngram.filter(F.col("m") <= FEW).select("h"), "h")
    a, b = few.alias("a"), few.alias("b")
    meet = (F.col("a.h") == F.col("b.h")) & ahead("a", "b") & (F.col("a.label") != F.col("b.label")) & near & ~F.arrays_overlap("a.hots", "b.hots")
    second = work.save(pairs_of(a.join(b, meet)).join(first.select("ka", "kb"), ["ka", "kb"], "left_anti"), "pairs")
    more = standing(second).unionByName(hots.select("key").join(nodes.select("key", "set_key", "row"), "key")).distinct()
    full = full.unionByName(work.save(_full(rows, work.save(more.join(stands.select("key"), "key", "left_anti"), "stand"), n), "full"))
    found = _verified(second, full, num, den)
    # frequent n-grams, block by block
    groups, spread = F.ceil(F.col("n_outside") / GROUP_SETS).cast("int"), lambda count, salt: F.pmod(F.xxhash64("key", F.lit(salt)), count).cast("int")
    upto = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    hot = hot.select("h", "key", "n", "pos", "label", "blocks", (F.col("label") != F.col("main")).alias("outside"), groups.alias("groups"))
    sides = ["h", "key", "n", "pos", "label", "outside"]
    every = hot.select(*sides, spread(F.col("blocks"), 2).alias("j"), upto(F.col("groups")).alias("i"), F.lit(False).alias("left"))
    outside = hot.filter("outside").select(*sides, spread(F.col("groups"), 3).alias("i"), upto(F.col("blocks")).alias("j"), F.lit(True).alias("left"))
    met = every.unionByName(outside).groupBy("i", "j", *sides).agg(F.max("left").alias("left"), F.max(~F.col("left")).alias("right"))
    in_blocks = met.join(full.join(hots, "key"), "key").groupBy("h", "i", "j").applyInPandas(_verify_blocks(num, den), LINK)
    return base, nodes, label, work.save(found.unionByName(in_blocks), "links")


def _verified(pairs: DataFrame, full: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) among the pairs (ka, kb, unit): those of one n-gram together where they are many, of several where few."""
    buckets = F.lit(max(1, -(-pairs.count() // GROUP_SETS)))
    block = lambda key, side: F.pmod(F.xxhash64(key, F.lit(1)), F.col("unit.blocks")).cast("int").alias(side)
    h = F.when(F.col("unit.blocks") > 1, F.col("unit.h")).otherwise(F.pmod(F.xxhash64("unit.h"), buckets)).alias("h")
    units = pairs.select("ka", "kb", h, block("ka", "i"), block("kb", "j"))
    unit = ["h", "i", "j"]
    needed = units.select(*unit, F.explode(F.array("ka", "kb")).alias("key")).distinct()
    rows = needed.join(full, "key").select(*unit, "key", F.lit(-1).cast("long").alias("other"), F.lit(False).alias("is_pair"), "tokens")
    rows = rows.unionByName(units.select(*unit, F.col("ka").alias("key"), F.col("kb").alias("other"), F.lit(True).alias("is_pair"), F.lit(None).cast("array<long>").alias("tokens")))
    return rows.groupBy(*unit).applyInPandas(_verify(num, den), LINK)


def _full(rows: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(key, tokens): whole sets of some nodes (key, set_key, row), from rows (text, row), where row is a hash of the row that
    stands for a node. A bit map of bounded size tells these rows before their texts are cut into words; it lets few others
    through, which the join with the nodes drops."""
    bits = min(1 << 26, max(1 << 16, 1 << (16 * max(nodes.count(), 1) - 1).bit_length()))
    place = lambda column: (common.mix(np.asarray(column).view(np.uint64)) % np.uint64(bits)).astype(np.int64)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = place(batch.column(0))
            np.bitwise_or.at(there, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([there.tobytes()], pa.binary())], ["part"])

    got = common.fold_arrays(nodes.select("row").coalesce(32).transform(common.arrow, mark, "part binary"), "uint8", np.bitwise_or)
    shared = rows.sparkSession.sparkContext.broadcast(got if got is not None else np.zeros(bits // 8, np.uint8))  # 8 MB at most

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = shared.value
        for batch in batches:
            at = place(batch.column(1))
            picked = batch.column(0).filter(pa.array((there[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))
            for _, _, data, offsets in common.slices(picked):
                some = [s for s in sets(data, offsets, n) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in some], pa.binary()), _lists([_signed(s) for s in some], pa.int64())], ["set_key", "tokens"])

    made = rows.transform(common.arrow, take, "set_key binary, tokens array<long>").groupBy("set_key").agg(F.first("tokens").alias("tokens"))
    return made.join(nodes.select("key", "set_key"), "set_key").select("key", "tokens")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100, work: common.Workspace | None = None) -> DataFrame:
    """A row for each row of docs: id_col, n_shingles (size of the set) and component_id, the smallest id that links reach.

    Two texts link where |A and B| / |A or B| >= num / den. Texts without words have no set and are linked with nothing; so
    are rows with a null id (component null), though their texts count among those that links go through. Repeated rows, and
    rows of one id with several texts, stay as they are. Other columns aren't read.
    """
    work = work or common.Workspace(docs.sparkSession, "ngram-join")
    base, by_key = _labelled(docs, work, id_col, text_col, n, num, den)
    out = base.select("id", "n", "set_key").join(by_key.select("set_key", "component"), "set_key", "left")
    own: Column = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))


def _labelled(docs: DataFrame, work: common.Workspace, id_col: str, text_col: str, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """links' base, and of each set with an id: set_key, label of its component and the component's smallest id."""
    base, nodes, first, found = links(docs, work, id_col=id_col, text_col=text_col, n=n, num=num, den=den)
    # later links go between the first round's components, which needn't be found again
    for side in ("a", "b"):
        found = found.join(first.withColumnRenamed("key", side), side, "left").withColumn(side, F.coalesce("label", side)).drop("label")
    label = components(found, work).withColumnRenamed("label", "last")
    ids = nodes.filter("least is not null").select("key", "set_key", "least").join(first, "key", "left").withColumn("node", F.coalesce("label", "key"))
    ids = work.save(ids.join(label, "node", "left").select("set_key", "least", F.coalesce("last", "node").alias("label")), "labels")
    groups = ids.groupBy("label").agg(F.min("least").alias("component"))
    return base, work.save(ids.join(groups, "label").select("set_key", "label", "component"), "component")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100, work: common.Workspace | None = None) -> DataFrame:
    """docs with one row of each group of near-duplicates: the one with the smallest id (of several texts of that id in the
    group one of them, of repeated rows one). A row goes only if its own text is in the group, whatever other rows have its
    id. Rows without words and rows with a null id stay."""
    work = work or common.Workspace(docs.sparkSession, "ngram-join")
    base, by_key = _labelled(docs, work, id_col, text_col, n, num, den)
    rows = base.filter("n > 0 and id is not null").select("set_key", "id", "text_hash")
    first = rows.groupBy("set_key").agg(F.min(F.struct("id", "text_hash")).alias("row")).join(by_key, "set_key")
    first = first.groupBy("label").agg(F.min("row").alias("row")).select("row.id", "row.text_hash")
    each = rows.groupBy("id", "text_hash").agg(F.count("*").alias("times"))
    name, text = common.free_name(docs, "dropped_id"), common.free_name(docs, "dropped_text")
    named = lambda df: df.select(F.col("id").alias(name), F.col("text_hash").alias(text))
    its = lambda df: (docs[f"`{id_col}`"] == df[name]) & (_text_hash(docs[f"`{text_col}`"]) == df[text])
    again = work.save(each.filter("times > 1").join(first, ["id", "text_hash"]), "repeated")
    drop = each.join(first, ["id", "text_hash"], "left_anti").select("id", "text_hash")
    if again.isEmpty():
        drop = named(drop)
        return docs.join(drop, its(drop), "left_anti")
    drop, again = named(drop.unionByName(again.select("id", "text_hash"))), named(again)
    one = docs.join(again, its(again)).dropDuplicates([name, text]).select(*(docs[f"`{c}`"] for c in docs.columns))
    return docs.join(drop, its(drop), "left_anti").unionByName(one)
