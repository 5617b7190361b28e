"""The longest alias in a text, by a trie of the aliases' tokens with failure links.

Texts and aliases are cut into tokens by expressions; tokens are compared by their 64-bit hashes (unequal ones are equal by chance
only, 2^-64 a pair). The trie is a set of flat arrays, built in a task: edges sorted by (node, token), the failure link of each
node, and the best alias that ends there. A text is read once, many texts at a time with numpy, step by step: no run of tokens
becomes a row. Long texts are read in pieces that overlap by the longest alias.

A vocabulary of more than PART_TOKENS tokens is split by the first token's hash into parts, each with a trie of its own; texts
are read once for each part, one part after the other, so that one trie is broadcast at a time, whatever the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuforge.sources.tables import save

#: Tokens of aliases in one trie: some 30 bytes each when broadcast.
PART_TOKENS = 2_000_000
#: Tokens of a text read in one piece, at least.
PIECE = 512
NONE = np.iinfo(np.int32).max


class Trie:
    """Flat arrays: tokens (sorted hashes), keys (node * number of tokens + token, sorted) with child, fail and best by node."""

    NAMES = ("tokens", "keys", "child", "fail", "best", "longest")

    def __init__(self, *arrays: np.ndarray):
        self.tokens, self.keys, self.child, self.fail, self.best, self.longest = arrays

    @classmethod
    def of(cls, hashes: list[np.ndarray], numbers: np.ndarray) -> Trie:
        """A trie of aliases given by their tokens' hashes; of those that end at a node the smallest number is the best."""
        sizes = np.array([len(h) for h in hashes], np.int64)
        flat = np.concatenate(hashes) if len(hashes) else np.zeros(0, np.int64)
        tokens, of = np.unique(flat, return_inverse=True)
        starts, n_tokens = np.cumsum(sizes) - sizes, max(len(tokens), 1)
        node, n_nodes = np.zeros(len(sizes), np.int64), 1
        levels, best = [], [np.full(1, NONE, np.int64)]
        ended = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for depth in range(int(sizes.max(initial=0))):
            live = np.flatnonzero(sizes > depth)
            keys, where = np.unique(node[live] * n_tokens + of[starts[live] + depth], return_inverse=True)
            node[live] = n_nodes + where
            levels.append((keys, n_nodes))
            n_nodes += len(keys)
        best = np.full(n_nodes, NONE, np.int64)
        np.minimum.at(best, node[sizes > 0], numbers[sizes > 0])
        keys = np.concatenate([k for k, _ in levels]) if levels else np.zeros(0, np.int64)
        child = np.arange(1, n_nodes, dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        made = cls(tokens, keys[order], child[order].astype(np.int32), np.zeros(n_nodes, np.int32), best, np.array([sizes.max(initial=0)]))
        for level, (keys, first) in enumerate(levels):
            at = np.arange(first, first + len(keys))
            if level:
                made.fail[at] = made.step(made.fail[keys // n_tokens].astype(np.int64), keys % n_tokens)
            made.best[at] = np.minimum(made.best[at], made.best[made.fail[at]])
        made.best = made.best.astype(np.int32)
        return made

    def step(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The node after reading a token (-1: one that no alias has), for many at once."""
        out, left = np.zeros(len(state), np.int64), np.flatnonzero(token >= 0)
        n = max(len(self.tokens), 1)
        while len(left) and len(self.keys):
            key = state[left] * n + token[left]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            out[left[found]] = self.child[at[found]]
            left = left[~found & (state[left] > 0)]
            if len(left):
                state = state.copy()
                state[left] = self.fail[state[left]]
        return out

    def search(self, hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The best alias' number in each text of hashes[offsets[i]:offsets[i + 1]], NONE where there is none."""
        sizes = np.diff(offsets)
        if not len(self.tokens) or not len(hashes):
            return np.full(len(sizes), NONE, np.int32)
        at = np.minimum(np.searchsorted(self.tokens, hashes), len(self.tokens) - 1)
        token = np.where(self.tokens[at] == hashes, at, -1)
        lap = int(self.longest[0]) - 1
        piece = max(PIECE, 4 * lap)
        pieces = np.maximum(-(-sizes // piece), 1)
        text = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.maximum(nth * piece - lap, 0)
        length = np.minimum((nth + 1) * piece, sizes[text]) - begin
        order = np.argsort(-length, kind="stable")
        start, ends = (offsets[text] + begin)[order], length[order]
        state, best = np.zeros(len(order), np.int64), np.full(len(order), NONE, np.int32)
        live = len(order)
        for t in range(int(ends.max(initial=0))):
            while ends[live - 1] <= t:
                live = int(np.searchsorted(-ends, -t, "left"))
            state[:live] = self.step(state[:live], token[start[:live] + t])
            best[:live] = np.minimum(best[:live], self.best[state[:live]])
        out = np.full(len(sizes), NONE, np.int32)
        np.minimum.at(out, text[order], best)
        return out


_KINDS = dict(zip(Trie.NAMES, ("<i8", "<i8", "<i4", "<i4", "<i4", "<i8"), strict=True))


def longest_alias(rows: DataFrame, id_col: str, tokens: Column, vocab: DataFrame, vocab_tokens: Column, part_tokens: int = PART_TOKENS) -> DataFrame:
    """id_col, and the columns of vocab(alias, ...) of the longest alias whose tokens stand one after the other in the row's tokens;
    of equal length the alphabetically first. Rows without an alias are left out; of rows with one id, the best counts.
    Aliases without tokens match nothing; null tokens count as none."""
    hashed = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.xxhash64(x))
    known = vocab.withColumn("hashes", hashed(vocab_tokens)).filter(F.size("hashes") > 0)
    size = known.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
    parts = max(1, -(-size // part_tokens))
    known = known.withColumn("part", F.pmod(F.element_at("hashes", 1), F.lit(parts)).cast("int"))
    rest = [c for c in vocab.columns if c != "alias"]
    order = Window.partitionBy("part").orderBy(F.desc(F.length("alias")), "alias", *rest)
    known = save(known.withColumn("number", F.row_number().over(order)), "aliases")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        trie = Trie.of([np.array(h, np.int64) for h in pdf["hashes"]], pdf["number"].to_numpy(np.int64))
        return pd.DataFrame([[int(pdf["part"].iloc[0]), *(getattr(trie, n).astype(k).tobytes() for n, k in _KINDS.items())]], columns=["part", *_KINDS])

    tries = save(known.select("part", "number", "hashes").groupBy("part").applyInPandas(build, "part int, " + ", ".join(f"{n} binary" for n in _KINDS)), "alias-tries")
    texts = rows.select(F.col(f"`{id_col}`").alias("id"), hashed(tokens).alias("hashes"))
    if parts > 1:
        texts = save(texts, "alias-texts")
    found = None
    for part in range(parts):
        one = _matches(texts, tries, part)
        if one is not None:
            one = save(one, "alias-found") if parts > 1 else one
            found = one if found is None else found.unionByName(one)
    if found is None:
        found = texts.select("id", F.lit(0).alias("part"), F.lit(0).alias("number")).limit(0)
    best = F.min(F.struct((-F.length("alias")).alias("less"), "alias", *rest)).alias("b")
    return found.join(known.drop("hashes"), ["part", "number"]).groupBy("id").agg(best).select(F.col("id").alias(id_col), *(F.col(f"b.{c}").alias(c) for c in vocab.columns))


def _matches(texts: DataFrame, tries: DataFrame, part: int) -> DataFrame | None:
    """(id, part, number) of texts with an alias of the part."""
    row = tries.filter(F.col("part") == part).first()
    if row is None:
        return None
    shared = texts.sparkSession.sparkContext.broadcast([bytes(row[n]) for n in Trie.NAMES])  # bounded by PART_TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(*(np.frombuffer(x, k) for x, k in zip(shared.value, _KINDS.values(), strict=True)))
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                mine = batch.slice(lo, 2000)
                lists = mine.column(1)
                number = trie.search(lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(np.diff(lists.offsets.to_numpy()))))
                hit = np.flatnonzero(number != NONE)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([mine.column(0).take(pa.array(hit)), pa.array(np.full(len(hit), part), pa.int32()), pa.array(number[hit], pa.int32())], ["id", "part", "number"])

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, part int, number int")
