"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and documents are lower-cased (A-Z) and cut into words of digits, letters and characters beyond ASCII. The automaton
accepts every word sequence that occurs in an item. A document's words are streamed through it: at each word it holds the
longest suffix of what has been read that occurs in some item. Where that length reaches a window (10 words, or a whole item
of fewer words), the state of the window's length tells the items that hold it, and the window's words are hit.

Most words of most documents can't be within a window: a window's words are all of the items' vocabulary, and each two
neighbours are neighbours in an item. That is tested for a whole batch with numpy, by 64-bit hashes, which can only let too
much through; runs long enough for the shortest window go through the automaton word by word, with the words themselves
compared. So nothing is missed and nothing is hit by a hash alone.

The automaton is built once for each block of items and flattened: sorted edges and suffix links as arrays of numbers, which
are broadcast and kept by each worker.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuforge.llm import common

_PAIR = np.uint64(0xD6E8FEB86659FD93)


class SuffixAutomaton:
    """Of several word sequences; states keep the items of the windows that end in them."""

    def __init__(self, items: list[tuple[object, list[int]]], window: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.window = window
        #: by window length: state to the items with a window of that length there
        self.found: dict[int, dict[int, set]] = {}
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        for item, words in items:
            n = min(window, len(words))
            if n:
                state = length = 0
                for w in words:
                    state, length = self.step(state, length, w, n)
                    if length == n:
                        self.found.setdefault(n, {}).setdefault(state, set()).add(item)

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:
            if self.length[q] == self.length[last] + 1:
                return q
            return self._clone(last, w, q)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _state(self, length: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        new = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[new] = self.link[q]
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def step(self, state: int, length: int, w: int, cap: int) -> tuple[int, int]:
        """State and matched length after one more word, of at most cap words."""
        while state and w not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        state = self.next[state].get(w, 0)
        length = length + 1 if state else 0
        if length > cap:
            length = cap
        return self.cut(state, length), length

    def cut(self, state: int, length: int) -> int:
        """The state of the suffix of that length."""
        while self.length[self.link[state]] >= length > 0:
            state = self.link[state]
        return state

    def flat(self, n_words: int) -> FlatAutomaton:
        """The same as arrays; words are numbers below n_words."""
        edges = sorted((state * n_words + w, to) for state, moves in enumerate(self.next) for w, to in moves.items())
        return FlatAutomaton(n_words, array("q", (e for e, _ in edges)), array("q", (t for _, t in edges)), array("q", self.link), array("q", self.length), self.window, self.found)


class FlatAutomaton:
    """A finished automaton: 16 bytes for an edge and 16 for a state, with at most 3 edges and 2 states for a word of the items."""

    def __init__(self, n_words: int, edges: array, to: array, link: array, length: array, window: int, found: dict[int, dict[int, set]]):
        self.n_words, self.edges, self.to, self.link, self.length, self.window, self.found = n_words, edges, to, link, length, window, found

    def _move(self, state: int, w: int) -> int:
        """Where an edge leads, or -1."""
        at = bisect_left(self.edges, edge := state * self.n_words + w)
        return self.to[at] if at < len(self.edges) and self.edges[at] == edge else -1

    def step(self, state: int, length: int, w: int, cap: int) -> tuple[int, int]:
        """State and matched length after one more word (below 0: unknown), of at most cap words."""
        if w < 0:
            return 0, 0
        while (to := self._move(state, w)) < 0:
            if not state:
                return 0, 0
            state = self.link[state]
            length = self.length[state]
        length = min(length + 1, cap)
        return self.cut(to, length), length

    def cut(self, state: int, length: int) -> int:
        """The state of the suffix of that length."""
        while self.length[self.link[state]] >= length > 0:
            state = self.link[state]
        return state

    def stream(self, words: list[int]) -> tuple[list[tuple[int, int]], set]:
        """(hit spans in words, items) of a run of words."""
        spans: list[tuple[int, int]] = []
        items: set = set()
        lengths = sorted(self.found, reverse=True)
        state = length = 0
        for i, w in enumerate(words):
            state, length = self.step(state, length, w, self.window)
            hit = 0
            at = state
            for n in lengths:
                if n <= length:
                    at = self.cut(at, n)
                    if got := self.found[n].get(at):
                        items |= got
                        hit = max(hit, n)
            if hit:
                start = i + 1 - hit
                while spans and start <= spans[-1][1]:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, items


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, A-Z lower-cased."""
    data = np.frombuffer(text, np.uint8)
    _, starts, ends = common.words(data, np.array([0, len(data)]), common.ALNUM)
    low = text.lower()
    return [low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class Matcher:
    """The automaton with the vocabulary and the neighbours that its windows are made of."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in items for w in words))}
        ends = np.cumsum([len(w) for w in self.number], dtype=np.int64)
        hashes = common.span_hashes(np.frombuffer(b"".join(self.number), np.uint8), np.append(np.zeros(1, np.int64), ends[:-1]), ends) if self.number else np.zeros(0, np.uint64)
        numbers = [[self.number[w] for w in words] for _, words in items]
        self.vocabulary = np.unique(hashes)
        pairs = [hashes[x[:-1]] * _PAIR + hashes[x[1:]] for n in numbers if len(x := np.array(n, np.int64)) > 1]
        self.pairs = np.unique(np.concatenate(pairs or [np.zeros(0, np.uint64)]))
        self.least = min((min(window, len(n)) for n in numbers if n), default=0)
        self.automaton = SuffixAutomaton([(i, n) for (i, _), n in zip(items, numbers, strict=True)], window).flat(max(len(self.number), 1))

    @staticmethod
    def _in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not len(sorted_values):
            return np.zeros(len(x), bool)
        at = np.searchsorted(sorted_values, x)
        at[at == len(sorted_values)] = 0
        return sorted_values[at] == x

    def match(self, data: np.ndarray, hashes: np.ndarray, word_starts: np.ndarray, word_ends: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]], set]]:
        """Words of several texts: hashes, and places in data; first: where each text begins and where the last ends.
        (text, spans, items) of those hit."""
        if not self.least or not len(hashes):
            return
        known = self._in(self.vocabulary, hashes)
        joined = known[:-1] & known[1:]
        where = np.flatnonzero(joined)
        joined[where] = self._in(self.pairs, hashes[where] * _PAIR + hashes[where + 1])
        inner = first[(first > 0) & (first < len(hashes))]
        joined[inner - 1] = False
        starts = np.flatnonzero(known & ~np.append(False, joined))
        ends = np.flatnonzero(known & ~np.append(joined, False)) + 1
        long = ends - starts >= self.least
        texts: dict[int, tuple[list[tuple[int, int]], set]] = {}
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            begin = int(word_starts[a])
            raw = data[begin : word_ends[b - 1]].tobytes().lower()
            run = [self.number.get(raw[x:y], -1) for x, y in zip((word_starts[a:b] - begin).tolist(), (word_ends[a:b] - begin).tolist(), strict=True)]
            spans, items = self.automaton.stream(run)
            if spans:
                text = int(np.searchsorted(first, a, "right")) - 1
                got = texts.setdefault(text, ([], set()))
                got[0].extend((a - int(first[text]) + x, a - int(first[text]) + y) for x, y in spans)
                got[1].update(items)
        for text, (spans, items) in texts.items():
            yield text, spans, items


def _matchers(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> Iterator[Matcher]:
    """A matcher for each block of items of about block_words words, every item whole. Items stream to the driver one partition
    at a time, and no more than one block of them is held."""
    rows = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("item is not null and text is not null")
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    for row in rows.toLocalIterator():
        words = words_of(row.text.encode())
        if block and size + len(words) > block_words:
            yield Matcher(block, window)
            block, size = [], 0
        block.append((row.item, words))
        size += len(words)
    yield Matcher(block, window)


HIT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("items", T.ArrayType(T.StringType()))])


def find(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, hit_col: str = "hit", block_words: int = 200_000) -> DataFrame:
    """docs with hit_col: n_words, spans of hit words (start, end; end exclusive, disjoint) and the items, of each whole text.

    A null text has no words; null items and texts of items are skipped; an item id on several rows counts once. Repeated
    rows stay. Items come in blocks of block_words at most (or one longer item), each a pass within the same tasks with an
    automaton of its own, so a broadcast has a bound whatever the benchmark; no shuffle. README has the memory measured.
    """
    keep = [c for c in docs.columns if c.lower() != hit_col.lower()]
    df = docs.select(*(f"`{c}`" for c in keep))
    at = [c.lower() for c in keep].index(text_col.lower())
    sc = docs.sparkSession.sparkContext
    for k, matcher in enumerate(_matchers(benchmark, item_col, item_text_col, window, block_words)):
        shared = sc.broadcast(matcher)
        schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(hit_col, HIT)])
        df = df.transform(common.arrow, _pass(shared, at, len(keep), k > 0, [*keep, hit_col]), schema)
    return df


def _pass(shared, at: int, n_keep: int, again: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = shared.value
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            items: list[list] = [[] for _ in range(batch.num_rows)]
            for lo, hi, data, offsets in common.slices(batch.column(at)):
                hashes, starts, ends = common.words(data, offsets, common.ALNUM)
                first = common.per_text(starts, offsets)
                n[lo:hi] = np.diff(first)
                for text, got, which in matcher.match(data, hashes, starts, ends, first):
                    spans[lo + text], items[lo + text] = got, sorted(which)
            if again:
                for i, old in enumerate(batch.column(n_keep).to_pylist()):
                    spans[i] = _union([*((s["start"], s["end"]) for s in old["spans"]), *spans[i]])
                    items[i] = sorted({*old["items"], *items[i]})
            rows = [{"n_words": int(w), "spans": [{"start": a, "end": b} for a, b in s], "items": i} for w, s, i in zip(n, spans, items, strict=True)]
            kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], pa.array(rows, kind)], names)

    return run


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def n_hit(hit: str) -> Column:
    return F.aggregate(f"{hit}.spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def report(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 10, **options) -> DataFrame:
    """id_col, n_words, n_hit, n_items, items_sha256 (of the item ids, sorted as strings, comma-joined), contaminated."""
    found = find(common.only(docs, id=id_col, text=text_col), benchmark, text_col="text", hit_col="hit", window=window, **options)
    return found.select(F.col("id").alias(id_col), "hit.n_words", n_hit("hit").alias("n_hit"), F.size("hit.items").cast("long").alias("n_items"), F.sha2(F.array_join("hit.items", ","), 256).alias("items_sha256"), (F.size("hit.spans") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", window: int = 10, max_coverage: float = 0.5, **options) -> DataFrame:
    """docs without the passages of test items: hit spans go from the text; a document of which more than max_coverage of the
    words are hit goes whole. Others stay as they are, with all their columns."""
    hit = common.free_name(docs, "hit")
    found = find(docs, benchmark, text_col=text_col, hit_col=hit, window=window, **options)
    rest = found.filter(n_hit(hit) <= max_coverage * F.col(f"{hit}.n_words"))
    columns = docs.columns
    at = [c.lower() for c in columns].index(text_col.lower())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, h in enumerate(batch.column(len(columns)).to_pylist()):
                if h["spans"]:
                    texts[i] = without(texts[i], [(s["start"], s["end"]) for s in h["spans"]])
            out = list(batch.columns[: len(columns)])
            out[at] = pa.array(texts, out[at].type)
            yield pa.RecordBatch.from_arrays(out, columns)

    return rest.transform(common.arrow, cut, T.StructType([rest.schema[c] for c in columns]))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and what lies between words of a span."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    _, starts, ends = common.words(data, np.array([0, len(data)]), common.ALNUM)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")
