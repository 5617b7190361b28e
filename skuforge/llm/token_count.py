r"""Token counts by overlap resynchronisation.

A long text is encoded in overlapping chunks. A chunk that begins at any character may begin within a word, so its first
tokens may be wrong; the chunk before it may have a cut word at its end. Both are right about the text from position p on if

* p begins a pre-token (a match of the tokenizer's split pattern) in both: the pattern looks at what follows only, and the
  scan of each chunk goes on from p over the same characters;
* p is at least GUARD characters before the end of the left chunk, more than the split pattern's lookahead and the longest
  special token, so that nothing beyond the cut can change the left chunk's decision to begin a pre-token at p;
* the character at p is one that composition never joins with what precedes it.

The two token lists are spliced there. Where the overlap has no such p, the overlap is doubled, in the end to the whole
left chunk, and then the left chunk grows.

Chunks are encoded by the tokenizers library, with its own offsets. Texts of one chunk or less need no splicing. The
library's work on a pre-token depends on that alone, so for such texts, where they are free of special strings and of
characters that normalisation could join or reorder, a pre-token seen before by a worker takes its count from a bounded store
with the pre-token as key; the split is then made with numpy from the library's own character classes. That holds for the
normaliser and split pattern stated in EXPECTED; with any other tokenizer file every text goes to the library.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skuforge.llm import common, pretoken

GUARD = 32
#: The normaliser and the split that pretoken.dropped_pieces and _lower reproduce.
EXPECTED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "split": {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
}
#: Pre-tokens remembered by a worker.
CACHE = 500_000

Scan = Callable[[str], tuple[np.ndarray, np.ndarray]]


def splice(text: str, scan: Scan, chunk: int, overlap: int, joins: Callable[[str], bool] = lambda c: False) -> tuple[int, int]:
    """(tokens, widened overlaps) of text. scan: starts of a chunk's pre-tokens and their numbers of tokens."""
    n, widened, total = len(text), 0, 0
    base, end = 0, min(chunk, len(text))
    starts, counts = scan(text[base:end])
    while end < n:
        lap = min(overlap, end - base)
        while True:
            at = end - lap
            to = min(n, at + max(chunk, 2 * lap))
            more, more_counts = scan(text[at:to])
            left, right = starts + base, more + at
            common_starts = np.intersect1d(left[(left > at) & (left <= end - GUARD)], right, assume_unique=True)
            p = next((int(p) for p in common_starts[::-1] if not joins(text[p])), None)
            if p is not None:
                total += int(counts[left < p].sum())
                keep = right >= p
                starts, counts, base, end = more[keep], more_counts[keep], at, to
                break
            widened += 1
            if lap == end - base:  # no place to splice in all of the chunk: take a longer one
                end = min(n, end + max(chunk, end - base))
                starts, counts = _again(text, scan, base, end, starts)
                break
            lap = min(2 * lap, end - base)
    return total + int(counts.sum()), widened


def _again(text: str, scan: Scan, base: int, end: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunk from its first known boundary on, with more after it."""
    first = int(starts[0]) if len(starts) else 0
    more, counts = scan(text[base + first : end])
    return more + first, counts


class Counter:
    """Counts tokens of whole texts with a tokenizer whose JSON is given."""

    def __init__(self, tokenizer_json: str, table: bytes, plain: bytes, chunk: int, overlap: int, cached: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table, self.plain = pretoken.unpacked(table), pretoken.unpacked(plain)
        self.chunk, self.overlap = chunk, overlap
        self.cached = cached and _as_expected(json.loads(tokenizer_json))
        self.known = pretoken.Known(CACHE)

    def _make(self, pieces: list[str]) -> list[int]:
        """Tokens of each pre-token; the library sees them in one text, with spaces between, which it drops."""
        word = self.tokenizer.encode(" ".join(pieces), add_special_tokens=False).word_ids
        return np.bincount(np.array(word, np.int64), minlength=len(pieces)).tolist()

    def _scan_known(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Text is lower-case and free of special strings and of characters that normalisation joins."""
        starts, ends = pretoken.dropped_pieces(text, self.table)
        return starts, np.array(self.known.look_up(pretoken.cut(text, starts, ends), self._make), np.int64)

    def _scan_library(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Any text: the library's tokens with offsets, grouped by its pre-tokens."""
        made = self.tokenizer.encode(text, add_special_tokens=False)
        if not len(made):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        words = made.word_ids
        word = np.array(words if None not in words else [-1 if w is None else w for w in words])
        first = np.ones(len(word), bool)
        first[1:] = (word[1:] != word[:-1]) | (word[1:] < 0)
        at = np.flatnonzero(first)
        offsets = made.offsets
        starts, where = np.unique(np.array([offsets[i][0] for i in at.tolist()]), return_inverse=True)
        return starts, np.bincount(where, np.diff(np.append(at, len(word)))).astype(np.int64)

    def _joins(self, c: str) -> bool:
        return not self.plain[ord(c)]

    def _plain(self, text: str) -> bool:
        """Whether normalisation is lower-casing, one character at a time, and no special string is in the text."""
        return self.cached and not any(s in text for s in self.special) and (text.isascii() or bool(self.plain[pretoken.code_points(text)].all()))

    def count(self, text: str) -> tuple[int, int]:
        """(tokens, widened overlaps)"""
        return splice(text, self._scan_library, self.chunk, self.overlap, self._joins)

    def count_all(self, texts: list[str]) -> list[tuple[int, int]]:
        """count() of each; plain texts of one chunk are looked up together (a line end between them, which the split drops)."""
        found: list = [None] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= self.chunk and self._plain(t)]
        if short:
            starts, counts = self._scan_known("\n".join(low := [_lower(texts[i]) for i in short]))
            sums = np.append(0, np.cumsum(counts))
            edges = np.append(0, np.cumsum([len(t) + 1 for t in low]))
            at = np.searchsorted(starts, edges)
            for i, n in zip(short, (sums[at[1:]] - sums[at[:-1]]).tolist(), strict=True):
                found[i] = (n, 0)
        return [x or self.count(t) for x, t in zip(found, texts, strict=True)]


def _as_expected(model: dict) -> bool:
    pre = model.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers") or []
    level = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
    return level and model.get("normalizer") == EXPECTED["normalizer"] and steps[0] == EXPECTED["split"] and not model["model"].get("dropout")


def _lower(text: str) -> str:
    """One character at a time, as the library does; of plain texts Python's lower() treats only a final sigma otherwise."""
    return text.replace("Σ", "σ").lower()


def token_counts(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, chunk_chars: int = 16_384, overlap_chars: int = 512
) -> DataFrame:
    """Tokens of every whole text, with neither added special tokens nor truncation.

    Returns id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), n_widened (overlaps that had to grow). A null
    text counts as empty: 0 bytes, 0 tokens. Repeated rows stay repeated, null ids stay; other columns are not read. One
    narrow pass: no shuffle, and memory bounded by a batch, a chunk and the cache.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        model = f.read()
    table, plain = pretoken.classes("tokenizers"), pretoken.plain_characters()
    df = common.only(docs, id=id_col, text=text_col)
    id_type = df.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((model, table, plain, chunk_chars, overlap_chars))  # a vocabulary: some MB whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = common.kept("counter", shared.value, Counter)
        for batch in batches:
            sizes, tokens, grown = [], [], []
            for lo, hi, data, offsets in common.slices(batch.column(1)):
                raw = data.tobytes()
                for n, w in counter.count_all([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]):
                    tokens.append(n)
                    grown.append(w)
                sizes.extend(np.diff(offsets).tolist())
            n = pa.array(tokens, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), n, pa.array([t > limit for t in tokens]), pa.array(grown, pa.int64())], ["id", "n_bytes", "n_tokens", "over_limit", "n_widened"])

    return df.transform(common.arrow, run, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean, n_widened long").withColumnRenamed("id", id_col)
