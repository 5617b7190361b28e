"""Splits text the way byte-pair tokenizers do, with numpy, and tells how Unicode characters count for that.

The classes come from the tokenizer libraries themselves (their Unicode tables differ from Python's at times), so a split
made here is the split that the library makes.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib
from collections.abc import Callable, Iterable

import numpy as np

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Unicode's planes without surrogates, which UTF-8 can't hold.
_ALL = 0x110000
_CONTRACTIONS = {"s": 2, "t": 2, "m": 2, "d": 2}
_CONTRACTIONS_2 = {"re": 3, "ve": 3, "ll": 3}


def _everything() -> str:
    return "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, _ALL)))


@functools.lru_cache(maxsize=2)
def classes(library: str) -> bytes:
    """Letter, number, white space or other for each code point as `tokenizers` or `tiktoken` sees it, compressed."""
    table, text = np.zeros(_ALL, np.uint8), _everything()
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        if library == "tiktoken":
            import tiktoken

            plain = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
            found = bytes(plain.encode_ordinary(text)).decode("utf-8")
            table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
        else:
            from tokenizers import Regex, pre_tokenizers

            split = pre_tokenizers.Split(Regex(f"{pattern}+"), "removed", invert=True)
            for piece, _ in split.pre_tokenize_str(text):
                table[np.frombuffer(piece.encode("utf-32-le"), np.uint32)] = kind
    return zlib.compress(table.tobytes(), 6)


@functools.lru_cache(maxsize=1)
def plain_characters() -> bytes:
    """1 for code points that composition (NFC) never changes, joins or reorders, and that lower-case to one character."""
    table = np.ones(_ALL, np.uint8)
    table[0xD800:0xE000] = 0
    second = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    for c in range(_ALL):
        if (parts := unicodedata.decomposition(chr(c))) and parts[0] != "<" and len(parts := parts.split()) == 2:
            second.add(int(parts[1], 16))
    for c in range(0x80, _ALL):
        if not 0xD800 <= c < 0xE000:
            x = chr(c)
            if unicodedata.combining(x) or len(x.lower()) != 1 or not unicodedata.is_normalized("NFC", x):
                table[c] = 0
    table[list(second)] = 0
    return zlib.compress(table.tobytes(), 6)


@functools.lru_cache(maxsize=4)
def unpacked(table: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(table), np.uint8)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _contract(start: np.ndarray, kind: np.ndarray, chars: np.ndarray, text: str) -> None:
    """Where a piece starts with an apostrophe and s, t, re, ve, m, ll or d follow, they are one piece."""
    at = np.flatnonzero(chars[:-1] == 39)
    for i in at[start[at] & (kind[at + 1] == LETTER)].tolist():
        k = _CONTRACTIONS.get(text[i + 1]) or _CONTRACTIONS_2.get(text[i + 1 : i + 3])
        if k:
            start[i + 1 : i + k] = False
            if i + k < len(start) and kind[i + k] == LETTER:
                start[i + k] = True


def spaced_pieces(text: str, table: np.ndarray) -> np.ndarray:
    r"""Starts of the matches of 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+ ; they cover text."""
    if not text:
        return np.zeros(0, np.int64)
    chars = code_points(text)
    kind = table[chars]
    start = np.ones(len(kind), bool)
    start[1:] = kind[1:] != kind[:-1]
    before = np.flatnonzero(start[1:] & (kind[:-1] == SPACE))  # the last white space before something else
    start[before] = True
    start[before + 1] = chars[before] != 32
    _contract(start, kind, chars, text)
    return np.flatnonzero(start)


def dropped_pieces(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r"""Starts and ends of the matches of 's|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+ ; white space lies between."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    chars = code_points(text)
    kind = table[chars]
    start = np.ones(len(kind), bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= kind == NUMBER
    _contract(start, kind, chars, text)
    at = np.flatnonzero(start)
    ends = np.append(at[1:], len(kind))
    keep = kind[at] != SPACE
    return at[keep], ends[keep]


class Known:
    """What a worker has worked out for pre-tokens, by the pre-token itself; bounded in number and characters, emptied when full."""

    def __init__(self, limit: int, characters: int = 1 << 24):
        self.limit, self.characters = limit, characters
        self.values: dict[str, object] = {}
        self.size = 0

    def look_up(self, pieces: list[str], make: Callable[[list[str]], Iterable]) -> list:
        """A value for each piece. make: values of a list of distinct pieces, in order."""
        if len(self.values) > self.limit or self.size > self.characters:
            self.values.clear()
            self.size = 0
        found = list(map(self.values.get, pieces))
        if None in found:
            new = list(dict.fromkeys(p for p, v in zip(pieces, found, strict=True) if v is None))
            self.values.update(zip(new, make(new), strict=True))
            self.size += sum(map(len, new))
            found = list(map(self.values.__getitem__, pieces))
        return found


def cut(text: str, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    return [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
