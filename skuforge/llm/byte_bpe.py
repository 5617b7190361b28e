"""Byte-level BPE: ids of whole texts from a rank file, and bytes and characters back from ids.

The tokenizers library does the merges. A rank file has no merge list, so the merges are recovered: a token of several bytes
came about by joining the two parts that the merges of lower rank leave of it. Bytes map to printable characters as usual
for byte-level BPE. Texts are split with numpy at the matches of the split pattern; in a worker, a pre-token seen before
takes its ids from a bounded store with the pre-token itself as key.

Decoding takes the vocabulary's characters for the ids and reverses the byte table, character by character; offsets tell
which characters of the text each token holds, also where a character's bytes are split over tokens.
"""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib
import json
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skuforge.llm import common, pretoken

#: Pre-tokens that a worker keeps with their ids and decimals (digests), and with their ids alone (encoding, also in a pipeline, whose
#: workers have little room).
CACHE, IDS_CACHE = 300_000, 100_000


@functools.lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    printable = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def _halves(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What merging pairs of lower rank than the token's own leaves of it."""
    parts, below = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], below))
        if ranks.get(parts[best] + parts[best + 1], below) >= below:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


def tokenizer_json(ranks: dict[bytes, int]) -> str:
    """A tokenizers model with these ranks as ids; it takes each text as one pre-token."""
    to = byte_characters()
    name = lambda token: "".join(to[b] for b in token)
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1 and len(parts := _halves(token, ranks)) == 2:
            merges.append([name(parts[0]), name(parts[1])])
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    model = {"type": "BPE", "vocab": {name(t): i for t, i in ranks.items()}, "merges": merges, "byte_fallback": False, "fuse_unk": False, "ignore_merges": False}
    return json.dumps({"version": "1.0", "added_tokens": [], "pre_tokenizer": level, "model": model})


def _ragged(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """flat[offsets[r]:offsets[r + 1]] for each r of rows, one after the other."""
    sizes = offsets[rows + 1] - offsets[rows]
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[rows] - (ends - sizes), sizes)]


#: Byte by the code of the character that stands for it: the byte table reversed.
_BYTE_OF = np.zeros(0x200, np.uint8)
_BYTE_OF[[ord(c) for c in byte_characters()]] = np.arange(256)


class Codec:
    """Encodes and decodes with a rank vocabulary."""

    def __init__(self, model: str, ranks: dict[bytes, int], table: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.table = Tokenizer.from_str(model), pretoken.unpacked(table)
        self.known, self.known_ids = pretoken.Known(CACHE), pretoken.Known(IDS_CACHE)
        size = max(ranks.values(), default=-1) + 1
        self.token = [b""] * size
        for token, i in ranks.items():
            self.token[i] = token
        to = byte_characters()
        #: the characters of each token in the vocabulary, one after the other, and where each token's begin
        self.characters = np.array([ord(to[b]) for token in self.token for b in token], np.uint16)
        self.offsets = np.append(0, np.cumsum([len(t) for t in self.token])).astype(np.int64)

    @classmethod
    def of(cls, path: str) -> Codec:
        ranks = read_ranks(path)
        return cls(tokenizer_json(ranks), ranks, pretoken.classes("tiktoken"))

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Each piece's ids, as the bytes of 32-bit numbers."""
        return [np.array(e.ids, np.int32).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _ids_and_decimals(self, pieces: list[str]) -> list[tuple[bytes, str]]:
        """Each piece's ids, as the bytes of 32-bit numbers and as decimals with a space after each."""
        return [(ids, "".join(f"{i} " for i in np.frombuffer(ids, np.int32).tolist())) for ids in self._ids(pieces)]

    def _pieces(self, text: str, known: pretoken.Known, make: Callable[[list[str]], Iterable]) -> list:
        starts = pretoken.spaced_pieces(text, self.table)
        return known.look_up(pretoken.cut(text, starts, np.append(starts[1:], len(text))), make) if len(starts) else []

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        return np.frombuffer(b"".join(self._pieces(text, self.known_ids, self._ids)), np.int32)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        return [self.encode(t) for t in texts]

    def encode_decimal(self, text: str) -> tuple[np.ndarray, str]:
        """Ids of a text, and the same as decimals with a space between."""
        pieces = self._pieces(text, self.known, self._ids_and_decimals)
        return np.frombuffer(b"".join([ids for ids, _ in pieces]), np.int32), "".join([x for _, x in pieces])[:-1]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The tokens' characters in the vocabulary, each turned back into the byte that it stands for."""
        return _BYTE_OF[_ragged(self.characters, self.offsets, np.asarray(ids, np.int64))].tobytes()

    def spans_of(self, ids: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        """First and last character (end exclusive) of each token of a text with these bytes, and the number of characters
        whose bytes are split over tokens. A token with a part of a character covers that character."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ids, ids, 0
        lead = np.append((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, True)
        before = np.append(0, np.cumsum(lead[:-1]))
        ends = np.cumsum(self.offsets[ids + 1] - self.offsets[ids])
        starts = np.append(0, ends[:-1])
        first = before[starts] - ~lead[starts]
        inside = ~lead[starts]
        return first, before[ends], len(np.unique(first[inside]))

    def offsets_of(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """First and last character of each token, end exclusive."""
        first, last, _ = self.spans_of(ids, self.decode_bytes(ids))
        return list(zip(first.tolist(), last.tolist(), strict=True))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text token by token; the bytes of a character split over tokens are held back until it is whole."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield decoder.decode(self.decode_bytes(np.array([i])))
        yield decoder.decode(b"", True)


def _shared(df: DataFrame, rank_path: str):
    """Model, ranks and character classes: some MB whatever the input."""
    ranks = read_ranks(rank_path)
    return df.sparkSession.sparkContext.broadcast((tokenizer_json(ranks), ranks, pretoken.classes("tiktoken")))


def _texts(column: pa.Array) -> Iterator[list[str]]:
    for _, _, data, offsets in common.slices(column):
        raw = data.tobytes()
        yield [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def encode(docs: DataFrame, rank_path: str, *, text_col: str = "text", ids_col: str = "token_ids", n_col: str = "n_tokens") -> DataFrame:
    """docs with the ids of every whole text and their number. A null text counts as empty: no ids.

    Columns of those names are replaced; others pass through. One narrow pass.
    """
    shared = _shared(docs, rank_path)
    keep = [c for c in docs.columns if c.lower() not in (ids_col.lower(), n_col.lower())]
    text, df = common.free_name(docs, "text_to_encode"), docs
    df = docs.select(*(f"`{c}`" for c in keep), docs[f"`{text_col}`"].alias(text))
    fields = [df.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = common.kept("codec", shared.value, Codec)
        for batch in batches:
            ids = [x for texts in _texts(batch.column(len(keep))) for x in codec.encode_all(texts)]
            ends = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array(np.diff(ends).astype(np.int64), pa.int64())], [*keep, ids_col, n_col])

    from pyspark.sql import types as T

    return df.transform(common.arrow, run, T.StructType([*fields, T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(n_col, T.LongType())]))


def decode(docs: DataFrame, rank_path: str, *, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """docs with the text of the ids; bytes that aren't UTF-8 become U+FFFD. Null ids give null."""
    from pyspark.sql import types as T

    shared = _shared(docs, rank_path)
    keep = [c for c in docs.columns if c.lower() != text_col.lower()]
    df = docs.select(*(f"`{c}`" for c in keep))
    at = keep.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = common.kept("codec", shared.value, Codec)
        for batch in batches:
            texts = [None if x is None else codec.decode_bytes(np.array(x, np.int64)).decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*keep, text_col])

    return df.transform(common.arrow, run, T.StructType([*(df.schema[c] for c in keep), T.StructField(text_col, T.StringType())]))


def round_trip(docs: DataFrame, rank_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, decodes the ids, and returns id_col, n_tokens, ids_sha256 (of decimal ids joined by a space),
    decoded_sha256 (of the decoded bytes), n_split (characters whose bytes are split over tokens), offsets_sha256 (of each
    token's first and last character, end exclusive, as little-endian 64-bit numbers) and intact (the decoded bytes are the text's).

    A null text counts as empty: no ids, digests of nothing. Repeated rows and null ids stay; other columns aren't read.
    """
    shared = _shared(docs, rank_path)
    df = common.only(docs, id=id_col, text=text_col)
    digest = lambda raw: hashlib.sha256(raw).hexdigest()

    def one(codec: Codec, text: str) -> tuple:
        ids, decimal = codec.encode_decimal(text)
        raw = codec.decode_bytes(ids)
        first, last, split = codec.spans_of(ids, raw)
        spans = np.stack([first, last], axis=1).astype("<i8").tobytes()
        return len(ids), digest(decimal.encode()), digest(raw), split, digest(spans), raw == text.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = common.kept("codec", shared.value, Codec)
        for batch in batches:
            made = [one(codec, text) for texts in _texts(batch.column(1)) for text in texts]
            columns = [pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *names])

    names = ("n_tokens", "ids_sha256", "decoded_sha256", "n_split", "offsets_sha256", "intact")
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_())
    out = f"id {df.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long, offsets_sha256 string, intact boolean"
    return df.transform(common.arrow, run, out).withColumnRenamed("id", id_col)
