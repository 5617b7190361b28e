"""BPE encoding and decoding through a table of distinct words.

A byte-pair tokenizer works on each pre-token (word) alone, so a word's ids are needed once in a corpus.

* Texts are split into words in tasks. A task writes blocks: about block_bytes of texts as a list of the block's distinct words
  and, for each document, the places of its words in that list. So a frequent word is one row of a block, not one of each place.
* (word, block, place) rows are dealt by word and sorted: the table of distinct words, with a word's rows one after the other.
  Each word is encoded once, with the library, and its ids go back with the rows.
* Ids are gathered by block (bounded by block_bytes). The blocks are a table bucketed by block, so that they meet their ids
  without being shuffled. Each document's ids are put together by the places of its words.
* Ids become text through the table (id, piece), as long as the tokenizer's vocabulary, which is broadcast and looked up for
  each distinct word of a block.

The split is the library's own: with its character classes for texts that normalisation only lower-cases one character at a
time, else after its normaliser; special strings are cut out first, as the library does, and are words of their own. Words are
encoded by the library's model without normaliser and split, since a normalised word need not stay as it is when normalised again.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuforge.llm import common, pretoken
from skuforge.llm.token_count import _as_expected, _lower

#: Text of a block, in bytes, about: its distinct words and places have to fit in a task.
BLOCK_BYTES = 32 << 20


def read_tokenizer(path: str) -> str:
    """The tokenizer's JSON. Raises where its normaliser, split, decoder or special tokens work in ways not provided for."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    model = json.loads(text)
    if not _as_expected(model) or model.get("decoder") is not None or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in model["added_tokens"]):
        raise ValueError(f"{path}: not a tokenizer of the kind that the word table handles")
    return text


class Splitter:
    """Words of whole texts as the tokenizer's normaliser and split leave them."""

    def __init__(self, tokenizer_json: str, table: bytes, plain: bytes):
        from tokenizers import Tokenizer

        self.normalizer = Tokenizer.from_str(tokenizer_json).normalizer
        special = sorted((t["content"] for t in json.loads(tokenizer_json)["added_tokens"]), key=len, reverse=True)
        self.special = set(special)
        self.cuts = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.table, self.plain = pretoken.unpacked(table), pretoken.unpacked(plain)

    def _plain(self, text: str) -> bool:
        return not any(s in text for s in self.special) and (text.isascii() or bool(self.plain[pretoken.code_points(text)].all()))

    def words(self, text: str) -> list[str]:
        """Of one text, whatever is in it."""
        found: list[str] = []
        for part in self.cuts.split(text) if self.cuts else [text]:
            if part in self.special:
                found.append(part)
            elif part:
                part = self.normalizer.normalize_str(part)
                found += pretoken.cut(part, *pretoken.dropped_pieces(part, self.table))
        return found

    def all_words(self, texts: list[str]) -> tuple[list[str], list[int]]:
        """(words of the texts one after the other, number of words of each); plain texts are split together."""
        plain = [self._plain(t) for t in texts]
        low = [_lower(t) for t, p in zip(texts, plain, strict=True) if p]
        starts, ends = pretoken.dropped_pieces(joined := "\n".join(low), self.table)
        at = np.searchsorted(starts, np.append(0, np.cumsum([len(t) + 1 for t in low]))).tolist()
        pieces, n = pretoken.cut(joined, starts, ends), 0
        if all(plain):
            return pieces, np.diff(at).tolist()
        found: list[str] = []
        counts = []
        for text, p in zip(texts, plain, strict=True):
            mine = pieces[at[n] : at[n + 1]] if p else self.words(text)
            n += p
            found += mine
            counts.append(len(mine))
        return found, counts


class _Block:
    """Texts as places in a list of distinct words."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.ids, self.counts, self.places, self.size = [], [], [], 0

    def add(self, ids: pa.Array, words: list[str], counts: list[int], size: int) -> None:
        for w in dict.fromkeys(words):
            self.index.setdefault(w, len(self.index))
        self.places.append(np.fromiter(map(self.index.__getitem__, words), "<u4", len(words)))
        self.ids.append(ids)
        self.counts += counts
        self.size += size

    def row(self, block: int) -> pa.RecordBatch:
        ids, places = pa.concat_arrays(self.ids), _packed(np.concatenate(self.places))
        columns = [pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([self.counts], pa.list_(pa.int32())), pa.array([list(self.index)], pa.list_(pa.string())), pa.array([places], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "ids", "counts", "words", "places"])


def _packed(places: np.ndarray) -> bytes:
    """32-bit numbers, their four bytes apart, compressed: the upper bytes are nearly always the same."""
    return pa.compress(np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, decompressed_size=4 * n, codec="zstd", asbytes=True) if n else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def split_blocks(docs: DataFrame, tokenizer_json: str, *, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, ids, counts (words of each document), words (distinct), places (each word's place in words, packed)."""
    df = common.only(docs, id=id_col, text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_json, pretoken.classes("tokenizers"), pretoken.plain_characters()))  # a vocabulary: some MB whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = common.kept("splitter", shared.value, Splitter)
        block, n = _Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi, data, offsets in common.slices(batch.column(1)):
                raw, ends = data.tobytes(), offsets.tolist()
                words, counts = splitter.all_words([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)])
                block.add(batch.column(0).slice(lo, hi - lo), words, counts, len(raw))
                if block.size >= block_bytes:
                    yield block.row(n)
                    block, n = _Block(), n + 1
        if block.ids:
            yield block.row(n)

    return df.transform(common.arrow, run, f"block long, ids array<{df.schema['id'].dataType.simpleString()}>, counts array<int>, words array<string>, places binary")


def bucketed(work: common.Workspace, blocks: DataFrame) -> DataFrame:
    """blocks as a table with a bucket for each shuffle partition, so that a join by block doesn't move them."""
    spark, name = work.spark, f"word_blocks_{uuid.uuid4().hex}"
    buckets = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000))
    blocks.write.bucketBy(buckets, "block").option("path", work.folder("blocks")).option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


def encode_words(pairs: DataFrame, tokenizer_json: str, width: str) -> DataFrame:
    """(block, place, tokens) of pairs(word, block, place) dealt by word and sorted: each distinct word's ids, as numbers of the
    given width, from the library's model alone. Only a word that goes on in the next batch is carried over."""
    model = json.loads(tokenizer_json)
    special = {t["content"]: [t["id"]] for t in model["added_tokens"]}
    model |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}
    shared = pairs.sparkSession.sparkContext.broadcast((json.dumps(model),))

    def load(text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(text)
        made.no_truncation()
        made.no_padding()
        return made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, last, kept = common.kept("word-tokenizer", shared.value, load), None, b""
        for batch in batches:
            encoded = batch.column(0).dictionary_encode()
            mine = encoded.dictionary.to_pylist()
            new = [w for w in mine if w != last]
            ids = {w: e.ids for w, e in zip(new, tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True)} | special
            raw = [kept if w == last else np.array(ids[w], width).tobytes() for w in mine]
            if mine:
                last, kept = mine[-1], raw[-1]
            tokens = pa.DictionaryArray.from_arrays(encoded.indices, pa.array(raw, pa.binary())).dictionary_decode()
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), tokens], ["block", "place", "tokens"])

    dealt = pairs.select("word", "block", "place").repartition("word").sortWithinPartitions("word")
    return dealt.transform(common.arrow, run, "block long, place int, tokens binary")


def vocabulary(tokenizer_json: str) -> list[str]:
    """The piece of each id."""
    model = json.loads(tokenizer_json)
    pieces = {i: p for p, i in model["model"]["vocab"].items()} | {t["id"]: t["content"] for t in model["added_tokens"]}
    return [pieces.get(i, "") for i in range(max(pieces, default=-1) + 1)]


def encode_and_decode(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, block_bytes: int = BLOCK_BYTES, work: common.Workspace | None = None) -> DataFrame:
    """id_col, n_tokens, token_ids and decoded of every whole text: the ids that the tokenizers library gives without begin, end or
    added special tokens, and the text that it decodes from them, special tokens included. With digests, instead of the last two
    their SHA-256: ids_sha256 (ids as little-endian unsigned 32-bit numbers) and decoded_sha256 (UTF-8).

    A null text counts as empty: no ids, an empty text. Repeated rows stay repeated, null ids stay, other columns aren't read.
    Raises for a tokenizer of another kind. What is gathered in a task is bounded by block_bytes, or by one text longer than that.
    """
    work = work or common.Workspace(docs.sparkSession, "word-table")
    tokenizer_json = read_tokenizer(tokenizer_path)
    blocks = bucketed(work, split_blocks(docs, tokenizer_json, id_col=id_col, text_col=text_col, block_bytes=block_bytes))
    pieces = vocabulary(tokenizer_json)
    width = "<u2" if len(pieces) <= 1 << 16 else "<u4"
    pairs = blocks.select("block", F.posexplode("words").alias("place", "word"))
    there = encode_words(pairs, tokenizer_json, width).groupBy("block").agg(F.collect_list(F.struct("place", "tokens")).alias("known"))
    whole = blocks.select("block", "ids", "counts", F.size("words").alias("n"), "places").join(there, "block", "left")
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # bounded by the tokenizer

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for r in range(rows.num_rows):
                yield from one(rows.slice(r, 1))

    def one(row: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, counts = row.column(0).flatten(), row.column(1)[0].values.to_numpy()
        n, known, pieces = row.column(2)[0].as_py(), row.column(4)[0].values, shared.value
        tokens, texts, sizes = [b""] * n, [""] * n, np.zeros(n, np.int64)
        if known is not None and len(known):
            places, raws = known.field(0).to_pylist(), known.field(1).to_pylist()
            ids_of = np.frombuffer(b"".join(raws), width)
            whole_ids, flat, at, each = ids_of.astype("<u4").tobytes(), [pieces[i] for i in ids_of.tolist()], 0, ids_of.itemsize
            for p, raw in zip(places, raws, strict=True):
                size = len(raw) // each
                tokens[p], texts[p], sizes[p] = whole_ids[4 * at : 4 * (at + size)], flat[at] if size == 1 else " ".join(flat[at : at + size]), size
                at += size
        ends = np.append(0, np.cumsum(counts)).tolist()
        places = _unpacked(row.column(3)[0].as_py(), ends[-1])
        for lo in range(0, len(ids), common.BATCH_ROWS):
            mine = ends[lo : lo + common.BATCH_ROWS + 1]
            made: list[list] = [[], [], []]
            for a, b in zip(mine[:-1], mine[1:], strict=True):
                of = places[a:b]
                made[0].append(int(sizes[of].sum()))
                of = of.tolist()
                raw, text = b"".join([tokens[p] for p in of]), " ".join([texts[p] for p in of])
                made[1].append(hashlib.sha256(raw).hexdigest() if digests else np.frombuffer(raw, "<u4").astype(np.int32))
                made[2].append(hashlib.sha256(text.encode()).hexdigest() if digests else text)
            columns = [ids.slice(lo, len(mine) - 1), pa.array(made[0], pa.int64()), pa.array(made[1], pa.string() if digests else pa.list_(pa.int32())), pa.array(made[2], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", *names])

    names, kinds = (("ids_sha256", "decoded_sha256"), ("string", "string")) if digests else (("token_ids", "decoded"), ("array<int>", "string"))
    out = f"id {id_type}, n_tokens long, {names[0]} {kinds[0]}, {names[1]} {kinds[1]}"
    return whole.select("ids", "counts", "n", "places", "known").transform(common.arrow, compose, out).withColumnRenamed("id", id_col)
