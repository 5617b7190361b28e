import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from skuforge.llm.byte_bpe import Codec, decode, encode, read_ranks, round_trip

PATH = P.path("byte_bpe_50k.tiktoken")
ALPHABET = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "   ", "\n", "\t ", "a", "B", "é", "́", "12", "3", "!", "...", "漢字", "<|endoftext|>", " ", "　", "😀", "한", "²", "_", "\r\n", "the", " of"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return Codec.of(PATH)


def test_ids_are_those_of_the_library(codec, library):
    draw = random.Random(2)
    texts = ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 80))) for _ in range(2500)]
    texts += ["'" * 7, "a" * 5000, " " * 3000, "x'" * 500, ""]
    for text, ids in zip(texts, codec.encode_all(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text), repr(text)
        assert codec.decode_bytes(ids) == text.encode()
        assert "".join(codec.decode_stream(ids.tolist())) == text


def test_offsets_cover_split_characters(codec):
    text = "né 😀漢"
    ids = codec.encode(text)
    at, spans = 0, codec.offsets_of(ids)
    for i, (a, b) in zip(ids.tolist(), spans, strict=True):
        to = at + len(codec.token[i])
        assert len(text.encode()[:at].decode("utf-8", "ignore")) == a and b == len(text.encode()[:to].decode("utf-8", "ignore")) or b > a
        at = to
    assert spans[0][0] == 0 and spans[-1][1] == len(text)


def test_tables(spark):
    rows = [(1, None, 5), (2, "", 6), (None, "Two words, it's 12.", 7), (3, "x", 1), (3, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_tokens, r.decoded_sha256, r.intact) for r in round_trip(docs, PATH).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {(1, 0, digest(""), True), (2, 0, digest(""), True), (None, 7, digest("Two words, it's 12."), True), (3, 1, digest("x"), True)}
    there = encode(docs, PATH)
    assert there.columns == ["doc_id", "text", "token_ids", "n_tokens"]
    back = decode(there, PATH).collect()
    assert all((r.text or "") == r.decoded for r in back) and len(back) == 5
    assert round_trip(docs.limit(0), PATH).count() == 0


def _thue_morse(n: int) -> str:
    return "".join("ab"[i.bit_count() & 1] for i in range(1 << n))


def test_look_alikes_of_a_polynomial_hash_keep_their_own_ids(codec, library):
    a = _thue_morse(10)
    b = a.translate(str.maketrans("ab", "ba"))
    for texts in ([a, b], [b, a], [f"{a} {b} {a}"]):
        for text, ids in zip(texts, codec.encode_all(texts), strict=True):
            assert ids.tolist() == library.encode_ordinary(text)
            assert codec.decode_bytes(ids) == text.encode()


def test_offsets_and_split_characters_of_whole_texts(spark, codec):
    texts = ["né 😀漢 한글 ²", "", "plain words", "😀" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in round_trip(docs, PATH).collect():
        ids = codec.encode(texts[r.doc_id])
        spans, at, split = [], 0, set()
        raw = texts[r.doc_id].encode()
        where = [i for i, c in enumerate(texts[r.doc_id]) for _ in c.encode()]
        for i in ids.tolist():
            to = at + len(codec.token[i])
            spans.append((where[at], where[to - 1] + 1))
            if at and where[at] == where[at - 1]:
                split.add(where[at])
            at = to
        assert at == len(raw) and r.n_split == len(split) and codec.offsets_of(ids) == spans
        assert r.offsets_sha256 == hashlib.sha256(b"".join(x.to_bytes(8, "little") for s in spans for x in s)).hexdigest()


def test_encoding_keeps_ids_alone(monkeypatch):
    monkeypatch.setattr("skuforge.llm.byte_bpe.IDS_CACHE", 5)
    codec = Codec.of(P.path("byte_bpe_50k.tiktoken"))
    text = " ".join(f"word{i} ünd 日本" for i in range(40))
    assert all(codec.encode(text).tolist() == codec.encode_decimal(text)[0].tolist() for _ in range(3))
    assert codec.encode_decimal(text)[1] == " ".join(map(str, codec.encode(text).tolist()))
    assert all(isinstance(v, bytes) for v in codec.known_ids.values.values()) and codec.known_ids.limit == 5


def test_stores_of_another_stage_go_before_a_new_one_is_made(monkeypatch):
    from skuforge.llm import common

    monkeypatch.setattr(common, "_KEPT", {})
    old, new = ("old",), ("new",)
    common.begin()
    common.kept("before", old, str)
    common.begin()
    held = []
    common.kept("now", new, lambda x: held.extend(common._KEPT))
    assert held == []
