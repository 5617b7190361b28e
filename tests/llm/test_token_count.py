import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skuforge.llm import pretoken
from skuforge.llm.token_count import Counter, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "a", "B", "É", "é", "́", "1", "23", "!", "...", "漢字", "<|endoftext|>", "<|startoftext|>", "<|end", "İ", "Σ", "ß", "J̌", " ", "😀", "한", "²", "_"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("chunk,overlap", [(40, 8), (16_384, 512)])
def test_spliced_chunks_count_as_the_library(tokenizer, chunk, overlap):
    draw = random.Random(1)
    counter = Counter(tokenizer.to_str(), pretoken.classes("tokenizers"), pretoken.plain_characters(), chunk, overlap)
    texts = ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 150))) for _ in range(800)]
    want = [len(e) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [n for n, _ in counter.count_all(texts)] == want
    assert [counter.count(t)[0] for t in texts] == want


def test_an_overlap_without_a_boundary_widens(tokenizer):
    counter = Counter(tokenizer.to_str(), pretoken.classes("tokenizers"), pretoken.plain_characters(), 256, 64)
    text = "ab cd " * 50 + "x" * 3000 + " tail words here" * 40
    n, widened = counter.count(text)
    assert n == len(tokenizer.encode(text, add_special_tokens=False)) and widened


def test_nulls_empty_repeated_rows_and_clashing_columns(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "Hello, World's", "z"), (3, "a " * 3000, "z"), (3, "a " * 3000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((tuple(r)[:4] for r in token_counts(docs, PATH).collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (None, 14, 4, False), (3, 6000, 3000, True), (3, 6000, 3000, True)], key=str)
    assert token_counts(docs.limit(0), PATH).count() == 0


def test_look_alikes_of_a_polynomial_hash_and_other_tokenizer_files(spark, tokenizer):
    a = "".join("ab"[i.bit_count() & 1] for i in range(1 << 10))
    texts = [a, a.translate(str.maketrans("ab", "ba")), f"{a} x", "It's 12 CAFÉS"]
    counter = Counter(tokenizer.to_str(), pretoken.classes("tokenizers"), pretoken.plain_characters(), 16_384, 512)
    assert counter.cached and [n for n, _ in counter.count_all(texts)] == [len(tokenizer.encode(t, add_special_tokens=False)) for t in texts]
    from tokenizers import Regex, Tokenizer, pre_tokenizers

    other = Tokenizer.from_str(tokenizer.to_str())
    other.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(r"\S+"), "removed", invert=True), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    counter = Counter(other.to_str(), pretoken.classes("tokenizers"), pretoken.plain_characters(), 16_384, 512)
    assert not counter.cached and [n for n, _ in counter.count_all(texts)] == [len(other.encode(t, add_special_tokens=False)) for t in texts]


def test_huge_texts_go_through_the_library_in_overlapping_chunks(tokenizer):
    draw = random.Random(5)
    text = "".join(draw.choice(ALPHABET + ["word ", "Another ", "naïve "] * 6) for _ in range(30_000))
    counter = Counter(tokenizer.to_str(), pretoken.classes("tokenizers"), pretoken.plain_characters(), 16_384, 512)
    assert len(text) > 3 * 16_384 and counter.count_all([text])[0][0] == len(tokenizer.encode(text, add_special_tokens=False))
