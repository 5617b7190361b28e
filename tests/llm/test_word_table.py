import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skuforge.llm.query import op12
from skuforge.llm.word_table import encode_and_decode, read_tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, Block int"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def test_random_texts_equal_the_library(spark, library):
    draw = random.Random(7)
    parts = ["Hello", " ", "  ", "\n", "world's", "don't", "I'LL", "''s", "42", "٣", "½", "é", "é", "J̌", "İ", "ΑΣ", "ß", "가", "한", "漢字", "!?", "…", " ", "　", "\U0001f600", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|endof", "text|>", "K", "ﬁ", "x" * 40, "\x00", "‍", "'re", "’s"]
    rows = [(i, "".join(draw.choice(parts) for _ in range(draw.randrange(0, 25)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "   "), (None, "a b"), (None, None), (5, "again"), (5, "again"), (1003, "ab " * 60_000), (1004, "z" * 50_000)]
    for size in (1 << 20, 300):
        got = sorted(((r.doc_id, r.n_tokens, r.token_ids, r.decoded) for r in encode_and_decode(frame(spark, rows), PATH, block_bytes=size).collect()), key=repr)
        assert got == sorted(((i, len(w[0]), *w) for i, t in rows for w in [want(library, t)]), key=repr)


def test_digests_and_an_empty_table(spark, library):
    rows = [(1, "Some text, 2 lines\nof it"), (2, None)]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_and_decode(frame(spark, rows), PATH, digests=True).collect()}
    for i, t in rows:
        ids, text = want(library, t)
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert encode_and_decode(frame(spark, []), PATH).count() == 0


def test_query_equals_the_library_on_all_documents(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in op12.run(spark, sf).collect())
    made = ((d.doc_id, *want(library, d.text)) for d in docs)
    assert got == sorted((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) for i, ids, text in made)


def test_a_tokenizer_of_another_kind_is_refused(tmp_path):
    with pytest.raises(ValueError):
        read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    model = json.load(open(PATH))
    model["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(model))
    with pytest.raises(ValueError):
        read_tokenizer(str(tmp_path / "t.json"))


def test_a_worker_keeps_a_store_until_a_task_without_it():
    from skuforge.llm import common

    source = (1,)
    common.begin()
    first = common.kept("thing", source, lambda x: [x])
    common.release()
    common.begin()
    assert common.kept("thing", source, lambda x: [x]) is first
    common.release()
    common.begin()
    common.release()  # a task of another stage
    common.begin()
    assert common.kept("thing", source, lambda x: [x]) is not first
    common.begin()
    common.release()
    assert "thing" not in common._KEPT
