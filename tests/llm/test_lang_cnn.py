import zlib

import numpy as np

from skuforge.llm import common, lang_cnn
from skuforge.llm.query import op05


def test_windows_cover_whole_texts():
    texts = [b"abcdefg", b"", b"xy", b"0123"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    x, text, used = lang_cnn.windows(data, offsets, 4)
    assert [bytes(w) for w in x] == [b"abcd", b"efg\0", b"xy\0\0", b"0123"]
    assert text.tolist() == [0, 0, 2, 3] and used.tolist() == [4, 3, 2, 4]


def test_paired_tables_give_the_same_responses():
    net = lang_cnn.ByteCNN(["a", "b"], filters=3, length=20)
    x = np.random.default_rng(1).integers(0, 256, (5, 20)).astype(np.uint8)
    both = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
    for k in net.widths:
        slow = net._responses(x, k)
        assert np.allclose(slow, net._fast_responses(x, both, k), atol=1e-5)
        assert np.array_equal(lang_cnn._max_over(slow.copy()), slow.max(1))


def test_held_out_accuracy_and_odd_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = op05.run(spark, sf).toPandas()
    docs = common.table(spark, sf, "documents").toPandas()
    assert len(out) == len(docs) and (out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]).all()
    both = out[out.held_out].merge(docs, on="doc_id")
    assert (both.lang_pred == both.lang).mean() > 0.95 and out.score.between(0, 1).all()
    rows = [(1, None, "en", 1), (2, "", "en", 2), (3, "12 34 !", "fr", 3), (None, "words", None, 4), (5, "le mot", "fr", 5), (5, "le mot", "fr", 5), (6, "the word " * 200_000, "en", 6)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = lang_cnn.train(odd)
    got = {r.doc_id: r.lang_pred for r in lang_cnn.predict(odd, model).collect()}
    assert [got[i] for i in (1, 2, 3)] == ["und"] * 3 and got[None] in ("en", "fr") and got[6] == "en"
    assert lang_cnn.train(odd.limit(0)) is None
    assert {r.lang_pred for r in lang_cnn.predict(odd, None).collect()} == {"und"}
    assert lang_cnn.predict(odd.limit(0), model).count() == 0


def test_the_sample_is_bounded_by_rows_and_by_windows_and_rows_stay_whole(spark, monkeypatch):
    seen = {}

    def fit(self, x, y, **_):
        seen["windows"] = {self.languages[k]: int((y == k).sum()) for k in range(len(self.languages))}
        return self

    monkeypatch.setattr(lang_cnn.ByteCNN, "fit", fit)
    rows = [(i, "a" * 256 * (1 + i % 3), "en") for i in range(60)] + [(100 + i, "b" * 256 * 50, "fr") for i in range(3)] + [(200, "c" * 256 * 40, "de"), (201, "d" * 10, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lang_cnn.train(docs, per_language=400, windows_per_language=30)
    assert 30 <= seen["windows"]["en"] < 33 and seen["windows"]["fr"] == 50 and seen["windows"]["de"] == 41
    lang_cnn.train(docs, per_language=5, windows_per_language=3000)
    assert 5 <= seen["windows"]["en"] <= 15 and seen["windows"]["fr"] == 150
