import zlib

import numpy as np
import pyarrow as pa

from skuforge.llm import common, quality_fm
from skuforge.llm.query import op07


def featurise(texts, buckets=1 << 15):
    (_, _, data, offsets), = list(common.slices(pa.array(texts), 1 << 30))
    return quality_fm.features(data, offsets, buckets)


def test_linear_time_form_equals_all_pairs():
    model = quality_fm.FactorisationMachine(64, 3, seed=1)
    model.w = np.random.default_rng(2).normal(size=model.w.shape)
    model.v = np.random.default_rng(3).normal(size=model.v.shape)
    at, bucket, value, stats = featurise(["a b c a", "", "x"], 64)
    got = model.score(at, bucket, value, stats)
    a, b, v = model._all(at, bucket, value, stats)
    for t in range(3):
        i, x = b[a == t], v[a == t]
        raw = model.w0 + (model.w[i] * x).sum() + sum(model.v[i[p]] @ model.v[i[q]] * x[p] * x[q] for p in range(len(i)) for q in range(p))
        assert abs(got[t] - 1 / (1 + np.exp(-np.clip(raw, -30, 30)))) < 1e-9


def test_slices_do_not_change_features():
    texts = ["One two, two!", "", "###\nline\nline\n", "é " * 50, "z"]
    whole = featurise(texts)
    for t, text in enumerate(texts):
        alone = featurise([text])
        assert np.allclose(alone[3][0], whole[3][t])
        assert np.array_equal(alone[1], whole[1][whole[0] == t]) and np.allclose(alone[2], whole[2][whole[0] == t])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = op07.run(spark, sf).toPandas()
    docs = common.table(spark, sf, "documents")
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    both = out[out.held_out].merge(common.table(spark, sf, "labels").toPandas(), on="doc_id")
    assert (both.predicted == both.quality).mean() > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "s"), (None, "", "s"), (2, "word " * 30_000, "s"), (2, "word", "s"), (2, "word", "s")], "doc_id long, text string, Score string")
    labels = spark.createDataFrame([(2, 1), (2, 0), (None, 1), (3, None), (1, 7)], "doc_id long, quality int")
    model = quality_fm.train(docs, labels, buckets=256)
    out = quality_fm.scores(docs, model)
    assert out.columns == ["doc_id", "text", "score"] and out.filter("score between 0 and 1").count() == 5
    blank = quality_fm.train(docs, labels.limit(0))
    assert all(abs(r.score - 0.5) < 0.01 for r in quality_fm.scores(docs, blank).collect())
    assert quality_fm.scores(docs.limit(0), model).count() == 0
