"""Quality classifier: a factorisation machine over hashed words, structure statistics and length.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairs of features interact
through k factors each, in time linear in the features. x has, for each text, the counts of words by bucket at unit length,
and standardised statistics. The model is trained with numpy on a bounded sample of labelled rows; every whole text is
scored in one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuforge.llm import common

STATISTICS = ("log_bytes", "log_words", "upper", "digit", "punctuation", "space", "line", "not_ascii", "symbols_in_words", "word_length", "distinct_words", "repeated_lines", "top_word", "pair_punctuation", "empty")


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.append(0, np.cumsum(flags, dtype=np.int64))
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.float64)


_KIND = np.zeros(256, np.uint8)
_KIND[65:91], _KIND[48:58], _KIND[[32, 9, 13]], _KIND[10], _KIND[128:] = 1, 2, 4, 5, 6
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 3
_LINES = common.byte_table(lambda b: b == 10)


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of each text's words, and its statistics."""
    n = len(offsets) - 1
    hashes, starts, ends = common.words(data, offsets, common.SPACED)
    text = np.searchsorted(offsets, starts, "right") - 1
    width = np.uint64(buckets)
    keys, counts = np.unique(text.astype(np.uint64) * width + hashes % width, return_counts=True)
    at, bucket = (keys // width).astype(np.int64), (keys % width).astype(np.int64)
    norm = np.sqrt(np.bincount(at, counts.astype(np.float64) ** 2, n))
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    n_words = np.bincount(text, minlength=n).astype(np.float64)
    some = np.maximum(n_words, 1)
    kind = _KIND[data]
    lines, l_starts, _ = common.words(data, offsets, _LINES)
    l_text = np.searchsorted(offsets, l_starts, "right") - 1
    l_keys = np.unique(np.stack([l_text.astype(np.uint64), lines]), axis=1) if len(lines) else np.zeros((2, 0), np.uint64)
    n_lines = np.maximum(np.bincount(l_text, minlength=n), 1)
    top = np.zeros(n)
    np.maximum.at(top, at, counts)
    twice = np.zeros(len(data), bool)
    twice[1:] = (kind[1:] == 3) & (kind[:-1] == 3)
    twice[offsets[:-1][offsets[:-1] < len(data)]] = False
    mark = np.append(0, np.cumsum(kind == 3))
    marked = np.bincount(text, (mark[np.maximum(ends - 1, 0)] - mark[starts]) > 0, n) if len(starts) else np.zeros(n)
    share = lambda k: _per_text(kind == k, offsets) / size
    stats = np.stack([
        np.log1p(np.diff(offsets)), np.log1p(n_words), share(1), share(2), share(3), share(4), share(5), share(6), marked / some,
        np.bincount(text, ends - starts, n) / some, np.bincount(at, minlength=n) / some, 1 - np.bincount(l_keys[0].astype(np.int64), minlength=n) / n_lines, top / some, _per_text(twice, offsets) / size, n_words == 0,
    ], axis=1)
    return at, bucket, counts / np.maximum(norm[at], 1e-12), stats


class FactorisationMachine:
    def __init__(self, buckets: int, factors: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.buckets, size = buckets, buckets + len(STATISTICS)
        self.w0, self.w, self.v = 0.0, np.zeros(size), rng.normal(0, 0.01, (size, factors))
        self.mean, self.std = np.zeros(len(STATISTICS)), np.ones(len(STATISTICS))

    def _all(self, at, bucket, value, stats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, m = stats.shape
        dense = np.clip((stats - self.mean) / self.std, -5, 5) / np.sqrt(m)
        return np.append(at, np.repeat(np.arange(n), m)), np.append(bucket, np.tile(np.arange(m) + self.buckets, n)), np.append(value, dense.ravel())

    def _raw(self, n, at, bucket, value) -> tuple[np.ndarray, np.ndarray]:
        """Linear in the features: the sum of squares is taken from the square of the sum."""
        linear = np.bincount(at, self.w[bucket] * value, n)
        sums, squares = np.zeros((n, self.v.shape[1])), np.zeros(n)
        for f in range(self.v.shape[1]):
            vx = self.v[bucket, f] * value
            sums[:, f] = np.bincount(at, vx, n)
            squares += np.bincount(at, vx * vx, n)
        return self.w0 + linear + ((sums**2).sum(1) - squares) / 2, sums

    def score(self, at, bucket, value, stats) -> np.ndarray:
        raw, _ = self._raw(len(stats), *self._all(at, bucket, value, stats))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], epochs: int = 12, batch: int = 64, rate: float = 0.1, decay: float = 1e-3, seed: int = 0) -> FactorisationMachine:
        """rows: buckets, values, statistics, label. Logistic loss, AdaGrad over the features of each batch."""
        rng = np.random.default_rng(seed)
        stats = np.array([r[2] for r in rows])
        self.mean, self.std = stats.mean(0), np.maximum(stats.std(0), 1e-6)
        y = np.array([r[3] for r in rows], float)
        self.w0 = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        g0, gw, gv = 1e-6, np.full(self.w.shape, 1e-6), np.full(self.v.shape, 1e-6)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), batch):
                part = [rows[i] for i in order[lo : lo + batch]]
                at = np.repeat(np.arange(len(part)), [len(r[0]) for r in part])
                at, bucket, value = self._all(at, np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part]), np.array([r[2] for r in part]))
                raw, sums = self._raw(len(part), at, bucket, value)
                miss = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - np.array([r[3] for r in part])
                used, where = np.unique(bucket, return_inverse=True)
                m = miss[at] * value
                dw = np.bincount(where, m, len(used)) / len(part) + decay * self.w[used]
                d0 = miss.mean()
                g0 += d0 * d0
                self.w0 -= rate * d0 / np.sqrt(g0)
                gw[used] += dw * dw
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                for f in range(self.v.shape[1]):
                    v = self.v[bucket, f]
                    dv = np.bincount(where, m * (sums[at, f] - v * value), len(used)) / len(part) + decay * self.v[used, f]
                    gv[used, f] += dv * dv
                    self.v[used, f] -= rate / 2 * dv / np.sqrt(gv[used, f])
        return self


def _featured(docs: DataFrame, buckets: int) -> DataFrame:
    """docs(label, text, at, id) as label, at, id and the bytes of buckets (int32), values (float32) and statistics (float64)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lo, hi, data, offsets in common.slices(batch.column(1)):
                at, bucket, value, stats = features(data, offsets, buckets)
                cut = np.searchsorted(at, np.arange(hi - lo + 1))
                rows += [(bucket[a:b].astype(np.int32).tobytes(), value[a:b].astype(np.float32).tobytes(), s.tobytes()) for a, b, s in zip(cut[:-1], cut[1:], stats, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(3))], ["label", "at", "id", "buckets", "values", "statistics"])

    return docs.transform(common.arrow, run, f"label int, at long, id {docs.schema['id'].dataType.simpleString()}, buckets binary, values binary, statistics binary")


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 6000, buckets: int = 1 << 15, factors: int = 4) -> FactorisationMachine:
    """A model from sample_rows labelled rows at most, the first by a hash of the id: the bound holds at any size.

    Labels other than 0 and 1, and null ids, aren't used. Without any labelled row the score is 1/2.
    """
    known = common.only(labels, label_id=id_col, label=label_col).filter("label_id is not null and label in (0, 1)")
    some = known.orderBy(F.xxhash64("label_id"), "label_id", "label").limit(sample_rows).select("label_id", F.col("label").cast("int").alias("label"))
    rows = common.only(docs, id=id_col, text=text_col).join(F.broadcast(some), F.col("id") == F.col("label_id")).select("label", "text", F.xxhash64("id").alias("at"), "id")
    # features are made where the texts are; of an id on several rows the limit takes the first by features
    some = _featured(rows, buckets).orderBy("at", "id", "label", "buckets", "statistics").limit(sample_rows)
    data = [(np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["values"], np.float32), np.frombuffer(r["statistics"]), r["label"]) for r in some.toLocalIterator()]
    model = FactorisationMachine(buckets, factors)
    if data:
        model.fit(data)
    del data
    common.release()
    return model


def scores(docs: DataFrame, model: FactorisationMachine, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col in 0 to 1 for every whole text; a null text counts as empty. Rows and other columns stay; no shuffle."""
    from pyspark.sql import types as T

    keep = [c for c in docs.columns if c.lower() != score_col.lower()]
    df = docs.select(*(f"`{c}`" for c in keep))
    at = [c.lower() for c in keep].index(text_col.lower())
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x (factors + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.score(*features(data, offsets, shared.value.buckets)) for _, _, data, offsets in common.slices(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else [], pa.float64())], [*keep, score_col])

    return df.transform(common.arrow, run, T.StructType([*(df.schema[c] for c in keep), T.StructField(score_col, T.DoubleType())]))


def held_out(id_col: str, folds: int, fold: int):
    """Whether the id's CRC-32 as text has that remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
