"""Language identification with a byte convolutional network in numpy.

A text's UTF-8 bytes are cut into windows of fixed length (the last one padded). Filters of several widths go over each
window's bytes, each filter's largest response over the window is kept (max pooling), and a softmax layer turns these into
probabilities. A text's probabilities are the mean over its windows, each weighted by its bytes, over the whole text.

A filter of width k over one-hot bytes is k tables of 256 weights; for prediction, the tables of two neighbouring bytes are
added up beforehand, so that a response takes one look-up for each pair of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuforge.llm import common

PAD = 0
#: Parts in which a language's rows are chosen first.
PARTS = 64


def windows(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows x length bytes, text of each, bytes in each) of texts one after the other; an empty text has no window."""
    sizes = np.diff(offsets)
    n = -(-sizes // length)
    text = np.repeat(np.arange(len(sizes)), n)
    part = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[text] + part * length
    used = np.minimum(length, offsets[text + 1] - start)
    at = start[:, None] + np.arange(length)
    out = np.append(data, np.zeros(length, np.uint8))[np.minimum(at, len(data))]
    out[np.arange(length) >= used[:, None]] = PAD
    return out, text, used


def _max_over(x: np.ndarray) -> np.ndarray:
    """Largest over axis 1, by halves."""
    while (n := x.shape[1]) > 1:
        half = n // 2
        y = np.maximum(x[:, :half], x[:, half : 2 * half])
        if n % 2:
            np.maximum(y[:, 0], x[:, -1], out=y[:, 0])
        x = y
    return x[:, 0]


class ByteCNN:
    def __init__(self, languages: list[str], widths: tuple[int, ...] = (2, 3, 4), filters: int = 16, length: int = 256, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages, self.widths, self.filters, self.length = languages, widths, filters, length
        self.tables = {k: rng.normal(0, 0.3, (k, 256, filters)).astype(np.float32) for k in widths}
        for t in self.tables.values():
            t[:, PAD] = -1.0
        self.bias = np.zeros(filters * len(widths), np.float32)
        self.out = rng.normal(0, 0.1, (filters * len(widths), len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)
        self.pairs: dict[tuple[int, int], np.ndarray] = {}

    def _responses(self, x: np.ndarray, k: int) -> np.ndarray:
        n, t = self.length - k + 1, self.tables[k]
        out = t[0][x[:, :n]]
        for j in range(1, k):
            out += t[j][x[:, j : j + n]]
        return out

    def _fast_responses(self, x: np.ndarray, both: np.ndarray, k: int) -> np.ndarray:
        n, out = self.length - k + 1, None
        for j in range(0, k, 2):
            if j + 1 < k:
                if (k, j) not in self.pairs:
                    t = self.tables[k]
                    self.pairs[k, j] = (t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, -1)
                part = self.pairs[k, j][both[:, j : j + n]]
            else:
                part = self.tables[k][j][x[:, j : j + n]]
            out = part if out is None else np.add(out, part, out=out)
        return out

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def probabilities(self, x: np.ndarray, batch: int = 128) -> np.ndarray:
        """Of each window."""
        out = np.zeros((len(x), len(self.languages)), np.float32)
        for lo in range(0, len(x), batch):
            part = x[lo : lo + batch]
            both = part[:, :-1].astype(np.int32) * 256 + part[:, 1:]
            pooled = np.concatenate([_max_over(self._fast_responses(part, both, k)) for k in self.widths], axis=1)
            out[lo : lo + batch] = self._softmax(np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 0) -> ByteCNN:
        """Cross entropy with Adam; the gradient reaches the bytes where each filter's response is largest."""
        rng = np.random.default_rng(seed)
        flat = [*self.tables.values(), self.bias, self.out, self.out_bias]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in flat]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(order), batch):
                part, want = x[order[lo : lo + batch]], y[order[lo : lo + batch]]
                rows, at, pooled = np.arange(len(part))[:, None], {}, []
                for k in self.widths:
                    r = self._responses(part, k)
                    at[k] = r.argmax(1)
                    pooled.append(np.take_along_axis(r, at[k][:, None, :], 1)[:, 0])
                h = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
                dz = self._softmax(h @ self.out + self.out_bias)
                dz[np.arange(len(part)), want] -= 1
                dz /= len(part)
                dh = (dz @ self.out.T) * (h > 0)
                grads = []
                for i, k in enumerate(self.widths):
                    d = dh[:, i * self.filters : (i + 1) * self.filters]
                    g = np.zeros_like(self.tables[k])
                    for j in range(k):
                        np.add.at(g[j], (part[rows, at[k] + j], np.arange(self.filters)[None, :]), d)
                    g[:, PAD] = 0
                    grads.append(g)
                step += 1
                for p, g, (m, v) in zip(flat, [*grads, dh.sum(0), h.T @ dz, dz.sum(0)], moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.pairs.clear()
        return self


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, windows_per_language: int = 3200, length: int = 256, seed: int = 0) -> ByteCNN | None:
    """A network from labelled rows of each language: the first by a hash of the id, per_language at most, as long as those before
    have less than windows_per_language windows together; rows of more windows than that come last. A chosen row is learned
    whole. So the bound holds at any size. None where no row has a label.

    Every language is learned. Rows with a null id, text or language aren't used. Rows are chosen by ids and lengths alone, in
    parts of each language first, so that a common language gathers in no task; the choice is written, so that Spark knows how
    small it is before texts are joined with it.
    """
    rows = common.only(docs, id=id_col, text=text_col, lang=lang_col).filter("id is not null and text is not null and lang is not null and text != ''")
    some = rows.select("id", "lang", F.ceil(F.octet_length("text") / length).alias("n"), (F.xxhash64("id") % PARTS).alias("part"))
    for group in (("lang", "part"), ("lang",)):
        first = Window.partitionBy(*group).orderBy(F.col("n") > windows_per_language, F.xxhash64("id"), "id", "n")
        before = F.coalesce(F.sum("n").over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        some = some.withColumns({"r": F.row_number().over(first), "before": before}).filter((F.col("r") <= per_language) & (F.col("before") < windows_per_language)).drop("r", "before")
    some = some.select(F.col("id").alias("some_id"), F.col("lang").alias("some_lang")).distinct()
    some = common.Workspace(docs.sparkSession, "language").save(some, "chosen")
    picked = rows.join(some, (F.col("id") == F.col("some_id")) & (F.col("lang") == F.col("some_lang"))).select("id", "lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lo, _, data, offsets in common.slices(batch.column(2)):
                x, text, _ = windows(data, offsets, length)
                yield pa.RecordBatch.from_arrays([pa.array([langs[lo + t] for t in text], pa.string()), pa.array([w.tobytes() for w in x], pa.binary())], ["lang", "window"])

    data = picked.transform(common.arrow, cut, "lang string, window binary").orderBy("lang", "window").toLocalIterator()
    pairs = [(r["lang"], bytes(r["window"])) for r in data]
    if not pairs:
        return None
    languages = sorted({lang for lang, _ in pairs})
    x = np.frombuffer(b"".join(w for _, w in pairs), np.uint8).reshape(-1, length)
    y = np.array([languages.index(lang) for lang, _ in pairs])
    return ByteCNN(languages, length=length, seed=seed).fit(x, y, seed=seed)


def predict(docs: DataFrame, model: ByteCNN | None, *, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """id_col, the columns in keep, lang_pred and score (the language's probability) of every whole text.

    `und` with score 0 where the text is null or has no letter, or nothing was learned; equal probabilities go to the first
    language by name. Repeated rows and null ids stay. One narrow pass, bounded memory.
    """
    from pyspark.sql import types as T

    letter = F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False))
    df = docs.select(F.col(f"`{id_col}`"), *(keep or []), letter.alias("has_letter"), F.col(f"`{text_col}`").alias("text_to_read"))
    n = len(df.columns) - 2
    names = [*df.columns[:n], "lang_pred", "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            langs, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            for lo, hi, data, offsets in common.slices(batch.column(n + 1)):
                if net is None:
                    break
                total = np.zeros((hi - lo, len(net.languages)))
                # a very long text goes through in pieces of whole windows
                for a in range(0, max(1, len(data)), piece := 4096 * net.length if hi - lo == 1 else max(1, len(data))):
                    b = min(len(data), a + piece)
                    x, text, used = windows(data[a:b], np.clip(offsets, a, b) - a, net.length)
                    np.add.at(total, text, net.probabilities(x) * used[:, None])
                best = total.argmax(1)
                size = np.maximum(np.diff(offsets), 1)
                langs[lo:hi] = np.array(net.languages, object)[best]
                score[lo:hi] = np.clip(total[np.arange(hi - lo), best] / size, 0, 1)
            no = ~batch.column(n).to_numpy(zero_copy_only=False).astype(bool)
            langs[no], score[no] = "und", 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(langs, pa.string()), pa.array(score, pa.float64())], names)

    return df.transform(common.arrow, run, T.StructType([*df.schema.fields[:n], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
