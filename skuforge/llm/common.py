"""What the corpus operators share: reading tables, shared working tables, text of Arrow batches, hashed words."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of about so many bytes are worked on at once, so that memory doesn't grow with the batch.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- tables that cut lineage -------------------------------------------------------------------------------------------


class Workspace:
    """Tables written to the folder that all executors share; a lost executor costs no more than a reread.

    The folder is the session's spark.checkpoint.dir. Where that is unset, a folder of this machine serves a local master
    (tests); on a cluster that is an error.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "/tmp/checkpoints"
        self.path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def folder(self, what: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:03d}-{what}"

    def save(self, df: DataFrame, what: str) -> DataFrame:
        """Write df and read it again. The driver collects its garbage in between: Spark deletes a step's shuffle files only when the
        driver has noticed that nothing refers to them, and its heap goes back to what is in use instead of growing to its limit."""
        to = self.folder(what)
        df.write.parquet(to)
        self.spark._jvm.System.gc()
        return _Saved.of(self.spark.read.schema(df.schema).parquet(to), to)

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table that nothing reads any more."""
        self.delete(_Saved.where(df))

    def delete(self, folder: str | None) -> None:
        if folder:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class _Saved:
    """Where a saved DataFrame lies."""

    @staticmethod
    def of(df: DataFrame, folder: str) -> DataFrame:
        df._skuforge_folder = folder
        return df

    @staticmethod
    def where(df: DataFrame) -> str | None:
        return getattr(df, "_skuforge_folder", None)


# ---- Python on Arrow batches ---------------------------------------------------------------------------------------------

#: Rows worked on at once: with texts of some KB, results for a batch of Spark's 10,000 rows would be tens of MB in each of
#: three places.
BATCH_ROWS = 1000


def arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow(run, schema), with Spark's batches cut to BATCH_ROWS at most (the session's own setting stays). After each
    task a worker drops what kept() holds for other tasks than this one and gives its free memory back: the same workers serve
    the stages that follow."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_ROWS):
                yield batch.slice(lo, BATCH_ROWS)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        try:
            yield from run(cut(batches))
        finally:
            release()

    return df.mapInArrow(bounded, schema)


_KEPT: dict[str, tuple[object, object]] = {}
_USED: set[str] = set()


def kept(name: str, source: object, make: Callable):
    """make(*source), kept by a worker process for its next tasks as long as source, a broadcast's value, is the same object, and
    until a task that doesn't ask for it. Before something new is made, what this task hasn't asked for goes, so that the stores of
    two stages aren't held at once."""
    _USED.add(name)
    if name not in _KEPT or _KEPT[name][0] is not source:
        _KEPT.pop(name, None)
        drop_unused()
        _KEPT[name] = (source, make(*source))
    return _KEPT[name][1]


def begin() -> None:
    """A task begins: it has asked for nothing that is kept yet. (A function of the module, as workers get what is nested by value.)"""
    _USED.clear()


def release() -> None:
    """A task ends: what it didn't ask for is kept no longer, and free memory goes back."""
    drop_unused()


def drop_unused() -> None:
    """Drops what the task hasn't asked for and gives free memory back."""
    for name in set(_KEPT) - _USED:
        del _KEPT[name]
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


# ---- columns whose names may clash -------------------------------------------------------------------------------------


def only(df: DataFrame, **columns: str) -> DataFrame:
    """df.select with exact names: new=old. Names are quoted, so dots and spaces in other columns do no harm."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or with underscores before it so that no column of df has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


# ---- text of Arrow batches ---------------------------------------------------------------------------------------------


def text_array(column: pa.Array) -> pa.Array:
    """Strings with nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, UTF-8 bytes, offsets of the rows and of the end) of about limit bytes each."""
    column = text_array(column)
    if not len(column):
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


# ---- words and their hashes --------------------------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_table(outside: Callable[[int], bool]) -> np.ndarray:
    """Which bytes belong to words."""
    return np.array([not outside(b) for b in range(256)])


#: Words between white space, and words of digits, letters and whatever isn't ASCII.
SPACED = byte_table(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
ALNUM = byte_table(lambda b: b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Low bytes of a number, by how many; spans longer than LONG bytes get a cryptographic hash.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
LONG = 256


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of data (bytes), eight bytes at a time: each step is a bijection of what came before and of
    the eight bytes, so spans of one length up to eight bytes never collide, and longer ones by chance only (2^-64)."""
    sizes = np.asarray(ends, np.int64) - starts
    h = mix(sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    eight = np.ndarray((len(data) + 1,), "<u8", np.append(data, np.zeros(8, np.uint8)).tobytes(), 0, (1,))
    live, at = np.flatnonzero((sizes <= LONG) & (sizes > 0)), 0
    while len(live):
        h[live] = mix(h[live] ^ (eight[starts[live] + at] & _LOW[np.minimum(sizes[live] - at, 8)]))
        at += 8
        live = live[sizes[live] > at]
    for i in np.flatnonzero(sizes > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with A-Z lower-cased: the words' 64-bit hashes, and start and end in bytes. No word spans two texts."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    data = _LOWER[data]
    inside = kind[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    return span_hashes(data, starts, ends), starts, ends


def per_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of each text's first word, and the number of words at the end."""
    return np.searchsorted(starts, offsets)


# ---- arrays combined over a cluster -------------------------------------------------------------------------------------


def fold_arrays(rows: DataFrame, dtype: str, combine: Callable[[np.ndarray, np.ndarray], np.ndarray], fan_in: int = 16) -> np.ndarray | None:
    """combine() over binary column `part` of all rows (arrays of one fixed length), fan_in to one per round."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0):
                part = np.frombuffer(x.as_buffer(), dtype)
                total = part.copy() if total is None else combine(total, part)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    n = rows.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // fan_in)
        rows = rows.repartition(n).transform(arrow, fold, "part binary")
    parts = [np.frombuffer(bytes(r[0]), dtype) for r in rows.transform(arrow, fold, "part binary").collect()]
    total = None
    for part in parts:
        total = part.copy() if total is None else combine(total, part)
    return total
