"""Shared helpers: staged tables in the cluster's shared folder, word and text batches.

Stage boundaries are Parquet tables under ``spark.checkpoint.dir`` (read through
``monthpick.session``): they survive a lost executor and cut lineage.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monthpick.session import scratch_path

#: Bytes of text that a task works on at once.
TEXT_BLOCK = 1 << 20
#: Entries of a worker's word memo.  Beyond it, further words are computed each time.
MEMO_WORDS = 150_000


def release_memory() -> None:
    """Give freed memory back to the system; a worker process lives on after its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """``run`` of a mapInArrow that gives its memory back when its task is done."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return tidied


@contextlib.contextmanager
def short_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of ``rows`` rows at most, for jobs that run inside; a batch of whole texts is held by the JVM and by the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    at_most = int(before) if int(before) > 0 else rows
    spark.conf.set(name, str(min(at_most, rows)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """The fold that no classifier learns from: crc32 of doc_id as text, modulo 3, is 1 (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Scratch:
    """Staged tables of one operator run, in one folder of the shared scratch space."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, scratch_path(spark, name), 0

    def stage(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back; ``path`` of the result names the folder for ``drop``."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete staged tables that nothing reads any more."""
        jvm = self.spark._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Shipped:
    """A broadcast value with the code of its classes; only for values of bounded size."""

    def __init__(self, spark: SparkSession, value):
        self.packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def load(self):
        return pickle.loads(self.packed.value)


class Memo(dict):
    """Bounded memo of a function of one word."""

    def __init__(self, f: Callable, limit: int = MEMO_WORDS):
        super().__init__()
        self.f, self.limit = f, limit

    def __missing__(self, word):
        value = self.f(word)
        if len(self) < self.limit:
            self[word] = value
        return value


def word_memo() -> Memo:
    """word bytes -> 64-bit code."""
    return Memo(xxhash.xxh3_64_intdigest)


def byte_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def blocks(lengths: list[int], limit: int = TEXT_BLOCK) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows with about ``limit`` bytes of text each (a longer text is a range of its own)."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def text_blocks(batch: pa.RecordBatch, name: str, limit: int = TEXT_BLOCK) -> Iterator[list[bytes]]:
    """``byte_column`` in ``blocks``: only one block's texts are held beside the batch."""
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name)).cast(pa.binary())), 0).to_pylist()
    for a, b in blocks(lengths, limit):
        yield byte_column(batch.slice(a, b - a), name)


def word_codes(texts: list[bytes], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts in a row, and each text's offsets into them."""
    parts = [x.split() for x in texts]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    codes = np.empty(offsets[-1], np.uint64)
    get = memo.__getitem__
    for p, a, b in zip(parts, offsets[:-1].tolist(), offsets[1:].tolist()):
        codes[a:b] = np.fromiter(map(get, p), np.uint64, b - a)
    return codes, offsets


MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit finaliser; each salt gives another order of the same values."""
    x = x + np.uint64((salt * int(MIX)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """Code of the n consecutive words from each position on (the last n - 1 positions are cut off)."""
    if len(codes) < n:
        return np.empty(0, np.uint64)
    size = len(codes) - n + 1
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x100000001B3) + codes[j : j + size]
    return mix(out)
