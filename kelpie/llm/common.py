"""Shared pieces of the training-data operators: tables, scratch space, Arrow text buffers and rolling hashes."""

from __future__ import annotations

import atexit
import hashlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes outside x20 and x09-x0D.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only in a single process (tests) a temporary one stands in for it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="kelpie-")
        atexit.register(shutil.rmtree, own, True)
        named = "file://" + own
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended; the cluster clears its shared folder
        pass


#: Spark's own switch: the shuffle files of a query go when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors.

    The shuffle files behind df go with the write; a later use of df itself would compute them again.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{scratch_dir(spark)}/kelpie-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(schema).parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes what staged() wrote for these; nothing that reads them may run afterwards."""
    for df in tables:
        path = df.__dict__.pop("_stored_at", None)
        if path:
            _remove(df.sparkSession, path)


def identity() -> tuple[Column, Column]:
    """What tells rows of documents apart: doc_id (null: the smallest number) and a tag, a hash of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), F.xxhash64("text", F.col("doc_id").isNull())


def training_fold(doc_id: str = "doc_id", mod: int = 5):
    """crc32 of the id as text, modulo mod."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


# ---- Arrow text buffers -------------------------------------------------------------------------------------------


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, nulls as empty, and the n+1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` text bytes (or one row, if longer)."""
    for batch in batches:
        lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        start, total = 0, 0
        for i, n in enumerate(lengths):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(lengths):
            yield batch.slice(start)


# ---- hashes -------------------------------------------------------------------------------------------------------

_RANDOM = np.random.Generator(np.random.PCG64(20240517))
BYTE_CODE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULTIPLIER = int(_RANDOM.integers(1, 2**62)) * 4 + 3
INVERSE = pow(MULTIPLIER, -1, 2**64)


@lru_cache(2)
def _powers(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Polynomial hashes modulo 2**64 of any substring of a byte buffer, in constant time each.

    They choose places only: long structured strings can share one, so nothing is taken as equal by them alone.
    """

    def __init__(self, data: np.ndarray):
        size = 1 << max(16, int(len(data)).bit_length())
        self.inverse = _powers(size, INVERSE)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODE[data] * _powers(size, MULTIPLIER)[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(value + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


GAP = np.zeros(256, bool)
GAP[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word of a buffer; words never cross rows."""
    inside = ~GAP[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside
    ends = ends.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    begin = np.flatnonzero(starts)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(offsets, begin, "right") - 1


#: Bytes of a word that are hashed in steps of eight over all words side by side; what is behind is digested word by word.
_STEPPED = 128


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range: eight bytes at a time through `mix`, independent between salts."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = end - begin
    h = mix(size.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64 + 1))
    live = np.arange(len(size))
    for at in range(0, _STEPPED, 8):
        left = size[live] - at
        live = live[left > 0]
        if not len(live):
            return h
        left = np.minimum(left[left > 0], 8).astype(np.uint64)
        x = eight[begin[live] + at] << (np.uint64(64) - left * np.uint64(8))  # only the word's own bytes
        h[live] = mix((h[live] ^ x) + np.uint64(0x9E3779B97F4A7C15))
    for i in live[size[live] > _STEPPED].tolist():
        rest = hashlib.blake2b(data[begin[i] + _STEPPED : end[i]].tobytes(), digest_size=8).digest()
        h[i] = mix(np.array([h[i] ^ np.uint64(int.from_bytes(rest, "little"))], np.uint64))[0]
    return h
