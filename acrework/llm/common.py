"""Helpers shared by the operators of this package: scratch storage, Arrow text access and slicing of batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acrework.functions.storage import shared_path, written

#: Bytes of text that the NumPy kernels take at once; bounds the memory of a Python worker.
CHUNK_BYTES = 2_000_000


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return shared_path(spark, name)


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to shared storage and read it back, so that its lineage ends there and it is computed once."""
    return written(df, name, codec)[0]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of the batches with about ``limit`` bytes of text each (a longer text stands alone)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = utf8(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(off, off[start] + limit, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
    give_back()


def give_back() -> None:
    """Return memory that this worker has freed to the machine; workers live on and share it with others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray, at_once: int = 1_000_000) -> np.ndarray:
    """Whether a[a_at : a_at + size] equals b[b_at : b_at + size], for each of many ranges of at least one byte."""
    out = np.zeros(len(size), bool)
    ends = np.cumsum(size)
    low = 0
    while low < len(size):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + at_once, "right")))
        some = slice(low, high)
        first = ends[some] - size[some] - done
        step = np.arange(int(ends[high - 1] - done))
        equal = a[step + np.repeat(a_at[some] - first, size[some])] == b[step + np.repeat(b_at[some] - first, size[some])]
        out[some] = np.logical_and.reduceat(equal, first)
        low = high
    return out


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves 0 modulo 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bounded_sample(rows: DataFrame, by: str, share: dict, most: dict, most_bytes: int) -> DataFrame:
    """At most ``most[v]`` different rows of each value v of ``by``, and ``most_bytes`` bytes of their texts (one text
    at least), by the least ``draw`` (0 to 1).

    ``share[v]`` is the part of v's rows that is looked at: what it lets through should be a little more than wanted.
    Equal rows (of one draw) count once.
    """
    value = F.col(by).cast("string")
    limit = F.create_map(*(F.lit(x) for v, part in share.items() for x in (str(v), float(part))))
    looked_at = rows.filter(F.col("draw") < limit[value]).dropDuplicates([by, "draw"])
    order = Window.partitionBy(by).orderBy("draw")
    first = looked_at.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max(most.values()))
    upto = F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    own = F.create_map(*(F.lit(x) for v, n in most.items() for x in (str(v), n)))
    return first.withColumn("upto", upto).filter((F.col("place") <= own[value]) & ((F.col("place") == 1) | (F.col("upto") <= most_bytes))).drop("upto")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x

