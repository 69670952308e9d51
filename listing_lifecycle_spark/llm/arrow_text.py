"""Text columns of Arrow batches as numpy arrays, and the shared folder for tables between jobs."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from listing_lifecycle_spark.session import shared_folder

#: Text handled at once in a task.  One longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: The same for steps whose arrays are fifty times the text and more.
FINE_BYTES = 1 << 19
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Hand rows to workers in batches of at most ``BATCH_BYTES``: by default a batch is 64 MB, held twice for each task.

    This is a setting of the session; one that is smaller already stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the folder that all executors share and read it back: what follows needs none of its lineage."""
    bounded_batches(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds at most ``size`` bytes of text, or one row; nulls in the text become empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(column)
        if text.null_count:
            columns = list(batch.columns)
            columns[column] = pc.fill_null(text, "")
            batch = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
        _, offsets = raw(batch.column(column))
        begin, rows = 0, batch.num_rows
        while begin < rows:
            end = int(np.searchsorted(offsets, offsets[begin] + size, side="right")) - 1
            end = min(max(end, begin + 1), rows)
            yield batch.slice(begin, end - begin)
            begin = end
    release()


def release() -> None:
    """Give memory that a finished task has freed back to the system: workers live on and share a machine with others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and the offsets of its rows in them."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def words(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row: their codes, the distinct words by code, and the rows' offsets.

    ``lower`` changes A-Z only.
    """
    if lower:
        column = pc.ascii_lower(column)
    lists = pc.ascii_split_whitespace(column)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    filled = pc.not_equal(pc.binary_length(flat), 0)
    if not pc.all(filled).as_py():
        keep = filled.to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        flat = flat.filter(filled)
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, offsets


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each row's elements; 0 for rows without any."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind != "b" else np.int64), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + lengths[i] - 1`` for all i, in order."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection, so distinct values stay distinct)."""
    x = values.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def hashes(values: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string, the same in every task: a polynomial over the bytes, then :func:`mix`."""
    data, offsets = raw(values)
    lengths = np.diff(offsets)
    out = np.full(len(lengths), seed * 2 + 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
    order = np.argsort(-lengths, kind="stable")  # words that are long enough for a round come first
    at, left = offsets[:-1][order], lengths[order]
    value, live, step = out[order], len(order), 0
    factor = np.uint64(0x100000001B3)
    while live and step < 64:
        live = int(np.searchsorted(-left[:live], -step, side="left"))
        value[:live] = (value[:live] ^ data[at[:live] + step]) * factor
        value[:live] ^= value[:live] >> np.uint64(29)
        step += 1
    live = int(np.searchsorted(-left, -64, side="left"))
    for i in range(live):  # a few very long words
        value[i] = np.uint64(int(value[i]) ^ long_hash(data[at[i] : at[i] + left[i]].tobytes()))
    out[order] = value
    return mix(out + mix(lengths.astype(np.uint64)))


def long_hash(text: bytes) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")
