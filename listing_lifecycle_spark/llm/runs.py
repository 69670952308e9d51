"""Runs of certain bytes in text columns, and CRC-32 over whole arrays."""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa

from listing_lifecycle_spark.llm.arrow_text import raw

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Up to this length CRC-32 values are joined by tables, longer strings are read byte by byte.
TABLES = 64


def runs(column: pa.Array, inside_of) -> tuple[pa.Array, np.ndarray]:
    """Maximal runs of bytes for which ``inside_of(bytes)`` holds, A-Z lower-cased, and the rows' offsets in them.

    ``column`` has no nulls.  No run crosses a row's end.
    """
    data, offsets = raw(column)
    data, offsets = LOWER[data[offsets[0] : offsets[-1]]], offsets - offsets[0]
    inside = inside_of(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    begin = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    places = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
    flat = pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(places), pa.py_buffer(data[inside])])
    return flat, np.searchsorted(begin, offsets)


def crc32_of(values: pa.Array) -> np.ndarray:
    """Unsigned CRC-32 of each string's bytes."""
    return np.fromiter(map(zlib.crc32, values.cast(pa.binary()).to_pylist()), np.uint32, len(values))


@cache
def _step() -> np.ndarray:
    """What one more byte makes of the low byte of a CRC-32 value."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


@cache
def _shifts() -> np.ndarray:
    """[n, k, b]: what n further bytes make of byte k of a CRC-32 value if it is b."""
    rows = [np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32)[:, None])]
    for _ in range(TABLES):
        rows.append(rows[-1] >> 8 ^ _step()[rows[-1] & 255])
    return np.stack(rows)


def joined_crc32(first: np.ndarray, then: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each ``A + B``, given that of A, that of B and the length of B in bytes."""
    out, table = np.zeros(len(first), np.uint32), _shifts()
    left = lengths.copy()
    value = first.astype(np.uint32)
    while len(value) and left.max() > TABLES:  # further bytes in steps of the largest table
        long = np.flatnonzero(left > TABLES)
        value = value.copy()
        value[long] = _shifted(table, value[long], np.full(len(long), TABLES))
        left[long] -= TABLES
    out[:] = _shifted(table, value, left) ^ then
    return out


def _shifted(table: np.ndarray, value: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = table[lengths, 0, value & 255]
    for k in (1, 2, 3):
        out = out ^ table[lengths, k, value >> np.uint32(8 * k) & 255]
    return out
