"""Shingle sets of texts as sorted hashes, and their minimum hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from listing_lifecycle_spark.llm.arrow_text import hashes, mix, row_of, words


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of each row's shingles of ``width`` words, ascending in each row, and the rows' offsets.

    Words are as of :func:`words`, A-Z lower-cased.  With fewer words than ``width`` the whole sequence is the one
    shingle; without words there is none.
    """
    codes, distinct, at = words(column, lower=True)
    word = hashes(distinct, seed=5)[codes]
    n, length = len(word), np.diff(at)
    row = row_of(at)
    left = at[1:][row] - np.arange(n)  # words from here to the row's end
    short = np.minimum(length[row], width)
    value = mix(short.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    for k in range(width):
        here = np.flatnonzero(k < short) if k else np.arange(n)
        here = here[left[here] > k]
        value[here] = mix(value[here] * np.uint64(0xD1342543DE82EF95) + word[here + k])
    begins = left >= short
    value, row = value[begins], row[begins]
    order = np.argsort(value)
    small = row.astype(np.uint16) if len(column) < 1 << 16 else row
    order = order[np.argsort(small[order], kind="stable")]
    value, row = value[order], row[order]
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[first], row[first]
    return value, np.searchsorted(row, np.arange(len(column) + 1))


def minimum_hashes(value: np.ndarray, offsets: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """``count`` minimum hashes (32 bits) of each row's set; all ones for an empty set."""
    out = np.full((len(offsets) - 1, count), 0xFFFFFFFF, np.uint32)
    filled = np.flatnonzero(np.diff(offsets))
    if not len(filled):
        return out
    factors = np.random.default_rng(seed).integers(0, 2**63, (count, 2), dtype=np.uint64)
    for i, (a, b) in enumerate(factors):
        h = ((value ^ b) * (a | np.uint64(1))) >> np.uint64(32)
        out[filled, i] = np.minimum.reduceat(h.astype(np.uint32), offsets[filled])
    return out


def digest(values: np.ndarray) -> bytes:
    """A 16-byte digest of one row's set."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
