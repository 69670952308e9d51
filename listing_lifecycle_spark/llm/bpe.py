"""Byte-pair encoding in numpy matrices: operator "byte-level BPE encoding and decoding".

A slice of texts is cut into pre-tokens with byte classes, and only distinct pre-tokens are merged.  Those of like
length form a padded matrix of ids; every round, each row merges its leftmost pair of least rank, found through a
hashed pair table, and closes the gap, so the matrix narrows by a column.  Rows without a pair leave the matrix.
Pre-tokens of over ``LONG`` bytes, whose rounds would cost the square of their length, take a heap.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listing_lifecycle_spark.llm.arrow_text import raw, slices, spread, sums

LONG = 512
WIDTHS = (2, 4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512)
#: Distinct pre-tokens that a worker remembers; beyond that it forgets all and goes on.
REMEMBERED = 250_000
NONE = np.int32(2**31 - 1)
LETTER, NUMBER, OTHER, SPACE = range(4)


class Pairs:
    """Hash table from a pair of ids to its rank and the id it merges into; linear probing."""

    def __init__(self, left, right, rank, merged):
        keys = (np.asarray(left, np.int64) << 32) | np.asarray(right, np.int64)
        size = 1 << max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.mask, self.shift = size - 1, np.uint64(64 - size.bit_length() + 1)
        self.keys, self.rank, self.merged = np.full(size, -1, np.int64), np.full(size, NONE, np.int32), np.full(size, -1, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        rank, merged = np.asarray(rank, np.int32), np.asarray(merged, np.int32)
        while len(todo):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[todo[free]]  # of several for one slot the last stays
            put = self.keys[slot] == keys[todo]
            self.rank[slot[put]], self.merged[slot[put]] = rank[todo[put]], merged[todo[put]]
            todo, slot = todo[~put], (slot[~put] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def slots(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair; a pair that is not known gets an empty slot (rank ``NONE``)."""
        keys = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        flat = keys.ravel()
        out = self._slot(flat)
        found = self.keys[out]
        todo = np.flatnonzero((found != flat) & (found != -1))
        while len(todo):
            out[todo] = (out[todo] + 1) & self.mask
            found = self.keys[out[todo]]
            todo = todo[(found != flat[todo]) & (found != -1)]
        return out.reshape(keys.shape)


def merge_matrix(ids: np.ndarray, pairs: Pairs) -> list[tuple[np.ndarray, np.ndarray]]:
    """Merge the rows of ``ids`` (padded with -1) to the end: (row numbers, their ids padded with -1) by round."""
    done, rows = [], np.arange(len(ids))
    rank = pairs.rank[pairs.slots(ids[:, :-1], ids[:, 1:])]
    while len(rows):
        if ids.shape[1] == 1:
            done.append((rows, ids))
            break
        at = rank.argmin(axis=1)  # the leftmost of equal ranks
        live = rank[np.arange(len(rows)), at] != NONE
        if not live.all():
            done.append((rows[~live], ids[~live]))
            rows, ids, rank, at = rows[live], ids[live], rank[live], at[live]
            if not len(rows):
                break
        n, width = ids.shape
        row = np.arange(n)
        merged = pairs.merged[pairs.slots(ids[row, at], ids[row, at + 1])]
        keep = np.ones((n, width), bool)
        keep[row, at + 1] = False
        ids = ids[keep].reshape(n, width - 1)
        ids[row, at] = merged
        keep = np.ones((n, width - 1), bool)
        keep[row, at] = False
        rank = rank[keep].reshape(n, width - 2)
        left = np.flatnonzero(at > 0)
        rank[left, at[left] - 1] = pairs.rank[pairs.slots(ids[left, at[left] - 1], merged[left])]
        right = np.flatnonzero(at < width - 2)
        rank[right, at[right]] = pairs.rank[pairs.slots(merged[right], ids[right, at[right] + 1])]
    return done


def merge_long(ids: list[int], pairs: Pairs) -> list[int]:
    """Merge one long row with a heap of (rank, place)."""
    n = len(ids)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def pair(a: int, b: int) -> tuple[int, int]:
        if (a, b) not in known:
            slot = int(pairs.slots(np.array([a]), np.array([b]))[0])
            known[a, b] = int(pairs.rank[slot]), int(pairs.merged[slot])
        return known[a, b]

    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair(ids[i], ids[i + 1])[0]) != NONE]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j < 0 or ids[j] != b:
            continue
        ids[i], ids[j] = pair(a, b)[1], -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
        for x, y in ((before[i], i), (i, k)):
            if x >= 0 and y >= 0 and (r := pair(ids[x], ids[y])[0]) != NONE:
                heapq.heappush(heap, (r, x, ids[x], ids[y]))
    return [x for x in ids if x >= 0]


def merge_pieces(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: Callable, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces of bytes, one after the other, and how many each has.  ``first(bytes, last)`` gives starting ids."""
    counts = np.zeros(len(starts), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # piece, place in it, id
    low = 0
    for width in WIDTHS:
        which = np.flatnonzero((lengths > low) & (lengths <= width))
        low = width
        if not len(which):
            continue
        column = np.arange(width)
        inside = column[None, :] < lengths[which, None]
        at = np.where(inside, starts[which, None] + column[None, :], 0)
        ids = np.where(inside, first(data[at], column[None, :] == lengths[which, None] - 1), -1).astype(np.int32)
        for rows, done in merge_matrix(ids, pairs):
            row, place = np.nonzero(done >= 0)
            counts[which[rows]] = np.bincount(row, minlength=len(rows))
            parts.append((which[rows[row]], place, done[row, place]))
    for i in np.flatnonzero(lengths > LONG):
        piece = data[starts[i] : starts[i] + lengths[i]]
        got = np.array(merge_long(first(piece, np.arange(len(piece)) == len(piece) - 1).tolist(), pairs), np.int64)
        counts[i] = len(got)
        parts.append((np.full(len(got), i), np.arange(len(got)), got))
    flat, begin = np.zeros(int(counts.sum()), np.int32), np.cumsum(counts) - counts
    for piece, place, ids in parts:
        flat[begin[piece] + place] = ids
    return flat, counts


@cache
def class_table() -> np.ndarray:
    """The class of each code point under ``\\p{L}``, ``\\p{N}`` and ``\\s``."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for found in regex.finditer(pattern, points):
            table[ord(found[0][0]) : ord(found[0][-1]) + 1] = kind
    return table


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where pre-tokens begin, by the classic byte-level pattern (``public_tokenizers.PATTERN``), rows kept apart.

    Contractions at the start of a run, runs of one class with one space before, runs of space less their last
    character.
    """
    begin, end = int(offsets[0]), int(offsets[-1])
    text = data[begin:end]
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    kind = class_table()[:256].copy()[text]
    leads = np.flatnonzero(text >= 0xC0)
    if len(leads):
        lead = text[leads].astype(np.int32)
        size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
        tail = [text[np.minimum(leads + k, n - 1)].astype(np.int32) & 0x3F for k in (1, 2, 3)]
        point = np.where(size == 2, (lead & 0x1F) << 6 | tail[0], np.where(size == 3, (lead & 0x0F) << 12 | tail[0] << 6 | tail[1], (lead & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]))
        classes = class_table()[point]
        kind[leads] = classes
        for k in (1, 2, 3):
            kind[leads[size > k] + k] = classes[size > k]
    row = np.zeros(n + 1, bool)
    row[offsets - begin] = True
    flag = row.copy()
    flag[1:n] |= kind[1:] != kind[:-1]
    flag[n] = True
    apart = np.flatnonzero(flag[:n] & ~row[:n])  # runs that follow another run of their row
    after_space = apart[kind[apart - 1] == SPACE]
    plain = text[after_space - 1] == 0x20
    flag[after_space[plain]] = False
    flag[after_space[plain] - 1] = True
    odd = after_space[~plain] - 1
    while len(odd) and (inner := (text[odd] & 0xC0) == 0x80).any():
        odd = odd - inner
    flag[odd] = True
    quote = np.flatnonzero((text[:-1] == 0x27) & flag[: n - 1] & flag[1:n] & ~row[1:n]) if n > 1 else np.zeros(0, np.int64)
    quote = quote[kind[quote + 1] == LETTER]
    if len(quote):
        one, two = text[quote + 1], text[np.minimum(quote + 2, n - 1)]
        same = (quote + 2 < n) & ~row[np.minimum(quote + 2, n)]
        size = np.where(np.isin(one, list(b"stmd")), 1, np.where(same & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))), 2, 0))
        quote, size = quote[size > 0], size[size > 0]
        flag[quote + 1] = False
        flag[quote + 1 + size] = True
    return np.flatnonzero(flag[:n]) + begin


class Memory:
    """Ids of the pre-tokens that a worker has met."""

    def __init__(self, encode: Callable):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.begin, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def of(self, distinct: pa.Array) -> np.ndarray:
        """The number of each distinct pre-token in ``begin`` and ``count``."""
        if len(self.place) > REMEMBERED:
            self.clear()
        keys, place = distinct.to_numpy(zero_copy_only=False), self.place
        new = np.array([k not in place for k in keys], bool)
        if new.any():
            flat, counts = self.encode(distinct.filter(pa.array(new)))
            place.update(zip(keys[new], range(len(self.begin), len(self.begin) + len(counts))))
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(counts) - counts])
            self.count, self.ids = np.concatenate([self.count, counts]), np.concatenate([self.ids, flat])
        return np.fromiter((place[k] for k in keys), np.int64, len(keys))


def coded(data: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, pa.Array]:
    """Codes of the pieces between ``starts``, and the distinct pieces by code."""
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.binary())
    edges = np.append(starts, end) - starts[0]
    piece = np.ascontiguousarray(data[starts[0] : end])
    pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(piece)])
    out = pieces.dictionary_encode()
    return out.indices.to_numpy().astype(np.int64), out.dictionary


class Ranks:
    """A rank file: ids of single bytes, pairs that merge, whole tokens, bytes of each id."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.tokens = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.byte = np.array([self.tokens[bytes([i])] for i in range(256)], np.int32)
        rows = [(self.tokens[t[:k]], self.tokens[t[k:]], i, i) for t, i in self.tokens.items() for k in range(1, len(t)) if t[:k] in self.tokens and t[k:] in self.tokens]
        self.pairs = Pairs(*zip(*rows)) if rows else Pairs([], [], [], [])
        size = max(self.tokens.values()) + 1
        self.length, texts = np.zeros(size, np.int64), [b""] * size
        for t, i in self.tokens.items():
            self.length[i], texts[i] = len(t), t
        self.bytes, self.begin = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(self.length) - self.length
        self.memory = Memory(self.encode)

    def encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens; one that is a token itself is not merged."""
        data, offsets = raw(pieces)
        flat, counts = merge_pieces(data, offsets[:-1], np.diff(offsets), lambda b, _: self.byte[b], self.pairs)
        whole = np.array([self.tokens.get(k, -1) for k in pieces.to_numpy(zero_copy_only=False)], np.int64)
        if (apart := (whole >= 0) & (counts != 1)).any():
            keep = np.repeat(~apart, counts)
            begin = np.cumsum(np.where(apart, 0, counts)) - np.where(apart, 0, counts)
            flat = np.insert(flat[keep], begin[apart], whole[apart])
            counts = np.where(apart, 1, counts)
        return flat.astype(np.int32), counts


@cache
def ranks(path: str) -> Ranks:
    """The rank file at ``path``, read once by a worker."""
    return Ranks(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = ranks(path)
    for batch in slices(batches):
        data, offsets = raw(batch.column(1))
        starts = pre_tokens(data, offsets)
        codes, distinct = coded(data, starts, int(offsets[-1]))
        place = model.memory.of(distinct)[codes]
        memory = model.memory
        counts = memory.count[place]
        ids = memory.ids[spread(memory.begin[place], counts)]
        per_row = sums(counts, np.searchsorted(starts, offsets))
        edges = pa.array(np.concatenate([[0], np.cumsum(per_row)]), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(edges, pa.array(ids, pa.int32()))], ["doc_id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = ranks(path)
    for batch in batches:
        lists = batch.column(1)
        edges, ids = lists.offsets.to_numpy().astype(np.int64), np.asarray(lists.values)
        size = model.length[ids]
        where = np.concatenate([[0], np.cumsum(size)])
        for begin in range(0, batch.num_rows, 256):
            end = min(begin + 256, batch.num_rows)
            a, b = edges[begin], edges[end]
            text = model.bytes[spread(model.begin[ids[a:b]], size[a:b])]
            out = pa.Array.from_buffers(pa.large_binary(), end - begin, [None, pa.py_buffer(where[edges[begin : end + 1]] - where[a]), pa.py_buffer(text)])
            yield pa.RecordBatch.from_arrays([*batch.slice(begin, end - begin).columns, out.cast(pa.binary())], ["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Ids of each whole text by the rank file at ``path``: doc_id, ids (array of int).

    Pieces of the pattern are encoded separately and no special token is known.  A row for each row of ``docs``, in the
    same partition: a null text counts as empty and gives an empty list, repeated rows and null doc_ids stay, an empty
    table gives none.  The file must be at ``path`` on every executor.
    """
    return docs.select("doc_id", "text").mapInArrow(partial(_encode, path=path), "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The bytes that each row's ids stand for: doc_id, ids, decoded (binary).

    A null list counts as empty and gives no bytes; an id that the file lacks is an error.
    """
    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(partial(_decode, path=path), "doc_id bigint, ids array<int>, decoded binary")


def _round_trip(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    return _decode(_encode(batches, path), path)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """:func:`decode` of :func:`encode` in one pass of the same task: doc_id, ids, decoded."""
    return docs.select("doc_id", "text").mapInArrow(partial(_round_trip, path=path), "doc_id bigint, ids array<int>, decoded binary")
