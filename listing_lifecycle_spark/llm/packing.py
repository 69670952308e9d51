"""Packing token pieces into sequences: best fit, then a local search over swaps.

Documents are cut into pieces of at most the capacity.  Pieces are dealt to groups of bounded size; in each, the largest
piece goes first, to the fullest bin with room.  Then underfull bins trade pieces - one moves, one for one, two for one
or one for two - whenever the fuller bin gets fuller, so the sum of squared fills grows and the emptiest bins run dry.
The search looks at sizes, not pieces, and ends when no such trade is left; it has no other limit.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache, cached_property, partial
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listing_lifecycle_spark.llm.arrow_text import FINE_BYTES, raw, slices, spread, stored, sums, words
from listing_lifecycle_spark.llm.bpe import Memory, Pairs, coded, merge_pieces
from listing_lifecycle_spark.llm.token_counts import byte_alphabet

CAPACITY = 2048
GROUP = 16384
NEVER = 1 << 62


class WordVocabulary:
    """A lower-casing vocabulary with word ends.

    Words of printable ASCII and plain accented Latin letters are split and merged here, each distinct word once; any
    other word, where normal forms or special strings may matter, goes to the library alone.
    """

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, letters, end = model["vocab"], byte_alphabet(), model["end_of_word_suffix"]
        self.path = path
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = Pairs(*zip(*[(vocab[a], vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)]))
        self.byte = np.zeros((2, 256), np.int32)
        for letter, b in letters.items():
            self.byte[:, b] = vocab[letter], vocab[letter + end]
        self.plain = regex.compile(r"[!-~À-įı-ſ]+")
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.memory = Memory(self.encode)

    @cached_property
    def library(self):
        """The tokenizers library's object, loaded with the first word that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, and how many each has."""
        texts = distinct.to_numpy(zero_copy_only=False)
        parts, counts, other = [], np.zeros(len(texts), np.int64), []
        for i, word in enumerate(texts):
            if self.plain.fullmatch(word) and "<|" not in word:
                word = word.lower()
                own = [word] if word.isalpha() else self.split.findall(word)
                parts += own
                counts[i] = len(own)
            else:
                other.append(i)
        joined = pa.array(parts, pa.large_string()).cast(pa.large_binary())
        pieces = joined.dictionary_encode()
        data, offsets = raw(pieces.dictionary)
        flat, sizes = merge_pieces(data, offsets[:-1], np.diff(offsets), lambda b, last: self.byte[np.broadcast_to(last, b.shape).astype(np.int64), b], self.pairs)
        code = pieces.indices.to_numpy()
        begin = np.cumsum(sizes) - sizes
        total = sums(sizes[code], np.concatenate([[0], np.cumsum(counts)]))
        rest = [self.library.encode(texts[i], add_special_tokens=False).ids for i in other]
        total[other] = [len(x) for x in rest]
        out, first = np.zeros(int(total.sum()), np.int32), np.cumsum(total) - total
        usual = np.ones(len(texts), bool)
        usual[other] = False
        out[spread(first[usual], total[usual])] = flat[spread(begin[code], sizes[code])]
        for i, x in zip(other, rest):
            out[first[i] : first[i] + len(x)] = x
        return out, total


@cache
def vocabulary(path: str) -> WordVocabulary:
    """The vocabulary at ``path``, read once by a worker."""
    return WordVocabulary(path)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    model = vocabulary(path)
    for batch in slices(batches, size=2 * FINE_BYTES):
        codes, distinct, at = words(batch.column(1))
        place = model.memory.of(distinct)[codes]
        counts = model.memory.count[place]
        ids, per_row = model.memory.ids[spread(model.memory.begin[place], counts)], sums(counts, at)
        size = per_row + 1
        first = np.cumsum(size) - size
        flat = np.full(int(size.sum()), end, np.uint32)
        flat[spread(first, per_row)] = ids
        n = -(-size // capacity)
        row = np.repeat(np.arange(len(size)), n)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start = piece * capacity
        length = np.minimum(capacity, size[row] - start)
        for a in range(0, len(row), 1024):
            own = slice(a, a + 1024)
            begin = first[row[own]] + start[own]
            edges = np.append(begin, begin[-1] + length[own][-1])
            data = flat.astype("<u4")[edges[0] : edges[-1]].tobytes()
            blob = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(((edges - edges[0]) * 4).astype(np.int32)), pa.py_buffer(data)])
            columns = [batch.column(0).take(pa.array(row[own])), pa.array(piece[own].astype(np.int32)), pa.array(start[own]), pa.array(length[own]), blob]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids"])


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """doc_id, piece (from 0), start, length, ids (little-endian 32-bit) of each whole text, then the id ``end``.

    Ids are those of the vocabulary file at ``path`` without added special tokens.  Texts of more than ``capacity``
    tokens are cut into pieces of that length, of which the last may be shorter.  A null, empty or blank text is one
    piece that holds ``end`` only.  Repeated rows and null doc_ids stay; an empty table gives none.
    """
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids binary"
    return docs.select("doc_id", "text").mapInArrow(partial(_pieces, path=path, capacity=capacity, end=end), schema)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: the largest item first, each into the bin with the least room that suffices."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # ascending (room, bin)
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        at = bisect_left(room, (size, -1))
        if at == len(room):
            bins.append([item])
            left, b = capacity - size, len(bins) - 1
        else:
            left, b = room.pop(at)
            bins[b].append(item)
            left -= size
        if left:
            insort(room, (left, b))
    return bins


class Bins:
    """Bins of items, and for each size the emptiest bin that holds an item of it, or two items of that size together.

    Bins are ordered by fill, then number.  What a size knows is a heap of (fill, bin) with entries that no longer hold
    dropped when they come up, so an item or a whole run of equal ones costs one look.
    """

    def __init__(self, bins: list[list[int]], size: list[int], capacity: int):
        self.size, self.capacity = size, capacity
        self.items = [sorted(b, key=lambda i: (size[i], i)) for b in bins]
        self.fill = [sum(size[i] for i in b) for b in bins]
        self.sums: list[tuple[set[int], set[int]]] = [(set(), set())] * len(bins)
        self.heaps: tuple[dict[int, list], dict[int, list]] = ({}, {})
        #: Least (fill, bin) as one number for each size, alone and for pairs; NEVER where no bin has it.
        self.least = np.full((2, capacity + 1), NEVER, np.int64)
        for b in range(len(bins)):
            self.note(b)

    def key(self, b: int) -> int:
        return self.fill[b] * len(self.items) + b

    def note(self, b: int) -> None:
        """Enter what bin ``b`` holds now; full bins give nothing."""
        before = self.sums[b]
        own = [self.size[i] for i in self.items[b]] if self.fill[b] < self.capacity else []
        pairs = {x + y for k, x in enumerate(own) if not k or own[k - 1] != x for y in set(own[k + 1 :])}
        self.sums[b] = (set(own), pairs)
        for kind in (0, 1):
            for x in self.sums[b][kind]:
                heappush(self.heaps[kind].setdefault(x, []), self.key(b))
            for x in before[kind] | self.sums[b][kind]:
                self.refresh(kind, x)

    def refresh(self, kind: int, x: int) -> None:
        heap, n = self.heaps[kind][x], len(self.items)
        while heap and (self.key(heap[0] % n) != heap[0] or x not in self.sums[heap[0] % n][kind]):
            heappop(heap)
        self.least[kind, x] = heap[0] if heap else NEVER

    def best_trade(self, b: int) -> tuple[int, int, int, int, int] | None:
        """Of all trades with emptier bins the one that leaves ``b`` the least room: gain, what it gives and takes (sums,
        and whether the sum is of two)."""
        gap, best = self.capacity - self.fill[b], None
        for kind in (0, 1):  # takes one, or two of one bin
            valid = self.least[kind] < self.key(b)
            if not valid.any():
                continue
            nearest = np.maximum.accumulate(np.where(valid, np.arange(self.capacity + 1), 0))
            for given, sums in enumerate(((0,), self.sums[b][0], self.sums[b][1])):
                if not sums or kind and given == 2:
                    continue
                give = np.fromiter(sums, np.int64, len(sums))
                gain = nearest[np.minimum(give + gap, self.capacity)] - give
                k = int(gain.argmax())
                if gain[k] > 0 and (best is None or gain[k] > best[0]):
                    best = (int(gain[k]), given, int(give[k]), kind, int(give[k] + gain[k]))
            if best and best[0] == gap:
                break
        return best

    def pick(self, b: int, count: int, total: int) -> list[int]:
        """``count`` items of a bin that have this sum."""
        if count == 0:
            return []
        if count == 1:
            return [next(i for i in self.items[b] if self.size[i] == total)]
        place: dict[int, int] = {}
        for i in self.items[b]:
            if (j := place.get(total - self.size[i])) is not None:
                return [j, i]
            place.setdefault(self.size[i], i)
        raise AssertionError("no such pair")

    def trade(self, b: int, trade: tuple[int, int, int, int, int]) -> None:
        gain, given, give, kind, take = trade
        other = int(self.least[kind, take]) % len(self.items)
        out, back = self.pick(b, given, give), self.pick(other, kind + 1, take)
        for mine, lost, got in ((b, out, back), (other, back, out)):
            self.items[mine] = sorted([i for i in self.items[mine] if i not in lost] + got, key=lambda i: (self.size[i], i))
        self.fill[b] += gain
        self.fill[other] -= gain
        self.note(b)
        self.note(other)


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Trade items between underfull bins until no trade is left; empty bins go.

    A bin takes from emptier ones: an item that fits, one for a smaller one, one for two, or two of a bin for one, always
    the trade that leaves it the least room.  Every trade makes the sum of squared fills larger, so the search ends.
    All sizes and sums are looked at, each once, whatever the number of items that have it.  Where it ends depends on
    which bins come first: it is done with the emptier and with the fuller bins first, and the fewer bins count.  Bins
    that are as few as the sum of all lengths allows are left as they are.
    """
    least = -(-int(lengths.sum()) // capacity)
    if len(bins) <= least:
        return bins
    size, found = lengths.tolist(), []
    for order in (1, -1):
        found.append(_settled(Bins(bins, size, capacity), order))
        if len(found[-1]) <= least:
            break
    return min(found, key=len)


def _settled(state: Bins, order: int) -> list[list[int]]:
    changed = True
    while changed:
        changed = False
        for b in sorted(range(len(state.items)), key=lambda b: order * state.key(b)):
            while 0 < state.fill[b] < state.capacity and (trade := state.best_trade(b)):
                state.trade(b, trade)
                changed = True
    return [b for b in state.items if b]


def _pack(table: pa.Table, capacity: int) -> pa.Table:
    """``table`` has a group's number, its key and the columns of the rows; only its columns' places count, as names may clash."""
    group, rows = int(table.column(0)[0].as_py()), table.select(range(2, table.num_columns))
    key = table.column(1).combine_chunks().flatten().to_numpy().reshape(-1, 3)
    lengths = key[:, 2]
    full = lengths >= capacity
    order = np.lexsort((key[:, 1], key[:, 0]))  # the same bins in whatever order rows come
    part = order[~full[order]]
    bins = local_search(best_fit(lengths[part], capacity), lengths[part], capacity)
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number[full] = np.arange(len(bins), len(bins) + int(full.sum()))
    for n, own in enumerate(bins):
        own = part[own]
        number[own], offset[own] = n, np.cumsum(lengths[own]) - lengths[own]
    return pa.Table.from_arrays([*rows.columns, pa.chunked_array([(group << 32) + number]), pa.chunked_array([offset])], [f"c{i}" for i in range(rows.num_columns + 2)])


def pack(rows: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP) -> DataFrame:
    """``rows`` (doc_id, piece, length at most ``capacity``, and more) with sequence_id and offset.

    Every row gets a place in a sequence of at most ``capacity``; places of a sequence are gapless from 0.  Rows are
    dealt by their number, whatever their keys, to groups of about ``group_rows``, packed apart, which costs less than a
    sequence each.  ``rows`` is read twice, to count it and to pack it: pass a stored table.  An empty table gives none.
    Further columns may have any name; if ``rows`` has a sequence_id or offset of its own, the new one takes its place.
    """
    rows = rows.drop("sequence_id", "offset")
    groups = max(1, -(-rows.count() // group_rows))
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))
    key = F.array(F.coalesce(F.col("doc_id"), F.lit(-1)).cast("long"), F.coalesce(F.col("piece"), F.lit(-1)).cast("long"), F.col("length").cast("long"))
    fields = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rows.columns)]
    dealt = rows.select(number.alias("g"), key.alias("k"), *fields)
    schema = ", ".join(f"c{i} {kind}" for i, (_, kind) in enumerate([*rows.dtypes, ("", "bigint"), ("", "bigint")]))
    return dealt.groupBy("g").applyInArrow(lambda table: _pack(table, capacity), schema).toDF(*rows.columns, "sequence_id", "offset")


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: :func:`pieces` of ``docs``, packed without their ids."""
    cut = pieces(docs, path, capacity).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(stored(cut, "pieces"), capacity)
