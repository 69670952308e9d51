"""Token counts of whole texts with a whole-token shortcut.

Before any text is read, every vocabulary string is merged on its own; those that come out as the one token they name
are proven whole.  A pre-token equal to such a string counts as one without merging; only the rest is merged, each
distinct pre-token once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listing_lifecycle_spark.llm.arrow_text import raw, slices, sums
from listing_lifecycle_spark.llm.bpe import Memory, Pairs, coded, merge_pieces, pre_tokens


@cache
def byte_alphabet() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteVocabulary:
    """A byte-level vocabulary with a list of merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, letters = content["model"], byte_alphabet()
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.byte = np.full(256, -1, np.int32)
        for letter, b in letters.items():
            self.byte[b] = vocab[letter]
        self.pairs = Pairs(*zip(*[(vocab[a], vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)]))
        special = [t["content"] for t in content["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        strings = [(bytes(letters[c] for c in s), i) for s, i in vocab.items() if all(c in letters for c in s)]
        texts = pa.array([s for s, _ in strings], pa.large_binary())
        flat, counts = self.merged(texts)
        first = flat[np.cumsum(counts) - counts]
        self.whole = {s for (s, i), n, got in zip(strings, counts.tolist(), first.tolist()) if n == 1 and got == i}
        self.memory = Memory(self.counts)

    def merged(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = raw(pieces)
        return merge_pieces(data, offsets[:-1], np.diff(offsets), lambda b, _: self.byte[b], self.pairs)

    def counts(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens each distinct pre-token has; ids are not kept."""
        whole = self.whole
        apart = np.array([p not in whole for p in pieces.to_numpy(zero_copy_only=False)], bool)
        out = np.ones(len(pieces), np.int64)
        if apart.any():
            out[apart] = self.merged(pieces.filter(pa.array(apart)))[1]
        return np.zeros(0, np.int32), out


@cache
def vocabulary(path: str) -> ByteVocabulary:
    """The vocabulary at ``path``, read and proven once by a worker."""
    return ByteVocabulary(path)


def _parts(text: pa.Array, special: re.Pattern | None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts without the special strings, the row of each part, and how many special strings each row has."""
    rows, found = np.arange(len(text)), np.zeros(len(text), np.int64)
    if special is None:
        return text, rows, found
    has = pc.match_substring_regex(text, special.pattern).to_numpy(zero_copy_only=False)
    if not has.any():
        return text, rows, found
    cut, row = [], []
    for i, (value, marked) in enumerate(zip(text.to_pylist(), has)):
        pieces = special.split(value) if marked else [value]
        cut += pieces
        row += [i] * len(pieces)
        found[i] = len(pieces) - 1
    return pa.array(cut, pa.large_string()), np.array(row), found


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = vocabulary(path)
    for batch in slices(batches):
        text, row, found = _parts(batch.column(1), model.special)
        data, offsets = raw(text)
        starts = pre_tokens(data, offsets)
        codes, distinct = coded(data, starts, int(offsets[-1]))
        place = model.memory.of(distinct)
        counts = model.memory.count[place][codes]
        per_part = sums(counts, np.searchsorted(starts, offsets))
        total = found + np.bincount(row, per_part, minlength=batch.num_rows).astype(np.int64)
        size = np.diff(raw(batch.column(1))[1])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(total)], ["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Tokens of each whole text by the byte-level BPE file at ``path``: doc_id, n_bytes, n_tokens, over_limit.

    No begin, end or added special token is counted; a special string inside a text counts as its one token, as the
    library does by default.  ``over_limit`` is n_tokens > ``limit``.  A row for each row of ``docs`` without a shuffle:
    a null text counts as empty (0 bytes, 0 tokens), repeated rows and null doc_ids stay, an empty table gives none.
    """
    counted = docs.select("doc_id", "text").mapInArrow(partial(_count, path=path), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
