"""Substring dedup by content-defined chunking with a gear rolling hash.

The gear hash of the last ``WINDOW`` bytes is worked out for every place at once.  A chunk begins where the hash is the
greatest within ``reach`` bytes on both sides; places where a word begins go before other characters.  That depends on
the bytes around a place only, so an insertion moves the cuts near it and no others.  Chunks are told apart by a digest;
all but the first occurrence of a digest are repeats, and stretches of repeats of enough words are cut out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listing_lifecycle_spark.llm.arrow_text import FINE_BYTES, raw, slices, spread, stored
from listing_lifecycle_spark.llm.neardup import few
from listing_lifecycle_spark.llm.rules import BLANK

WINDOW = 16
REACH = 16
LEAST_WORDS = 20
LARGEST = 1 << 12
GEAR = np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)


def gear_hash(value: np.ndarray) -> np.ndarray:
    """At each place the sum of ``value << distance`` over the last ``WINDOW`` places, the place itself included."""
    value, span = value.copy(), 1
    while span < WINDOW:
        value[span:] = value[span:] + (value[:-span] << np.uint32(span))
        span *= 2
    return value


def greatest(value: np.ndarray, reach: int) -> np.ndarray:
    """The greatest of the ``reach`` values that follow each place, the place itself not counted; 0 beyond the end."""
    out, span = np.concatenate([value[1:], np.zeros(1, value.dtype)]), 1
    while span < reach:
        step = min(span, reach - span)
        moved = np.zeros_like(out)
        moved[:-step] = out[step:]
        out = np.maximum(out, moved)
        span += step
    return out


def cuts(text: np.ndarray, offsets: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Places where chunks begin; every row's first place is one.  ``offsets`` are the rows' ends in ``text``."""
    lengths = np.diff(offsets)
    pad = max(WINDOW, reach)  # places without bytes keep the rows apart
    place = spread(np.cumsum(lengths + pad) - lengths, lengths)
    n = int(lengths.sum()) + pad * len(lengths)
    blank = BLANK[text]
    word = ~blank
    word[1:] &= blank[:-1]
    starts = offsets[:-1][lengths > 0]
    word[starts] = ~blank[starts]
    gear, before = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    gear[place] = GEAR[text]
    before[1:] = gear_hash(gear)[:-1]  # the bytes before a place decide, so a cut depends on nothing to its right but rivals
    rank = np.zeros(n, np.uint32)
    rank[place] = np.where((text & 0xC0) == 0x80, 0, before[place] >> np.uint32(2) | np.uint32(1) | word.astype(np.uint32) << np.uint32(31))
    right, left = greatest(rank, reach)[place], greatest(rank[::-1], reach)[::-1][place]
    cut = (rank[place] > right) & (rank[place] > left)
    cut[starts] = True
    n = len(text)
    at = np.flatnonzero(cut)
    size = np.diff(np.append(at, n))
    if len(at) and size.max() > LARGEST:  # a long stretch without a greatest place: every LARGEST bytes
        more = [np.arange(a + LARGEST, a + s, LARGEST) for a, s in zip(at[size > LARGEST], size[size > LARGEST])]
        more = np.concatenate(more)
        while ((text[more] & 0xC0) == 0x80).any():
            more = more - ((text[more] & 0xC0) == 0x80)
        at = np.union1d(at, more)
    return at


def chunk_table(column: pa.Array, reach: int = REACH):
    """Row, start, stop (bytes in the row), words, 64-bit digest of each chunk, and whether its row has it before."""
    data, offsets = raw(column)
    text, edges = np.ascontiguousarray(data[int(offsets[0]) : int(offsets[-1])]), offsets - offsets[0]
    at = cuts(text, edges, reach) if len(text) else np.zeros(0, np.int64)
    end = np.append(at[1:], len(text)) if len(at) else at
    row = np.searchsorted(edges, at, side="right") - 1
    begins = ~BLANK[text]
    begins[1:] &= BLANK[text][:-1]
    begins[edges[:-1][np.diff(edges) > 0]] = ~BLANK[text[edges[:-1][np.diff(edges) > 0]]]
    count = np.concatenate([[0], np.cumsum(begins)])
    memory = memoryview(text)
    digests = b"".join([hashlib.blake2b(memory[a:b], digest_size=8).digest() for a, b in zip(at.tolist(), end.tolist())])
    digest = np.frombuffer(digests, np.int64)
    order = np.lexsort((digest, row))
    again = np.zeros(len(at), bool)
    again[order[1:]] = (digest[order[1:]] == digest[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    return row, at - edges[row], end - edges[row], count[end] - count[at], digest, again


def _chunks(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, size=FINE_BYTES):
        row, start, stop, words, digest, again = chunk_table(batch.column(1), reach)
        data, offsets = raw(batch.column(1))
        check = np.array([zlib.crc32(data[a:b]) % 2**31 for a, b in zip(offsets, offsets[1:])], np.int32)
        columns = [batch.column(0).take(pa.array(row)), pa.array(check[row]), *[pa.array(x.astype(np.int32)) for x in (start, stop, words)], pa.array(digest), pa.array(again)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "check", "start", "stop", "words", "digest", "again"])


def repeats(docs: DataFrame, least_words: int = LEAST_WORDS, reach: int = REACH) -> DataFrame:
    """Repeated passages: doc_id, check (31 bits of the text's crc32), start, stop (bytes of UTF-8), n_words, first_doc_id.

    A row for each stretch of neighbouring chunks of a text that occur before it - in a document of smaller doc_id or
    earlier in the text - with at least ``least_words`` words; ``first_doc_id`` is the least that has one of its chunks.
    The first occurrence stays out of the result.  Chunks follow bytes, not words: cuts are the same at any offset only
    from ``WINDOW + reach`` bytes after a passage begins to ``reach`` before it ends, and parts of a chunk at both sides are
    lost too, some 90 bytes in all.  Passages of 50 words of usual length (6 bytes with the blank) keep 20 words beyond
    that; 50 words of one or two letters may not, and then stay in the text.  Texts that are null or empty have no chunks,
    nor take rows without doc_id part; repeated rows count as one document, as do rows of one doc_id with other texts,
    among which nothing is a repeat.
    """
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    chunks = rows.mapInArrow(partial(_chunks, reach=reach), "doc_id bigint, check int, start int, stop int, words int, digest bigint, again boolean")
    seen = chunks.groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.count(F.lit(1)).alias("times"))
    later = chunks.join(seen.where("times > 1").select("digest", "first_doc_id"), "digest").where("again OR doc_id > first_doc_id")
    by_text = Window.partitionBy("doc_id", "check").orderBy("start")
    apart = F.coalesce(F.lag("stop").over(by_text) < F.col("start"), F.lit(True)).cast("int")
    stretch = later.select("doc_id", "check", "start", "stop", "words", "first_doc_id").distinct().withColumn("apart", apart)
    stretch = stretch.withColumn("stretch", F.sum("apart").over(by_text.rowsBetween(Window.unboundedPreceding, 0)))
    spans = stretch.groupBy("doc_id", "check", "stretch").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("words").alias("n_words"), F.min("first_doc_id").alias("first_doc_id"))
    return spans.where(F.col("n_words") >= least_words).select("doc_id", "check", "start", "stop", "n_words", "first_doc_id")


def cut_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, reach: int = REACH) -> DataFrame:
    """``docs`` with the stretches that :func:`repeats` finds cut out of ``text``; other columns and all rows stay.

    A text may become empty.  Cuts lie where words begin, in text without blanks between characters.  Further columns may
    have any name.
    """
    spans = stored(repeats(docs, least_words, reach), "spans")
    spans = spans.groupBy("doc_id", "check").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    spans = few(spans.select(F.col("doc_id").alias("span_doc_id"), F.col("check").alias("span_check"), "spans"), 100_000)
    names = docs.columns  # those of the documents go by their places, so none of them clashes with the spans'
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, words = (F.col(f"c{names.index(name)}") for name in ("doc_id", "text"))
    bytes_ = F.encode(words, "UTF-8")
    edges = F.concat(F.array(F.lit(0)), F.flatten(F.transform("spans", lambda s: F.array(s["start"], s["stop"]))), F.array(F.octet_length(words)))
    pieces = F.transform(F.sequence(F.lit(0), F.size("spans")), lambda i: F.decode(F.substring(bytes_, F.get(edges, 2 * i) + 1, F.get(edges, 2 * i + 1) - F.get(edges, 2 * i)), "UTF-8"))
    text = F.when(F.col("spans").isNull(), words).otherwise(F.array_join(pieces, ""))
    joined = own.join(spans, (doc_id == F.col("span_doc_id")) & ((F.crc32(words) % 2**31).cast("int") == F.col("span_check")), "left")
    return joined.select(*[text.alias(f"c{i}") if c == "text" else F.col(f"c{i}") for i, c in enumerate(names)]).toDF(*names)
