"""Quality classifier with supervised subword embeddings.

A document is the average of learned vectors of its words, word pairs and character n-grams, all hashed into one table;
a softmax layer turns it into a probability.  The table is trained by stochastic gradient descent in numpy on a bounded
sample of labelled documents.  As averaging and the last layer are linear, scoring needs one number per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listing_lifecycle_spark.llm.arrow_text import FINE_BYTES, hashes, mix, raw, release, row_of, slices, spread, sums, words
from listing_lifecycle_spark.llm.rules import sampled_labels

BITS = 16
GRAMS = (3, 4, 5)
#: A word followed by itself is one feature, whatever the word.
TWICE = np.uint64(0x5851F42D4C957F2D)
EDGE = 0x20  # stands before and after a word; no word holds a space


def gram_buckets(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of each word with its edges, one word after the other, and how many each has."""
    data, offsets = raw(distinct)
    lengths = np.diff(offsets)
    size = lengths + 2
    text = np.full(int(size.sum()), EDGE, np.uint64)
    text[spread(np.cumsum(size) - size + 1, lengths)] = data[offsets[0] : offsets[-1]]
    begin = np.cumsum(size) - size
    counts = np.zeros((len(GRAMS), len(lengths)), np.int64)
    out = []
    for i, n in enumerate(GRAMS):
        counts[i] = np.maximum(size - n + 1, 0)
        at = spread(begin, counts[i])
        key = np.full(len(at), n << 56, np.uint64)
        for k in range(n):
            key |= text[at + k] << np.uint64(8 * k)
        out.append((mix(key) >> np.uint64(64 - BITS)).astype(np.int64))
    total = counts.sum(axis=0)
    flat, first = np.zeros(int(total.sum()), np.int64), np.cumsum(total) - total
    for i in range(len(GRAMS)):
        flat[spread(first + counts[:i].sum(axis=0), counts[i])] = out[i]
    return flat, total


def features(column: pa.Array):
    """Word codes and row offsets, each distinct word's bucket and n-gram buckets, pair buckets and their row offsets."""
    codes, distinct, at = words(column)
    key = hashes(distinct, seed=3)
    grams, counts = gram_buckets(distinct)
    row = row_of(at)
    first = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
    pair = mix(key[codes[first]] * np.uint64(0x9E3779B97F4A7C15) + key[codes[first + 1]])
    pair[codes[first] == codes[first + 1]] = TWICE
    shift = np.uint64(64 - BITS)
    pair_at = np.concatenate([[0], np.cumsum(np.maximum(np.diff(at) - 1, 0))])
    return codes, at, (key >> shift).astype(np.int64), grams, counts, (pair >> shift).astype(np.int64), pair_at


@dataclass(frozen=True)
class Model:
    """Margin of each bucket for the label 1, and the bias."""

    margin: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        codes, at, word, grams, counts, pair, pair_at = features(column)
        gram_sum = sums(self.margin[grams], np.concatenate([[0], np.cumsum(counts)]))
        total = sums((self.margin[word] + gram_sum)[codes], at) + sums(self.margin[pair], pair_at)
        n = sums((counts + 1)[codes], at) + np.diff(pair_at)
        return 1 / (1 + np.exp(-(total / np.maximum(n, 1) + self.bias)))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of each document, ascending, and their shares of its features.

    Counted document by document over its distinct words: a list of all n-grams would be a hundred times the text.
    """
    for batch in slices(batches, size=FINE_BYTES):
        codes, at, word, grams, counts, pair, pair_at = features(batch.column(1))
        first, out = np.cumsum(counts) - counts, ([], [])
        for row in range(batch.num_rows):
            own, n = np.unique(codes[at[row] : at[row + 1]], return_counts=True)
            times = np.bincount(pair[pair_at[row] : pair_at[row + 1]], minlength=1 << BITS).astype(np.float64)
            times += np.bincount(word[own], n, 1 << BITS)
            times += np.bincount(grams[spread(first[own], counts[own])], np.repeat(n, counts[own]), 1 << BITS)
            bucket = np.flatnonzero(times)
            times = times[bucket].astype(np.float32)
            out[0].append(bucket.astype(np.uint16).tobytes())
            out[1].append((times / max(times.sum(), 1)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.binary()) for x in out]], ["doc_id", "buckets", "weights"])


def descend(rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int, epochs: int, rate: float, seed: int) -> Model:
    """Stochastic gradient descent, one document at a time; every bucket occurs once in a document's row."""
    random = np.random.default_rng(seed)
    table = random.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    good = float(np.mean([y for *_, y in rows])) if rows else 1.0
    layer, bias = np.zeros((dim, 2), np.float32), np.log(np.array([1 - good, good]).clip(0.01, 0.99)).astype(np.float32)
    steps, step = max(epochs * len(rows), 1), 0
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            bucket, weight, y = rows[i]
            bucket = bucket.astype(np.int64)
            part = table[bucket]
            hidden = weight @ part
            logits = hidden @ layer + bias
            chance = np.exp(logits - logits.max())
            error = chance / chance.sum()
            error[y] -= 1
            now = np.float32(rate * (1 - step / steps))
            table[bucket] = part - now * weight[:, None] * (layer @ error)[None, :]
            layer -= now * np.outer(hidden, error)
            bias -= np.float32(0.1) * now / np.float32(rate) * error
            step += 1
    return Model((table @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, trained_on: Column | None = None, label: str = "quality", sample: int = 3000, dim: int = 16, epochs: int = 6, rate: float = 4.0, seed: int = 7) -> Model:
    """Learn from at most ``sample`` labelled documents (those with the least hash of their id) that meet ``trained_on``.

    The bound is this parameter: its ids are broadcast, and one row of bucket weights per document (at most 2^16
    entries) comes to the driver, where the descent runs.  Labels other than 0 and 1 are left out; without any labelled
    text the score is the share of the label 1 that the descent assumes.
    """
    known = labels.where(F.col(label).isin(0, 1))
    chosen = sampled_labels(known.where(trained_on) if trained_on is not None else known, sample, label)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text")
    found = texts.mapInArrow(_vectors, "doc_id bigint, buckets binary, weights binary").dropDuplicates(["doc_id"]).join(F.broadcast(chosen), "doc_id").orderBy("doc_id").toLocalIterator()
    # One partition at a time is in the driver's JVM; rows are views of what has come, nothing is copied.
    rows = [(np.frombuffer(r.buckets, np.uint16), np.frombuffer(r.weights, np.float32), int(r[label])) for r in found]
    model = descend(rows, dim, epochs, rate, seed)
    del rows, found
    release()
    return model


def _score(batches: Iterator[pa.RecordBatch], model: Model, text: int, keep_from: float | None) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, text, FINE_BYTES):
        score = model.scores(batch.column(text))
        if keep_from is None:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])
        else:
            yield batch.filter(pa.array(score >= keep_from))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1, probability of the label 1) of every whole text, without a shuffle.

    A null, empty or blank text gets the score of no words at all; repeated rows and null doc_ids stay; an empty table
    gives none.
    """
    return docs.select("doc_id", "text").mapInArrow(partial(_score, model=model, text=1, keep_from=None), "doc_id bigint, score double")


def keep(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score at least ``least``."""
    return docs.mapInArrow(partial(_score, model=model, text=docs.columns.index("text"), keep_from=least), docs.schema)
