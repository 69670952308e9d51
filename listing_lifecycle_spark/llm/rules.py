"""Quality rules with an isolation forest over rule statistics.

Statistics of every text are counted on its bytes.  A forest of random splits is grown on all labelled documents: each
tree draws its rows from all of them, as an isolation forest does, then all of them are sent down every tree, and their
numbers in the leaves give the lengths of its paths.  Texts that few splits set apart have short paths and are anomalous.
The threshold on the score comes from all labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listing_lifecycle_spark.llm.arrow_text import FINE_BYTES, mix, raw, row_of, slices, stored, sums, words

#: Characters that count as symbols, and bytes that end a sentence or line.  Fixed values.
SYMBOLS = b"#*$%&|<>"
ENDS = b".!?:;"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbol_share", "word_length", "upper_share", "mark_share", "sign_words", "repeat_share", "short_words", "double_ends", "distinct_share")
#: Steps that a threshold may lie on.
CUTS = 1 << 16


def _flags(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


BLANK, SYMBOL = _flags(b" \t\n\v\f\r"), _flags(SYMBOLS)
UPPER, LOWER = _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123)))
MARK = _flags(bytes(i for i in range(33, 127) if not chr(i).isalnum() and i not in SYMBOLS and chr(i) not in ".,"))
SOLID = _flags(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))


def repeated(codes: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Whether each word lies in a window of ``width`` words that its row holds twice or more."""
    n, row = len(codes), row_of(offsets)
    cover = np.zeros(n + 1, np.int64)
    if n >= width:
        window = mix(row[: n - width + 1].astype(np.uint64))
        for k in range(width):
            window = mix(window ^ (codes[k : n - width + 1 + k].astype(np.uint64) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)))
        inside = np.flatnonzero(row[: n - width + 1] == row[width - 1 :])
        order = inside[np.argsort(window[inside], kind="stable")]
        same = window[order[1:]] == window[order[:-1]]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        found = order[twice]
        np.add.at(cover, found, 1)
        np.add.at(cover, found + width, -1)
    return np.cumsum(cover)[:n] > 0


def statistics(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Base counts of each text, and the matrix of features made of them."""
    data, offsets = raw(column)
    begin = int(offsets[0])
    text, edges = data[begin : int(offsets[-1])], offsets - begin
    filled = ~BLANK[text]
    lead = (text & 0xC0) != 0x80
    count = lambda flags: sums(flags, edges)
    word_chars, symbols = count(filled & lead), count(SYMBOL[text])
    upper, lower = count(UPPER[text]), count(LOWER[text])
    codes, distinct, at = words(column)
    n = np.diff(at)
    row = row_of(at)
    word_data, word_edges = raw(distinct)
    lengths = np.diff(word_edges)
    solid = np.concatenate([[0], np.cumsum(SOLID[word_data[: int(word_edges[-1])]])])
    signs = (solid[word_edges[1:]] - solid[word_edges[:-1]]) == 0
    ends = _flags(ENDS)
    last, before = word_data[np.maximum(word_edges[1:] - 1, 0)] if len(lengths) else np.zeros(0, np.uint8), word_data[np.maximum(word_edges[1:] - 2, 0)] if len(lengths) else np.zeros(0, np.uint8)
    double = (lengths > 2) & (~SOLID[last]) & (~SOLID[before]) & (ends[last] | SYMBOL[last])
    lines = pc.split_pattern(column, "\n")
    flat, line_at = lines.flatten().dictionary_encode(), lines.offsets.to_numpy().astype(np.int64)
    line_at = line_at - line_at[0]
    line, line_row = flat.indices.to_numpy().astype(np.int64), row_of(line_at)
    worded = (pc.binary_length(pc.ascii_trim_whitespace(flat.dictionary)).to_numpy(zero_copy_only=False) > 0)[line] if len(line) else np.zeros(0, bool)
    kinds = np.unique(line_row[worded] * (len(flat.dictionary) + 1) + line[worded])
    n_lines = np.bincount(line_row[worded], minlength=len(column))
    dup_lines = n_lines - np.bincount(kinds // (len(flat.dictionary) + 1), minlength=len(column))
    repeat = sums(repeated(codes, at, 5), at)
    base = dict(zip(BASE, (n, word_chars, symbols, dup_lines.astype(np.int64), repeat.astype(np.int64))))
    kinds = np.bincount(np.unique(row * (len(distinct) + 1) + codes) // (len(distinct) + 1), minlength=len(column))
    some, chars = np.maximum(n, 1), np.maximum(word_chars, 1)
    features = np.column_stack([
        symbols / chars, word_chars / some, upper / np.maximum(upper + lower, 1), count(MARK[text]) / chars, sums(signs[codes], at) / some,
        repeat / some, sums((lengths <= 3)[codes], at) / some, sums(double[codes], at) / some, kinds / some**0.85,
    ])
    return base, features


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])


@dataclass(frozen=True)
class Forest:
    """Trees as arrays of nodes: feature (-1 at a leaf), split, the two nodes below, path length at a leaf."""

    feature: np.ndarray
    split: np.ndarray
    below: np.ndarray
    path: np.ndarray
    rows: int
    threshold: float

    def leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """The leaf of each row, tree by tree."""
        row = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(64):
                feature = self.feature[t, node]
                if (feature < 0).all():
                    break
                right = x[row, np.maximum(feature, 0)] > self.split[t, node]
                node = np.where(feature < 0, node, self.below[t, node, right.astype(np.int64)])
            yield node

    def levels(self) -> np.ndarray:
        """Splits above each node; a node stands before those below it."""
        out, tree = np.zeros(self.feature.shape, np.int64), np.arange(len(self.feature))
        for node in range(self.feature.shape[1]):
            inner = tree[self.feature[:, node] >= 0]
            out[inner[:, None], self.below[inner, node]] = out[inner, node][:, None] + 1
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score of each row: 2 to the power of minus its mean path length over that of an average search."""
        total = np.zeros(len(x))
        for t, node in enumerate(self.leaves(x)):
            total += self.path[t, node]
        return 2.0 ** (-total / len(self.feature) / average_path(self.rows))


def average_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, float)
    more = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(more) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, trees: int, rows: int, seed: int | list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Random trees, each over ``rows`` rows drawn without replacement and as deep as a balanced tree of these."""
    random, rows = np.random.default_rng(seed), min(rows, len(x))
    depth, size = int(np.ceil(np.log2(max(rows, 2)))), 2 * max(rows, 1)
    feature, split = np.full((trees, size), -1, np.int64), np.zeros((trees, size))
    below, path = np.zeros((trees, size, 2), np.int64), np.zeros((trees, size))
    for t in range(trees):
        todo, free = [(0, random.choice(len(x), rows, replace=False), 0)], 1
        while todo:
            node, own, level = todo.pop()
            low, high = x[own].min(axis=0), x[own].max(axis=0)
            open_ = np.flatnonzero(high > low)
            if level >= depth or len(own) < 2 or not len(open_):
                path[t, node] = level + average_path(len(own))
                continue
            f = random.choice(open_)
            cut = random.uniform(low[f], high[f])
            right = x[own, f] > cut
            feature[t, node], split[t, node], below[t, node] = f, cut, (free, free + 1)
            todo += [(free, own[~right], level + 1), (free + 1, own[right], level + 1)]
            free += 2
    return feature, split, below, path


def calibrated(scores: np.ndarray, good: np.ndarray, least_kept: float) -> float:
    """The score above which a document goes: least errors weighted alike for both labels, with at least
    ``least_kept`` of the good ones kept.  Without both labels, 0.6."""
    cuts, at = np.unique(scores, return_inverse=True)
    return best_cut(cuts, cuts, np.bincount(at[good], minlength=len(cuts)), np.bincount(at[~good], minlength=len(cuts)), least_kept)


def best_cut(low: np.ndarray, high: np.ndarray, good: np.ndarray, bad: np.ndarray, least_kept: float) -> float:
    """:func:`calibrated` for sorted ranges of scores (above ``low`` up to ``high``) with their numbers of both labels."""
    if not good.sum() or not bad.sum():
        return 0.6
    kept_good, gone_bad = np.cumsum(good) / good.sum(), 1 - np.cumsum(bad) / bad.sum()
    i = int(np.argmax(np.where(kept_good >= least_kept, kept_good + gone_bad, -1)))
    return float((high[i] + max(low[min(i + 1, len(low) - 1)], high[i])) / 2)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, size=2 * FINE_BYTES):
        base, features = statistics(batch.column(1))
        batch, features = batch.filter(pa.array(~base_failed(base))), features[~base_failed(base)]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * features.shape[1], pa.int32()), pa.array(features.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "features"])


def agreed_labels(labels: DataFrame, *columns: str) -> DataFrame:
    """One row for each labelled id.  Ids with a null or contradictory label are left out."""
    plain = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[x for c in columns for x in (F.min(c).alias(c), F.max(c).alias(f"{c}_max"), F.count(F.when(F.col(c).isNull(), 1)).alias(f"{c}_null"))])
    for c in columns:
        plain = plain.where((F.col(c) == F.col(f"{c}_max")) & (F.col(f"{c}_null") == 0))
    return plain.select("doc_id", *columns)


def sampled_labels(labels: DataFrame, bound: int, *columns: str) -> DataFrame:
    """At most ``bound`` labelled ids, the same ones in every run: those with the least hash.  Ids with a null or
    contradictory label are left out."""
    return least_hashes(agreed_labels(labels, *columns), bound, 11)


def least_hashes(rows: DataFrame, bound: int, salt: int) -> DataFrame:
    """The ``bound`` rows whose doc_id has the least hash, or all; ``rows`` is unique on doc_id.

    Rows are counted first and only about as many as are wanted reach the sort, however many partitions there are.
    """
    number = F.xxhash64("doc_id", F.lit(salt))
    share = min(1.0, (1.3 * bound + 500) / max(rows.count(), 1))
    top = min(-(2**63) + int(share * 2**64), 2**63 - 1)
    return rows.where(number <= F.lit(top)).orderBy(number, "doc_id").limit(bound)


def measured(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, good, features of every labelled document that passes the base rules, once each; the table is stored.

    Texts are measured where they are, and only their features meet the labels.  Of several rows with a doc_id the
    least features count.
    """
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(_measure, "doc_id bigint, features array<double>")
    known = agreed_labels(labels, "quality").select("doc_id", (F.col("quality") == 1).alias("good"))
    return stored(rows.join(known, "doc_id").groupBy("doc_id").agg(F.min("good").alias("good"), F.min("features").alias("features")), "features")


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))


def _draw(batches: Iterator[pa.RecordBatch], trees: int, share: float, seed: int) -> Iterator[pa.RecordBatch]:
    """The rows that may be among those of least hash in a tree: tree, number, doc_id, features."""
    for batch in batches:
        own = mix(batch.column(0).to_numpy().astype(np.uint64) + np.uint64(seed))
        for t in range(trees):
            number = mix(own + np.uint64((t + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(1)
            at = np.flatnonzero(number <= share * 2.0**63)
            if len(at):
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(number[at].astype(np.int64)), rows.column(0), rows.column(2)], ["tree", "number", "doc_id", "features"])


def _grow(group: pa.Table, rows: int, seed: int) -> pa.Table:
    """One tree on the ``rows`` rows of least hash."""
    least = group.sort_by([("number", "ascending"), ("doc_id", "ascending")]).slice(0, rows).combine_chunks().to_batches()[0]
    tree = least.column(0)[0].as_py()
    feature, split, below, _ = grow(_matrix(least, 3), 1, rows, [seed, tree])
    return pa.table({"tree": pa.array([tree], pa.int32()), **{n: pa.array([x.tobytes()], pa.binary()) for n, x in (("feature", feature), ("split", split), ("below", below))}})


def _fill(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    """How many rows of a task end in each leaf; leaves are numbered through all trees."""
    size, filled = forest.feature.shape[1], np.zeros(forest.feature.size, np.int64)
    for batch in batches:
        for t, node in enumerate(forest.leaves(_matrix(batch, 0))):
            filled[t * size : (t + 1) * size] += np.bincount(node, minlength=size)
    at = np.flatnonzero(filled)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(filled[at])], ["leaf", "rows"])


def _tally(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    """How many good and bad rows of a task score in each of ``CUTS`` ranges."""
    counts = np.zeros((2, CUTS + 1), np.int64)
    for batch in batches:
        at, good = np.ceil(forest.scores(_matrix(batch, 1)) * CUTS).astype(np.int64), batch.column(0).to_numpy(zero_copy_only=False)
        counts += [np.bincount(at[good], minlength=CUTS + 1), np.bincount(at[~good], minlength=CUTS + 1)]
    at = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), *map(pa.array, counts[:, at])], ["at", "good", "bad"])


def fit(docs: DataFrame, labels: DataFrame, trees: int = 300, rows: int = 128, least_kept: float = 0.99, seed: int = 7) -> Forest:
    """Grow the forest on all labelled documents, less those that fail the base rules, and set its threshold by all their
    labels.

    Every labelled document can be drawn for every tree, all count in the leaves, and all scores and labels in the
    threshold, which lies on one of ``CUTS`` steps.  Trees are grown in tasks; what comes to the driver is as large as
    the forest, and one row for each step, however many documents there are.
    """
    table = measured(docs, labels)
    n = table.count()
    if not n:
        return Forest(np.full((1, 1), -1), np.zeros((1, 1)), np.zeros((1, 1, 2), np.int64), np.zeros((1, 1)), 2, 1.0)
    drawn = table.mapInArrow(partial(_draw, trees=trees, share=min(1.0, (1.5 * rows + 100) / n), seed=seed), "tree int, number bigint, doc_id bigint, features array<double>")
    grown = drawn.groupBy("tree").applyInArrow(lambda group: _grow(group, rows, seed), "tree int, feature binary, split binary, below binary").orderBy("tree").collect()
    size = max(len(r.feature) for r in grown) // 8
    feature, split, below = np.full((len(grown), size), -1, np.int64), np.zeros((len(grown), size)), np.zeros((len(grown), size, 2), np.int64)
    for t, r in enumerate(grown):
        own = len(r.feature) // 8
        feature[t, :own], split[t, :own], below[t, :own] = np.frombuffer(r.feature, np.int64), np.frombuffer(r.split), np.frombuffer(r.below, np.int64).reshape(own, 2)
    forest = Forest(feature, split, below, np.zeros(feature.shape), n, 0.0)
    filled = np.zeros(feature.size, np.int64)
    for r in table.select("features").mapInArrow(partial(_fill, forest=forest), "leaf bigint, rows bigint").groupBy("leaf").agg(F.sum("rows").alias("rows")).collect():
        filled[r.leaf] = r.rows
    forest = replace(forest, path=forest.levels() + average_path(filled.reshape(feature.shape)))
    tallied = table.select("good", "features").mapInArrow(partial(_tally, forest=forest), "at bigint, good bigint, bad bigint")
    at, good, bad = np.array(tallied.groupBy("at").agg(F.sum("good"), F.sum("bad")).orderBy("at").collect(), np.int64).T
    return replace(forest, threshold=best_cut((at - 1) / CUTS, at / CUTS, good, bad, least_kept))


def _judge(batches: Iterator[pa.RecordBatch], forest: Forest, text: int, keep_all: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, text, 2 * FINE_BYTES):
        base, features = statistics(batch.column(text))
        failed = base_failed(base)
        score = forest.scores(features)
        kept = ~failed & (score <= forest.threshold)
        if keep_all:
            columns = [batch.column(0), *[pa.array(base[c]) for c in BASE], pa.array(failed), pa.array(kept), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *BASE, "base_failed", "kept", "score"])
        else:
            yield batch.filter(pa.array(kept))


def judge(docs: DataFrame, forest: Forest) -> DataFrame:
    """Statistics and verdict of every whole text: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, score (anomaly, 0 to 1).

    A row for each row of ``docs``, without a shuffle.  A null or empty text has no words and fails; repeated rows and
    null doc_ids stay; an empty table gives none.
    """
    schema = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in BASE) + ", base_failed boolean, kept boolean, score double"
    return docs.select("doc_id", "text").mapInArrow(partial(_judge, forest=forest, text=1, keep_all=True), schema)


def keep(docs: DataFrame, forest: Forest) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that :func:`judge` keeps."""
    return docs.mapInArrow(partial(_judge, forest=forest, text=docs.columns.index("text"), keep_all=False), docs.schema)
