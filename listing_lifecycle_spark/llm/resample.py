"""Importance resampling towards a target corpus.

Words of all documents and of the target corpus are counted by hashed bucket; the log ratio of a bucket's shares is its
gain, a document's weight the mean gain of its features.  Weights are worked out in arrays from one table of gains, a
fixed random term by doc_id makes the draw one without replacement, and the drawn get their exact rank from a parallel
sort by regular sampling (:mod:`ranks`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listing_lifecycle_spark.llm.arrow_text import release, row_of, slices, stored
from listing_lifecycle_spark.llm.ranks import ranked
from listing_lifecycle_spark.llm.runs import crc32_of, runs

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True  # bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]


def features(column: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of each feature, and the number of words of each row.

    Features are all runs of 1 to ``longest`` words of a row, joined by a space.
    """
    flat, at = runs(column, lambda b: WORD[b])
    coded = flat.dictionary_encode()
    row, codes = row_of(at), coded.indices.to_numpy().astype(np.int64)
    parts, rows = [(crc32_of(coded.dictionary) % np.uint32(buckets))[codes]], [row]
    grams, left = flat, at[1:][row] - np.arange(len(row))
    for k in range(2, longest + 1):
        here = np.flatnonzero(left >= k)  # words that have k - 1 more after them in their row
        grams = pc.binary_join_element_wise(grams.take(pa.array(np.flatnonzero(left[left >= k - 1] >= k))), flat.take(pa.array(here + k - 1)), " ")
        distinct = grams.dictionary_encode()
        parts.append((crc32_of(distinct.dictionary) % np.uint32(buckets))[distinct.indices.to_numpy().astype(np.int64)])
        rows.append(row[here])
    return np.concatenate(parts).astype(np.int64), np.concatenate(rows), np.diff(at)


def _count(batches: Iterator[pa.RecordBatch], longest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in slices(batches, column=0):
        total += np.bincount(features(batch.column(0), longest, buckets)[0], minlength=buckets)
    filled = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(total[filled])], ["bucket", "n"])


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Features of all texts in each bucket: one row of a bucket leaves a task, ``buckets`` rows reach the driver."""
    rows = texts.select("text").where("text IS NOT NULL").mapInArrow(partial(_count, longest=longest, buckets=buckets), "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    for row in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed share of each bucket in the target by that in the source."""
    buckets, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    ratio = (target + 1.0) * (s_all + buckets) / ((source + 1.0) * (t_all + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def _weigh(batches: Iterator[pa.RecordBatch], gain: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        bucket, row, n_words = features(batch.column(1), longest, len(gain))
        n = np.bincount(row, minlength=batch.num_rows)
        total = np.bincount(row, weights=gain[bucket], minlength=batch.num_rows).astype(np.int64)  # whole numbers far below 2^53
        columns = [batch.column(0), pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])
    release()


def weights(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """doc_id, n_words, n_features, weight (the floored mean gain, 0 without features) of each row."""
    schema = "doc_id bigint, n_words bigint, n_features bigint, weight bigint"
    return docs.select("doc_id", "text").mapInArrow(partial(_weigh, gain=gain, longest=longest), schema)


def random_term(seed: int):
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256 of ``<seed>:<doc_id>``: the same in every run."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10000, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; rank is null for rows that aren't drawn.

    Of the N rows with doc_id and at least ``least_words`` words, the floor(``percent`` * N / 100) of highest score are
    drawn, ties to the smaller doc_id.  ``docs`` has doc_id and text, ``target`` text; other columns are not read.  Words
    are runs of 0-9, a-z (A-Z lower-cased) and all characters beyond ASCII.  Null, empty and wordless texts have no
    features, weight 0 and no rank.  A row without doc_id counts in the corpus but has neither score nor rank.  Repeated
    rows have equal scores and ranks one after the other.  An empty ``docs`` gives no rows, an empty target equal shares.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    scored = weights(docs, gain, longest).withColumn("score", F.col("weight") + random_term(seed))
    takes_part = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    keyed = scored.withColumns({"takes_part": takes_part, "fall": -F.col("score"), "row": F.monotonically_increasing_id()})
    rows = stored(keyed, "scored")
    count = rows.where("takes_part").count()
    return ranked(rows, ["fall", "doc_id", "row"], percent * count // 100, count).select("doc_id", "n_features", "weight", "score", "rank")
