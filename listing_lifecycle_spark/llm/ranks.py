"""Exact ranks by parallel sorting with regular sampling.

Every partition is sorted on its own (a run) and gives each ``step``-th row, at regular places, as a sample.  The sorted
samples give splitters at regular places again; rows go to the segment between two splitters, whose parts of all runs
are merged by one task each.  The number of rows in earlier segments plus the place in its own is a row's rank.  Only
segments that hold one of the wanted ranks are exchanged at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

SEGMENT_ROWS = 1 << 14  # rows of a segment, as long as there are no more segments than
SEGMENTS = 1 << 14
SAMPLES = 8  # samples for each segment
GOLDEN = 0.6180339887498949


def _records(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), [(f"k{i}", np.int64) for i in range(len(columns))])
    for i, c in enumerate(columns):
        out[f"k{i}"] = c
    return out


def _sample(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
    """Each ``step``-th row; where the first one lies differs from run to run, so that short runs count too."""
    due = int(TaskContext.get().partitionId() * GOLDEN % 1 * step)
    for batch in batches:
        places = np.arange(due, batch.num_rows, step)
        due += len(places) * step - batch.num_rows
        if len(places):
            yield batch.take(pa.array(places))


def _deal(batches: Iterator[pa.RecordBatch], splitters: np.ndarray, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their segment; -1 for rows that take no part."""
    for batch in batches:
        part = batch.column("takes_part").to_numpy(zero_copy_only=False)
        rows = _records([np.where(part, batch.column(k).fill_null(0).to_numpy(zero_copy_only=False), 0) for k in keys])
        segment = np.where(part, np.searchsorted(splitters, rows, side="right"), -1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment.astype(np.int32))], [*batch.schema.names, "segment"])


def _number(batches: Iterator[pa.RecordBatch], before: np.ndarray, wanted: int) -> Iterator[pa.RecordBatch]:
    """Ranks of rows sorted by segment and key; none beyond ``wanted``."""
    last, seen = -1, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        segment = batch.column("segment").to_numpy()
        place = np.arange(len(segment)) - np.searchsorted(segment, segment)
        place[segment == last] += seen
        last, seen = int(segment[-1]), int(place[-1]) + 1
        rank = before[segment] + place + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank, mask=rank > wanted)], [*batch.schema.names, "rank"])


def ranked(rows: DataFrame, keys: list[str], wanted: int, count: int, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """``rows`` with ``rank`` (long): 1, 2, 3 ... in ascending order of ``keys`` for the ``wanted`` first, else null.

    ``keys`` are long columns that together tell rows apart (ties are dealt as one, so a last unique column keeps
    segments even).  Only rows whose column ``takes_part`` is true count, ``count`` in all; the others get null.  ``rows``
    is read more than once: pass a stored table, without columns ``segment`` and ``rank``.
    """
    if wanted < 1 or count < 1:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    schema = StructType([*rows.schema, StructField("segment", IntegerType())])
    segments = min(SEGMENTS, -(-count // segment_rows))
    splitters = _records([np.zeros(0, np.int64) for _ in keys])
    if segments > 1:
        runs = rows.where("takes_part").select(*keys).sortWithinPartitions(*keys)
        step = max(1, count // (segments * SAMPLES))
        samples = runs.mapInArrow(partial(_sample, step=step), runs.schema).toArrow()  # count / step rows, at most SEGMENTS * SAMPLES and a few
        samples = np.sort(_records([samples.column(k).to_numpy() for k in keys]))
        splitters = samples[np.arange(1, segments) * len(samples) // segments] if len(samples) else splitters
    dealt = rows.mapInArrow(partial(_deal, splitters=splitters, keys=keys), schema)
    counts = np.zeros(segments, np.int64)
    for row in dealt.where("segment >= 0").groupBy("segment").count().collect():  # a row for each segment
        counts[row["segment"]] = row["count"]
    before = np.cumsum(counts) - counts
    last = int(np.flatnonzero(before < wanted)[-1])  # segments beyond hold no wanted rank
    chosen = dealt.where(F.col("segment").between(0, last)).repartitionById(last + 1, F.col("segment")).sortWithinPartitions("segment", *keys)
    numbered = chosen.mapInArrow(partial(_number, before=before, wanted=wanted), StructType([*dealt.schema, StructField("rank", LongType())]))
    rest = dealt.where(~F.col("segment").between(0, last)).withColumn("rank", F.lit(None).cast("long"))
    return numbered.unionByName(rest).drop("segment")
