"""Listing state fed by a stream of observations.

Two forms here (a third, with timers, is in :mod:`keyed`).  ``running_state`` keeps first and latest sighting per listing in
Spark's own keyed state.  ``ObservationSink`` merges each micro-batch into a
versioned state with the rules of a run (insert, change, return, stale guard).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from listing_lifecycle_spark.operators import lifecycle
from listing_lifecycle_spark.sources.versions import BUCKETS, VersionedTables, bucket_of


def running_state(observations: DataFrame, order: tuple[str, ...] = ("observed_at", "content_hash")) -> DataFrame:
    """Per listing the first sighting and the content of the latest.

    The latest is chosen by ``order`` (event time, then what decides between
    observations of one instant), so an observation that arrives late
    counts as a sighting but overwrites nothing.  Written in update mode; partial
    aggregates are combined before the state is touched, so a hot listing costs
    one state update per task and micro-batch.
    """
    return observations.groupBy("external_id").agg(
        F.min("observed_at").alias("first_seen_at"),
        F.max("observed_at").alias("last_seen_at"),
        F.max_by("content_hash", F.struct(*order)).alias("content_hash"),
        F.count(F.lit(1)).alias("sightings"),
    )


class ObservationSink:
    """Micro-batch writer that merges observations into the state table of ``tables``.

    A batch id that was committed before is skipped, so a restart that repeats
    the last batch changes nothing.
    """

    def __init__(self, tables: VersionedTables, empty_state: DataFrame, order: list[str], *, buckets: int = BUCKETS):
        self.tables = tables
        self.empty_state = empty_state
        self.order = order
        self.buckets = buckets

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        key = f"observations-{batch_id}"
        if self.tables.has_batch(key):
            return
        # Only buckets that hold a listing of the batch are read, merged and written.
        own = [r["bucket"] for r in batch.select(bucket_of(F.col("external_id"), self.buckets).alias("bucket")).distinct().collect()]
        state = self.tables.read_buckets("state", own)
        # The last row of a listing and its first sighting: the state must not depend on how batches are cut.
        firsts = batch.groupBy("external_id").agg(F.min("observed_at").alias("first_observed_at"))
        latest = lifecycle.last_per_key(batch, self.order).join(firsts, "external_id")
        merged = lifecycle.merge_batch(self.empty_state if state is None else state, latest, run_id=batch_id)
        placed = lifecycle.new_state(merged).withColumn("bucket", bucket_of(F.col("external_id"), self.buckets))
        self.tables.commit(buckets={"state": placed}, batch_key=key)


def merge_stream(
    observations: DataFrame, tables: VersionedTables, empty_state: DataFrame, *, checkpoint: str, order: list[str] | None = None
) -> StreamingQuery:
    """Start merging what is available; resumes from ``checkpoint`` after a stop."""
    sink = ObservationSink(tables, empty_state, order or ["observed_at"])
    return (
        observations.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
