"""Listing state kept per key inside the stream, with timers.

Each listing's state lives in Spark's keyed state store and is touched only when the listing is seen or its timer runs
out.  Two clocks are kept apart: ``reported_at``, when a sighting reached the stream (it only moves on, up to the
watermark's delay), and ``observed_at``, when the listing was seen, which may be any time ago.  Silence is measured on
the first: a timer declares a listing missing.  Content, first and last sighting and the number of appearances follow
the second, so a late row is decided by the state it meets, never dropped, and the outcome does not depend on how rows
are dealt out to micro-batches.

Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from listing_lifecycle_spark.streaming.periods import utc_instant

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = (
    "version bigint, sightings bigint, reported_ms bigint, latest_us bigint, latest_tie bigint, content_hash string, "
    "missing boolean, starts array<bigint>, ends array<bigint>"
)
OUTPUT = (
    "external_id string, version bigint, content_hash string, first_seen_us bigint, last_seen_us bigint, "
    "appearance_sequence int, sightings bigint, status string"
)
ROW = Row(*[c.split()[0] for c in OUTPUT.split(", ")])


def merged_spans(starts: list[int], ends: list[int], gap: int) -> tuple[list[int], list[int]]:
    """Stretches of sightings, in order, those less than ``gap`` apart made one."""
    out_starts: list[int] = []
    out_ends: list[int] = []
    for a, b in sorted(zip(starts, ends)):
        if out_ends and a - out_ends[-1] < gap:
            out_ends[-1] = max(out_ends[-1], b)
        else:
            out_starts.append(a)
            out_ends.append(b)
    return out_starts, out_ends


class ListingProcessor(StatefulProcessor):
    """State of one listing: its stretches of sightings, latest content, and a timer for silence."""

    def __init__(self, gap: timedelta, silence: timedelta):
        self.gap_us = gap // timedelta(microseconds=1)
        self.silence_ms = silence // timedelta(milliseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.listing = handle.getValueState("listing", STATE)

    def _row(self, key, state: tuple) -> Row:
        version, sightings, _, latest, _, content, missing, starts, ends = state
        return ROW(key[0], version, content, starts[0], max(latest, ends[-1]), len(starts), sightings, "missing_confirmed" if missing else "active")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.listing.get()  # each call to the store costs a round trip
        if known is not None:
            version, sightings, reported, latest, tie, content, _, starts, ends = tuple(known)
            starts, ends = list(starts), list(ends)
            before = reported
        else:
            version, sightings, reported, latest, tie, content, starts, ends, before = 0, 0, -1, -(1 << 62), -1, None, [], [], None
        seen, top = [], None
        for row in rows:
            own = (row["observed_us"], row["tie"], row["content_hash"])
            seen.append(own[0])
            reported = reported if row["reported_ms"] is None else max(reported, row["reported_ms"])
            top = own if top is None else max(top, own)
        sightings += len(seen)
        if top[:2] >= (latest, tie):
            latest, tie, content = top
        starts, ends = merged_spans(starts + seen, ends + seen, self.gap_us)
        state = (version + 1, sightings, reported, latest, tie, content, False, starts, ends)
        self.listing.update(state)
        if before != reported:
            if before is not None:
                self.handle.deleteTimer(before + self.silence_ms)
            self.handle.registerTimer(reported + self.silence_ms)
        yield self._row(key, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = tuple(self.listing.get())
        state = (state[0] + 1, *state[1:6], True, list(state[7]), list(state[8]))
        self.listing.update(state)
        yield self._row(key, state)

    def close(self) -> None:
        pass


def keyed_states(sightings: DataFrame, *, gap: timedelta, silence: timedelta, delay: str = "1 hour") -> DataFrame:
    """A row whenever a listing's state changes; of several the one of the highest ``version`` holds.

    ``sightings`` is a stream of external_id, content_hash, observed_at, reported_at and tie (decides between sightings
    of one instant).  Sightings ``gap`` or more apart are separate appearances; a listing that nothing reported for
    ``silence`` behind the watermark (``delay`` behind the latest report) is ``missing_confirmed`` until it is seen again.
    """
    timed = sightings.withColumn("clock", utc_instant(F.col("reported_at"))).withWatermark("clock", delay)
    rows = timed.select(
        "external_id", "content_hash", "tie", "clock", F.unix_millis("clock").alias("reported_ms"),
        F.unix_micros(utc_instant(F.col("observed_at"))).alias("observed_us"),
    )
    return rows.groupBy("external_id").transformWithState(
        statefulProcessor=ListingProcessor(gap, silence), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime"
    )


class LatestStates:
    """Micro-batch writer of changed states: a folder for each batch, so that a repeated batch replaces itself."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")

    def read(self, spark: SparkSession) -> DataFrame:
        """The present state of every listing."""
        changes = spark.read.schema(OUTPUT + ", batch long").parquet(self.folder)
        rest = [c for c in changes.columns if c not in ("external_id", "batch")]
        latest = changes.groupBy("external_id").agg(F.max_by(F.struct(*rest), "version").alias("s")).select("external_id", "s.*")
        moment = lambda c: F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_micros(c).cast("timestamp_ntz"))
        return latest.withColumns({"first_seen_at": moment("first_seen_us"), "last_seen_at": moment("last_seen_us")}).drop("first_seen_us", "last_seen_us")


def keep_states(states: DataFrame, sink: LatestStates, *, checkpoint: str) -> StreamingQuery:
    """Start keeping the states of the sightings that are available; resumes from ``checkpoint`` after a stop."""
    return states.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
