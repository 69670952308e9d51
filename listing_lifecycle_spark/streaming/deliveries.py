"""Deferred deliveries: each tick sends what has become due and is not yet sent, and plans failed ones anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from listing_lifecycle_spark.operators import deliveries as de
from listing_lifecycle_spark.session import cut_lineage
from listing_lifecycle_spark.sources.versions import VersionedTables


class DeliverySink:
    """Micro-batch writer over a stream of ticks (column ``now``).

    ``send`` takes routed deliveries (with ``attempts``, those made before) and
    returns their results as a DataFrame (``event_id``, ``channel``, ``sent``,
    ``error_message``).  A failed delivery stays in the queue and is tried again
    when ``delivery_queue`` plans it: with ``retry_minutes`` = 0 at the next tick.
    """

    def __init__(
        self, tables: VersionedTables, rules: DataFrame, channels: DataFrame, send: Callable[[DataFrame], DataFrame], *, retry_minutes: int = 0,
    ):
        self.tables = tables
        self.rules = rules
        self.channels = channels
        self.send = send
        self.retry_minutes = retry_minutes

    def __call__(self, ticks: DataFrame, batch_id: int) -> None:
        key = f"delivery-{batch_id}"
        now = ticks.agg(F.max("now")).first()[0]
        if now is None or self.tables.has_batch(key):
            return
        events, listings, attempts = self.tables.read_log("events"), self.tables.read("state"), self.tables.read_log("attempts")
        if events is None or listings is None:
            return
        if attempts is None:
            attempts = self.tables.spark.createDataFrame(
                [], "event_id string, channel string, attempted_at timestamp_ntz, status string, message string, error_message string"
            )
        queue = de.delivery_queue(events, self.rules, attempts, now=now, retry_minutes=self.retry_minutes)
        due = queue.where("due").select("event_id", "channel", "rule_name", "external_id", "deliver_after", "attempts")
        pending = de.with_message(due, listings)
        # Sending has effects outside, so what is pending is fixed before it is sent.
        routed = cut_lineage(de.route(pending, self.channels))
        results = cut_lineage(self.send(routed.where("configured")))
        tried = de.record_attempts(routed, results, now=now)
        self.tables.commit(logs={"attempts": tried}, batch_key=key)


def deliver_on_ticks(ticks: DataFrame, sink: DeliverySink, *, checkpoint: str) -> StreamingQuery:
    """Start delivering for the ticks that are available."""
    return ticks.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
