"""Pending deliveries of alert events and the record of attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listing_lifecycle_spark import fixed_values as fv
from listing_lifecycle_spark.functions.calendar import deliver_after, instant
from listing_lifecycle_spark.functions.text import alert_message


def due_targets(events: DataFrame, attempts: DataFrame, *, now) -> DataFrame:
    """One row per due event and channel that no attempt has reached yet."""
    targets = events.where(F.col("deliver_after") <= instant(now)).withColumn("channel", F.explode("target_channels"))
    sent = attempts.where(F.col("status") == "sent").select("event_id", "channel").distinct()
    return targets.join(sent, ["event_id", "channel"], "left_anti")


def delivery_queue(events: DataFrame, rules: DataFrame, attempts: DataFrame, *, now, retry_minutes: int = 0) -> DataFrame:
    """Every event and channel that is not sent yet: attempts so far, last error, next attempt, and whether it is due.

    Nothing but the log of attempts is kept, so the queue survives whatever reads it.  The first attempt is planned for
    the event's ``deliver_after``.  After the n-th failure the next one is planned ``retry_minutes`` * 2^(n-1) later, or
    for the end of the rule's quiet hours if that falls into them; with 0 it is due at once.
    """
    targets = events.withColumn("channel", F.explode("target_channels")).drop("target_channels")
    tried = attempts.groupBy("event_id", "channel").agg(
        F.count(F.lit(1)).alias("attempts"), F.bool_or(F.col("status") == "sent").alias("_sent"),
        F.max("attempted_at").alias("_last"), F.max_by("error_message", "attempted_at").alias("last_error"),
    )
    quiet = rules.select("rule_name", "quiet_timezone", "quiet_start", "quiet_end")
    rows = targets.join(quiet, "rule_name").join(tried, ["event_id", "channel"], "left").where(~F.coalesce("_sent", F.lit(False)))
    pause = F.make_dt_interval(mins=(F.lit(retry_minutes) * F.pow(F.lit(2.0), F.col("attempts") - 1)).cast("int"))
    again = deliver_after(F.col("_last") + pause, F.col("quiet_timezone"), F.col("quiet_start"), F.col("quiet_end"))
    planned = F.when(F.col("_last").isNull(), F.col("deliver_after")).otherwise(again if retry_minutes else F.col("_last"))
    counted = rows.withColumns({"attempts": F.coalesce("attempts", F.lit(0).cast("bigint")), "next_attempt_at": planned})
    due = (F.col("deliver_after") <= instant(now)) & (F.col("next_attempt_at") <= instant(now))
    return counted.withColumn("due", due).drop("_sent", "_last", "quiet_timezone", "quiet_start", "quiet_end")


def pending_deliveries(events: DataFrame, rules: DataFrame, listings: DataFrame, attempts: DataFrame, *, now) -> DataFrame:
    """Outbox: what to send now, with the text made from the present state of the listing."""
    targets = due_targets(events, attempts, now=now).select("event_id", "channel", "external_id", "rule_name", "deliver_after")
    return with_message(targets.join(rules.select("rule_name"), "rule_name"), listings)


def with_message(targets: DataFrame, listings: DataFrame) -> DataFrame:
    """Deliveries (event_id, channel, rule_name, external_id, deliver_after and more) with their text."""
    needed = ["external_id", "city", "region", "start_date", "end_date", "duration_days", "no_pets", "url", *fv.PET_COUNT_COLUMNS]
    more = [c for c in targets.columns if c not in ("event_id", "channel", "rule_name", "external_id", "deliver_after")]
    shown = targets.join(listings.select(*needed), "external_id")
    text = alert_message(F.col("rule_name"), {name: F.col(name) for name in needed})
    return shown.select("event_id", "channel", "rule_name", "external_id", "deliver_after", *more, text.alias("message"))


def in_order(deliveries: DataFrame) -> DataFrame:
    """Sending order."""
    return deliveries.orderBy("deliver_after", "event_id", "channel")


def route(deliveries: DataFrame, channels: DataFrame) -> DataFrame:
    """Mark deliveries whose channel has no configured sender."""
    known = channels.select("channel").distinct().withColumn("configured", F.lit(True))
    return deliveries.join(known, "channel", "left").withColumn("configured", F.coalesce("configured", F.lit(False)))


def unconfigured(routed: DataFrame) -> DataFrame:
    """Failure report for channels without sender; these deliveries are not attempted."""
    return routed.where(~F.col("configured")).select(
        "event_id", "channel",
        F.concat(F.lit("No configured notification provider for "), "channel").alias("error_message"),
    )


def record_attempts(routed: DataFrame, results: DataFrame, *, now) -> DataFrame:
    """Attempt rows from what the senders reported (``event_id``, ``channel``, ``sent``, ``error_message``).

    A failed attempt leaves the delivery pending, so it is tried again until one succeeds.
    """
    reported = results.withColumnRenamed("error_message", "reported_error")
    return routed.where("configured").join(reported, ["event_id", "channel"]).select(
        "event_id",
        "channel",
        instant(now).alias("attempted_at"),
        F.when(F.col("sent"), "sent").otherwise("failed").alias("status"),
        "message",
        F.when(~F.col("sent"), F.coalesce("reported_error", F.lit("Provider send failed"))).alias("error_message"),
    )


def summary(routed: DataFrame, attempts: DataFrame) -> DataFrame:
    """Counts of one delivery round."""
    tried = attempts.select("event_id", "channel", "status")
    return routed.join(tried, ["event_id", "channel"], "left").agg(
        F.count(F.lit(1)).alias("deliveries_due"),
        F.count_if(F.col("status").isNotNull()).alias("attempts_made"),
        F.count_if(F.col("status") == "sent").alias("sent"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(~F.col("configured")).alias("unconfigured"),
    )
