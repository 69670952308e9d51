"""Alert events: typed, deduplicated, with their delivery plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listing_lifecycle_spark.functions.calendar import deliver_after, instant
from listing_lifecycle_spark.functions.hashing import alert_fingerprint, stable_hash

EVENT_KEY = ["external_id", "rule_name", "appearance_sequence", "alert_fingerprint"]
EVENT_COLUMNS = [
    "event_id", *EVENT_KEY, "event_type", "listing_content_hash", "detected_run_id", "target_channels", "deliver_after", "created_at",
]


def latest_events(log: DataFrame) -> DataFrame:
    """Fingerprint of the latest event per listing and rule."""
    return log.groupBy("external_id", "rule_name").agg(
        F.max_by("alert_fingerprint", F.struct("created_at", "event_id")).alias("prior_fingerprint")
    )


def prior_events(matches: DataFrame, log: DataFrame) -> DataFrame:
    """Per matched listing and rule: fingerprint of the latest event, and the (appearance, fingerprint) pairs of all.

    Log rows of other listings are dropped before anything is aggregated, so the
    work follows the matches, not the log.
    """
    key = ["external_id", "rule_name"]
    own = log.join(matches.select(*key).distinct(), key, "left_semi")
    return own.groupBy(*key).agg(
        F.max_by("alert_fingerprint", F.struct("created_at", "event_id")).alias("prior_fingerprint"),
        F.collect_set(F.struct("appearance_sequence", "alert_fingerprint")).alias("seen_events"),
    )


def _classified(matches: DataFrame, log: DataFrame) -> DataFrame:
    joined = matches.join(prior_events(matches, log), ["external_id", "rule_name"], "left")
    returned = F.col("observation_applied") & F.col("previous_status").eqNullSafe("missing_confirmed")
    event_type = (
        F.when(F.col("prior_fingerprint").isNull() & F.col("created"), "first_match")
        .when(F.col("prior_fingerprint").isNull(), "became_match")
        .when(F.col("prior_fingerprint") == F.col("alert_fingerprint"), None)
        .when(returned, "confirmed_reappearance")
        .otherwise("material_change")
    )
    return joined.withColumn("event_type", event_type).where("event_type is not null").drop("prior_fingerprint")


def classify(matches: DataFrame, log: DataFrame) -> DataFrame:
    """Type of the event a match gives rise to; a match whose fingerprint the latest event has gives none.

    Equality is looked at before reappearance, so a listing that returns
    unchanged stays silent.
    """
    return _classified(matches, log).drop("seen_events")


def create_events(matches: DataFrame, log: DataFrame, *, run_id: int, event_time) -> DataFrame:
    """New events of one run.

    ``matches`` are matched observations with their outcome.  An event is new if
    the log has none with the same listing, rule, appearance and fingerprint.
    The event id is derived from that key, so writing a run twice gives the same
    ids.
    """
    applied = matches.where("observation_applied").withColumn("alert_fingerprint", alert_fingerprint())
    typed = _classified(applied, log)
    known = F.array_contains("seen_events", F.struct("appearance_sequence", "alert_fingerprint"))
    fresh = typed.where(~F.coalesce(known, F.lit(False))).drop("seen_events").dropDuplicates(EVENT_KEY)
    moment = instant(event_time)
    return fresh.withColumns(
        {
            "event_id": stable_hash(EVENT_KEY),
            "listing_content_hash": F.col("content_hash"),
            "detected_run_id": F.lit(run_id).cast("bigint"),
            "target_channels": F.col("channels"),
            "deliver_after": deliver_after(moment, F.col("quiet_timezone"), F.col("quiet_start"), F.col("quiet_end")),
            "created_at": moment,
        }
    ).select(*EVENT_COLUMNS)
