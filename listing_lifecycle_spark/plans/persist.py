"""A complete run end to end: batch to state, events, run row and scopes, committed together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listing_lifecycle_spark.functions.calendar import instant
from listing_lifecycle_spark.operators import campaigns, coverage, lifecycle
from listing_lifecycle_spark.operators.events import create_events
from listing_lifecycle_spark.operators.matching import match_rules
from listing_lifecycle_spark.session import cut_lineage
from listing_lifecycle_spark.sources.eventlog import EventLog
from listing_lifecycle_spark.sources.locations import resolve_site_filter
from listing_lifecycle_spark.sources.versions import BUCKETS, VersionedTables, changed_buckets

EVENT_LOG_TYPES = (
    "event_id string, external_id string, rule_name string, appearance_sequence int, alert_fingerprint string, "
    "event_type string, listing_content_hash string, detected_run_id bigint, target_channels array<string>, "
    "deliver_after timestamp_ntz, created_at timestamp_ntz"
)


@dataclass(frozen=True)
class RunResult:
    """Outcome of a run: its row for the run log, the new state and the new events."""

    run: DataFrame
    merged: DataFrame | None
    events: DataFrame | None
    status: str


def run_row(spark, scope_name: str, *, run_id: int, started_at, now, counts, status: str) -> DataFrame:
    """One row of the run log."""
    row = (run_id, scope_name, status, *[int(counts[c]) for c in ("listings_seen", "new_listings", "changed_listings", "missing_marked")])
    df = spark.createDataFrame(
        [row],
        "id bigint, scope_name string, status string, listings_seen bigint, new_listings bigint, changed_listings bigint, missing_marked bigint",
    )
    return df.withColumns({"started_at": instant(started_at), "finished_at": instant(now)})


def run_once(
    state: DataFrame,
    batch: DataFrame,
    scope: lifecycle.RunScope,
    *,
    rules: DataFrame,
    locations: DataFrame,
    event_log: DataFrame | EventLog,
    run_id: int,
    now,
    today,
) -> RunResult:
    """Apply a batch to the state and derive its events.

    Of an ``EventLog`` only the parts are read that may hold an event of a matched listing and rule.

    The merged rows are needed by the counters, the events and the new state, so
    they are worked out once and kept in the shared folder.  A batch that turns
    out to be empty is suspicious: the merged rows are dropped.
    """
    spark = state.sparkSession
    merged = cut_lineage(lifecycle.apply_run(state, batch, scope, run_id=run_id, now=now, today=today))
    counts = lifecycle.counters(merged).first().asDict()
    status = lifecycle.run_status(counts["listings_seen"])
    if status != "success":
        empty = {name: 0 for name in counts}
        return RunResult(run_row(spark, scope.name, run_id=run_id, started_at=now, now=now, counts=empty, status=status), None, None, status)
    # Expiry comes after the alerts, but matching reads only content, which expiry leaves alone.
    matches = match_rules(merged.where("observed"), rules, locations)
    if isinstance(event_log, EventLog):
        matches = cut_lineage(matches)
    events = create_events(matches, earlier_events(event_log, matches), run_id=run_id, event_time=now)
    return RunResult(
        run_row(spark, scope.name, run_id=run_id, started_at=now, now=now, counts=counts, status=status), merged, events, status
    )


def earlier_events(event_log: DataFrame | EventLog, matches: DataFrame) -> DataFrame:
    """The log, or the parts of it that matter for ``matches``."""
    if not isinstance(event_log, EventLog):
        return event_log
    found = event_log.of(matches)
    return matches.sparkSession.createDataFrame([], EVENT_LOG_TYPES) if found is None else found


def commit_run(tables: VersionedTables, result: RunResult, *, scopes: DataFrame, batch_key: str = "", buckets: int = BUCKETS) -> int:
    """Publish a run: state, events, run row and scopes become visible together or not at all.

    Of the state only the buckets are written in which the run has changed a row.
    """
    if result.merged is None:
        return tables.commit(logs={"runs": result.run}, batch_key=batch_key)
    changed = changed_buckets(result.merged, "external_id", lifecycle.touched(), buckets)
    events = EventLog(tables).logs(cut_lineage(result.events))
    return tables.commit(
        {"scopes": coverage.advance_scopes(scopes, result.run)},
        logs={**events, "runs": result.run},
        buckets={"state": lifecycle.new_state(changed)},
        batch_key=batch_key,
    )


def finish_campaign(
    state: DataFrame,
    leaves: DataFrame,
    *,
    campaign_id: str,
    threshold: int,
    locations: DataFrame,
    excluded_regions: list[str],
    allowed_states: list[str] | None,
    succeeded_before: bool,
    run_id: int,
    now,
    today,
) -> DataFrame:
    """Merge a finished campaign into the state: latest staged row per listing, absences per leaf, expiry.

    A campaign that staged nothing is refused (see :func:`complete_campaign`), as
    is a leaf whose filter names no place: it must not count as evidence.
    """
    own = leaves.where(F.col("campaign_id") == campaign_id)
    staged = campaigns.staged_listings(own)
    batch = campaigns.merged_payload(staged).drop("campaign_id")
    if batch.isEmpty():
        raise ValueError(f"campaign {campaign_id} staged no listing")
    merged = lifecycle.merge_batch(
        state, batch, run_id=run_id, context="observed" if succeeded_before else "baseline", now=now
    )
    if succeeded_before:
        done = own.where(F.col("status") == "success")
        areas = resolve_site_filter(
            coverage.eligible_leaves(done, excluded_regions=excluded_regions, allowed_states=allowed_states), locations
        )
        wrong = areas.where(F.col("filter_error").isNotNull()).select("leaf_key", "filter_error").head(1)
        if wrong:
            raise ValueError(f"leaf {wrong[0].leaf_key}: {wrong[0].filter_error}")
        merged = cut_lineage(merged)
        evidence = coverage.missing_evidence(merged, areas, campaigns.seen_by_leaf(staged))
        counted = merged.join(evidence, "external_id", "left").withColumn("_observed", F.col("observed"))
        # A listing that another leaf has shown may still be missing where this leaf looked later.
        open_rows = counted.withColumn("observed", F.lit(False))
        merged = lifecycle.mark_missing(
            open_rows, F.lit(True), threshold=threshold, now=now, evidence=F.col("absences")
        ).withColumn("observed", F.col("_observed")).drop("_observed", "absences")
    return lifecycle.mark_expired(merged, today=today, now=now)


def complete_campaign(
    state: DataFrame, leaves: DataFrame, scope_name: str, *, campaign_id: str, rules: DataFrame, event_log: DataFrame,
    locations: DataFrame, run_id: int, started_at, now, today, **campaign,
) -> RunResult:
    """A finished campaign as a run: merged state, alert events and the run row, to be published by ``commit_run``.

    Without any staged listing the run is suspicious and changes nothing.
    """
    spark = state.sparkSession
    own = leaves.where(F.col("campaign_id") == campaign_id)
    if campaigns.merged_payload(campaigns.staged_listings(own)).isEmpty():
        none = dict.fromkeys(("listings_seen", "new_listings", "changed_listings", "missing_marked"), 0)
        return RunResult(run_row(spark, scope_name, run_id=run_id, started_at=started_at, now=now, counts=none, status="suspicious"), None, None, "suspicious")
    merged = cut_lineage(finish_campaign(state, leaves, campaign_id=campaign_id, locations=locations, run_id=run_id, now=now, today=today, **campaign))
    counts = lifecycle.counters(merged).first().asDict()
    status = lifecycle.run_status(counts["listings_seen"])
    events = create_events(match_rules(merged.where("observed"), rules, locations), event_log, run_id=run_id, event_time=now)
    return RunResult(run_row(spark, scope_name, run_id=run_id, started_at=started_at, now=now, counts=counts, status=status), merged, events, status)
