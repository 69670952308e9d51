"""Listing state: insert, change, missing, confirmed missing, return and expiry.

State and batch meet in one full outer join on the listing key.  Everything
that follows in a run (change detection, missing marks, expiry, counters) is a
projection of that join, so a run costs one shuffle of each side however many
rules apply.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from listing_lifecycle_spark import fixed_values as fv
from listing_lifecycle_spark.functions.calendar import day, instant
from listing_lifecycle_spark.functions.joins import latest_by

OUTCOME_COLUMNS = [
    "external_id",
    "created",
    "changed",
    "previous_status",
    "previous_content_hash",
    "appearance_sequence",
    "observation_applied",
]
# What a batch says about its sightings, not about the listing.
NOT_CONTENT = ("external_id", "observed_at", "first_observed_at")
# Working columns that a merged run carries besides the state.
MARKS = ["observed", "created", "changed", "previous_status", "previous_content_hash", "observation_applied", "missing_marked", "expiry_marked"]


def last_per_key(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row per listing, the last to arrive; makes a batch unique on its key."""
    return latest_by(rows, ["external_id"], order)


def _state_types(state: DataFrame, batch: DataFrame) -> dict[str, str]:
    content = [c for c in batch.columns if c not in NOT_CONTENT]
    stored = [c for c in state.columns if c not in content and c != "external_id"]
    types = {**dict(batch.dtypes), **fv.LIFECYCLE_SCHEMA, **dict(state.dtypes)}
    return {c: types[c] for c in [*content, *stored, *[c for c in fv.LIFECYCLE_SCHEMA if c not in stored]]}


def merge_batch(state: DataFrame, batch: DataFrame, *, run_id=None, context="observed", now=None) -> DataFrame:
    """Join a batch into the state; returns every listing with its new state and what happened to it.

    ``batch`` is unique on ``external_id`` and carries ``observed_at``.  A new key
    is inserted as active in its first appearance.  A known key takes over the
    content, becomes active and loses its missing marks; only a return from
    ``missing_confirmed`` starts another appearance.  An observation older than
    the stored sighting changes nothing.

    A batch that stands for several sightings of a listing carries the earliest
    as ``first_observed_at``; then the first sighting is the earliest of all,
    however sightings are dealt out to batches.
    """
    types = _state_types(state, batch)
    content = [c for c in batch.columns if c not in NOT_CONTENT]
    old = state.withColumn("_stored", F.lit(True)).withColumnsRenamed(
        {c: f"old_{c}" for c in state.columns if c != "external_id"}
    )
    new = batch.withColumn("_seen", F.lit(True)).withColumnsRenamed(
        {c: f"new_{c}" for c in batch.columns if c != "external_id"}
    )
    joined = old.join(new, "external_id", "full_outer")

    def stored(name: str) -> Column:
        column = F.col(f"old_{name}") if name in state.columns else F.lit(None)
        return column.cast(types[name])

    seen, created = F.col("_seen").isNotNull(), F.col("_stored").isNull()
    observed_at = F.coalesce(F.col("new_observed_at"), instant(now)) if now is not None else F.col("new_observed_at")
    stale = F.coalesce(stored("last_seen_at") > F.col("new_observed_at"), F.lit(False))
    applied = seen & ~stale
    first = lambda value, name: F.when(created, value).otherwise(stored(name))
    latest = lambda value, name: F.when(applied, value).otherwise(stored(name))
    run = F.lit(run_id).cast("bigint") if not isinstance(run_id, Column) else run_id
    context = F.lit(context) if not isinstance(context, Column) else context

    first_seen_at = first(observed_at, "first_seen_at")
    if "first_observed_at" in batch.columns:
        first_seen_at = F.least(stored("first_seen_at"), F.col("new_first_observed_at"), first_seen_at)
    lifecycle = {
        "first_seen_at": first_seen_at,
        "last_seen_at": latest(observed_at, "last_seen_at"),
        "first_seen_run_id": first(run, "first_seen_run_id"),
        "last_seen_run_id": latest(run, "last_seen_run_id"),
        "first_seen_context": first(context, "first_seen_context"),
        "status": latest(F.lit("active"), "status"),
        "missing_count": latest(F.lit(0), "missing_count"),
        "missing_since": F.when(~applied, stored("missing_since")),
        "closed_at": F.when(~applied, stored("closed_at")),
        "appearance_sequence": F.when(created, F.lit(1))
        .when(applied & (stored("status") == "missing_confirmed"), stored("appearance_sequence") + 1)
        .otherwise(stored("appearance_sequence")),
        "created_at": first(observed_at, "created_at"),
        "updated_at": latest(observed_at, "updated_at"),
    }
    columns = {
        name: (F.when(applied, F.col(f"new_{name}")).otherwise(stored(name)) if name in content
               else lifecycle.get(name, stored(name))).cast(kind)
        for name, kind in types.items()
    }
    return joined.select(
        "external_id",
        *[column.alias(name) for name, column in columns.items()],
        seen.alias("observed"),
        (seen & created).alias("created"),
        F.coalesce(applied & ~created & (stored("content_hash") != F.col("new_content_hash")), F.lit(False)).alias("changed"),
        F.when(seen, stored("status")).alias("previous_status"),
        F.when(seen, stored("content_hash")).alias("previous_content_hash"),
        applied.alias("observation_applied"),
        F.lit(0).alias("missing_marked"),
        F.lit(False).alias("expiry_marked"),
    )


def outcomes(merged: DataFrame) -> DataFrame:
    """One row per observation of the batch: what it did."""
    return merged.where("observed").select(*OUTCOME_COLUMNS)


def counters(merged: DataFrame) -> DataFrame:
    """Listings seen, new, changed and marked missing by a run."""
    return merged.agg(
        F.count_if("observed").alias("listings_seen"),
        F.count_if("created").alias("new_listings"),
        F.count_if("changed").alias("changed_listings"),
        F.coalesce(F.sum(F.col("missing_marked").cast("bigint")), F.lit(0).cast("bigint")).alias("missing_marked"),
    )


def new_state(merged: DataFrame) -> DataFrame:
    """The state after a run."""
    return merged.drop(*MARKS)


def touched() -> Column:
    """Whether a run has changed a row of the state: applied a sighting to it (or an earlier first one), marked it missing or let it expire."""
    return F.col("observed") | (F.col("missing_marked") > 0) | F.col("expiry_marked")


def covered_by(island: Column, region: Column, subregion: Column) -> Column:
    """Whether a listing lies in a scope.  A null label does not restrict; a listing without place is not covered."""

    def level(label: Column, name: str) -> Column:
        return label.isNull() | F.coalesce(F.col(name) == label, F.lit(False))

    return level(island, "island") & level(region, "region") & level(subregion, "subregion")


def mark_missing(merged: DataFrame, covered: Column, *, threshold, now, evidence: Column | None = None) -> DataFrame:
    """Count an absence for each covered listing that was not observed.

    ``evidence`` is the number of searches that should have shown the listing
    (default one).  Counting stops once the listing is confirmed missing.
    """
    threshold = F.lit(threshold) if not isinstance(threshold, Column) else threshold
    absences = F.lit(1) if evidence is None else F.coalesce(evidence, F.lit(0)).cast("int")
    marked = covered & ~F.col("observed") & F.col("status").isin("active", "missing_once") & (absences > 0)
    marked = F.coalesce(marked, F.lit(False))
    count = F.least(F.col("missing_count") + absences, F.greatest(threshold, F.col("missing_count") + 1))
    confirmed = count >= threshold
    moment = instant(now)
    return merged.withColumns(
        {
            "status": F.when(marked & confirmed, "missing_confirmed").when(marked, "missing_once").otherwise(F.col("status")),
            "missing_count": F.when(marked, count).otherwise(F.col("missing_count")),
            "missing_since": F.when(marked, F.coalesce("missing_since", moment)).otherwise(F.col("missing_since")),
            "closed_at": F.when(marked & confirmed, F.coalesce("closed_at", moment)).otherwise(F.col("closed_at")),
            "updated_at": F.when(marked, moment).otherwise(F.col("updated_at")),
            "missing_marked": F.when(marked, count - F.col("missing_count")).otherwise(F.col("missing_marked")),
        }
    )


def mark_expired(merged: DataFrame, *, today, now) -> DataFrame:
    """Expire listings whose last day is past."""
    expired = F.coalesce(
        (F.col("end_date") < day(today)) & F.col("status").isin("active", "missing_once", "missing_confirmed"), F.lit(False)
    )
    moment = instant(now)
    updates = {
        "status": F.when(expired, "expired_by_date").otherwise(F.col("status")),
        "closed_at": F.when(expired, F.coalesce("closed_at", moment)).otherwise(F.col("closed_at")),
    }
    if "expiry_marked" in merged.columns:
        updates["expiry_marked"] = expired
    if "updated_at" in merged.columns:
        updates["updated_at"] = F.when(expired, moment).otherwise(F.col("updated_at"))
    return merged.withColumns(updates)


@dataclass(frozen=True)
class RunScope:
    """What one run searched.  ``succeeded_before`` is false until the scope had its first success."""

    name: str
    island: str | None = None
    region: str | None = None
    subregion: str | None = None
    missing_threshold: int = 3
    succeeded_before: bool = True

    def covers(self) -> Column:
        return covered_by(*[F.lit(v).cast("string") for v in (self.island, self.region, self.subregion)])

    def context(self) -> str:
        return "observed" if self.succeeded_before else "baseline"


def apply_run(state: DataFrame, batch: DataFrame, scope: RunScope, *, run_id: int, now, today) -> DataFrame:
    """Apply one complete run: batch, absences, expiry, in this order.

    The first success of a scope marks nothing missing, because nothing is known
    to have been there.  Whether the batch was empty shows in ``counters`` of the
    result (``run_status``); such a result must be dropped, not stored.
    """
    merged = merge_batch(state, batch, run_id=run_id, context=scope.context(), now=now)
    if scope.succeeded_before:
        merged = mark_missing(merged, scope.covers(), threshold=scope.missing_threshold, now=now)
    return mark_expired(merged, today=today, now=now)


def run_status(listings_seen: int) -> str:
    """A complete run that saw nothing is suspicious and may change nothing."""
    return "success" if listings_seen else "suspicious"


SEARCHED = 2_000_000  # runs, of all scopes together, that are searched in the tasks


def replay(observations: DataFrame, *, threshold: int, run: str = "run_day") -> DataFrame:
    """State that running all complete runs of each scope in order would leave, without running them one by one.

    ``observations`` has ``scope_name``, ``external_id`` and the run it was seen in (a day, an instant or a number).
    Sightings are gathered by listing first, so a run that has seen a large share of all listings is no key of a join.
    The runs of a scope are one sorted array; a listing's sightings are looked up in it, which gives their numbers.
    Each gap of at least ``threshold`` runs between two sightings is a confirmed absence, hence another appearance.

    The list of runs is counted and gathered (a job); beyond ``SEARCHED`` runs sightings and runs are joined instead.
    """
    runs = observations.select("scope_name", run).distinct()
    listed = runs.select("scope_name", _as_number(run, observations).alias("run")).limit(SEARCHED + 1).toArrow()
    if listed.num_rows > SEARCHED:
        return _replay_by_join(observations, threshold, run)
    own = observations.groupBy("scope_name", "external_id").agg(F.min(run).alias("first_run"), F.max(run).alias("last_run_seen"), F.array_sort(F.collect_set(_as_number(run, observations))).alias("seen"))
    kind = own.schema
    schema = StructType([*kind.fields[:4], *StructType.fromDDL("sightings bigint, gaps bigint, absent bigint").fields])
    found = own.mapInArrow(partial(_looked_up, runs=listed, threshold=threshold), schema)
    return _with_status(
        found.select(
            "scope_name", "external_id", F.col("first_run").alias("first_run"), "last_run_seen", "sightings",
            (F.lit(1) + F.col("gaps")).cast("int").alias("appearance_sequence"), F.least("absent", F.lit(threshold)).cast("int").alias("missing_count"),
        ), threshold,
    )


def _as_number(run: str, observations: DataFrame) -> Column:
    """A run as a number in the same order."""
    kind = dict(observations.dtypes)[run]
    if kind == "date":
        return F.unix_date(run).cast("bigint")
    return F.unix_micros(F.col(run).cast("timestamp")) if kind.startswith("timestamp") else F.col(run).cast("bigint")


def _looked_up(batches: Iterator[pa.RecordBatch], runs: pa.Table, threshold: int) -> Iterator[pa.RecordBatch]:
    """For each listing: sightings, gaps of at least ``threshold`` runs between them, and runs after the last."""
    scopes = runs.column("scope_name").combine_chunks().dictionary_encode() if runs.num_rows else pa.array([], pa.string()).dictionary_encode()
    place = {name: i for i, name in enumerate(scopes.dictionary.to_pylist() + [None])}
    code, value = scopes.indices.fill_null(len(scopes.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64), runs.column("run").to_numpy()
    order = np.lexsort((value, code))
    code, value = code[order], value[order]
    edges = np.searchsorted(code, np.arange(len(place) + 1))
    for batch in batches:
        seen = batch.column("seen")
        at, flat = seen.offsets.to_numpy().astype(np.int64), seen.values.to_numpy(zero_copy_only=False)
        sizes = np.diff(at)
        flat = flat[at[0] : at[-1]]
        scope = np.array([place[x] for x in batch.column("scope_name").to_pylist()], np.int64)
        which, number = np.repeat(scope, sizes), np.zeros(len(flat), np.int64)
        for s in np.unique(scope).tolist():
            own = which == s
            number[own] = np.searchsorted(value[edges[s] : edges[s + 1]], flat[own])
        begin = np.cumsum(sizes) - sizes
        gap = np.zeros(len(flat), np.int64)
        gap[1:] = number[1:] - number[:-1] - 1
        gap[begin[sizes > 0]] = 0
        long = np.concatenate([[0], np.cumsum(gap >= threshold)])
        gaps = long[begin + sizes] - long[begin]
        absent = edges[scope + 1] - edges[scope] - 1 - number[begin + sizes - 1]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sizes), pa.array(gaps), pa.array(absent)], ["scope_name", "external_id", "first_run", "last_run_seen", "sightings", "gaps", "absent"])


def _replay_by_join(observations: DataFrame, threshold: int, run: str) -> DataFrame:
    """:func:`replay` for any number of runs: they are numbered on the list of distinct runs, and sightings joined with it."""
    seen = observations.select("scope_name", "external_id", run).distinct()
    runs = observations.select("scope_name", run).distinct()
    in_scope = Window.partitionBy("scope_name")
    numbered = runs.withColumns(
        {"n": F.row_number().over(in_scope.orderBy(run)), "last_run": F.count(F.lit(1)).over(in_scope)}
    )
    history = Window.partitionBy("scope_name", "external_id").orderBy("n")
    gaps = seen.join(numbered, ["scope_name", run]).withColumn(
        "gap", F.coalesce(F.col("n") - F.lag("n").over(history) - 1, F.lit(0))
    )
    absent = F.max("last_run") - F.max("n")
    found = gaps.groupBy("scope_name", "external_id").agg(
        F.min(run).alias("first_run"),
        F.max(run).alias("last_run_seen"),
        F.count(F.lit(1)).alias("sightings"),
        (F.lit(1) + F.count_if(F.col("gap") >= threshold)).cast("int").alias("appearance_sequence"),
        F.least(absent, F.lit(threshold)).cast("int").alias("missing_count"),
    )
    return _with_status(found, threshold)


def _with_status(found: DataFrame, threshold: int) -> DataFrame:
    return found.withColumn(
        "status",
        F.when(F.col("missing_count") == 0, "active")
        .when(F.col("missing_count") >= threshold, "missing_confirmed")
        .otherwise("missing_once"),
    )
