"""Search scopes: which are due, which cover which, and what a run makes fresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listing_lifecycle_spark import fixed_values as fv
from listing_lifecycle_spark.functions import maps
from listing_lifecycle_spark.functions.calendar import instant
from listing_lifecycle_spark.functions.joins import join_dimension
from listing_lifecycle_spark.operators.lifecycle import covered_by


def enabled_scopes(scopes: DataFrame, name: str | None = None) -> DataFrame:
    """Enabled scopes by name, or the enabled scope of one name."""
    enabled = scopes.where("enabled")
    return enabled.orderBy("name") if name is None else enabled.where(F.col("name") == name)


def due_scopes(scopes: DataFrame, *, now, grace_seconds: int = fv.DUE_GRACE_SECONDS) -> DataFrame:
    """Enabled scopes that never succeeded or whose interval has passed, shortest interval first."""
    interval = F.make_dt_interval(mins=F.col("interval_minutes"))
    grace = F.make_dt_interval(mins=F.lit(0), secs=F.lit(float(grace_seconds)))
    due = F.col("last_success_at").isNull() | (F.col("last_success_at") <= instant(now) - interval + grace)
    order = ["interval_minutes", "id" if "id" in scopes.columns else "name"]
    return scopes.where(F.col("enabled") & due).orderBy(*order)


def broadest_scopes(scopes: DataFrame) -> DataFrame:
    """Drop each scope for which a strictly broader one is present.

    Scope A is broader than B if A's map is a proper part of B's.  Distinct maps
    are looked up by their rarest pair instead of comparing all pairs of scopes.
    """
    present = scopes.select(F.col("site_filter").alias("part")).withColumn("text", maps.canonical(F.col("part"))).dropDuplicates(["text"]).select("part")
    found = maps.containing(present, scopes.select("name", "site_filter"), part="part", whole="site_filter")
    covered = found.where(F.size("part") < F.size("site_filter")).select("name").distinct()
    return scopes.join(covered, "name", "left_anti")


def advance_scopes(scopes: DataFrame, runs: DataFrame, *, covered_too: bool = True) -> DataFrame:
    """Move the last success forward for scopes that successful runs have covered.

    With ``covered_too`` a run counts for every enabled scope whose map contains
    the map of the run's scope; otherwise for its own scope only.  Successes are
    reduced to one instant per scope first.
    """
    success = (
        runs.where((F.col("status") == "success") & F.col("finished_at").isNotNull())
        .groupBy(F.col("scope_name").alias("name"))
        .agg(F.max("finished_at").alias("finished_at"))
    )
    own = success.join(scopes.select("name", "site_filter"), "name")
    if covered_too:
        by_map = own.groupBy(maps.canonical(F.col("site_filter")).alias("text")).agg(
            F.max("finished_at").alias("finished_at"), F.any_value("site_filter").alias("part")
        ).drop("text")
        found = maps.containing(by_map, scopes.where("enabled").select("name", "site_filter"), part="part", whole="site_filter")
        fresh = found.groupBy("name").agg(F.max("finished_at").alias("finished_at"))
    else:
        fresh = own.select("name", "finished_at")
    return (
        scopes.join(fresh, "name", "left")
        .withColumn("last_success_at", F.greatest("last_success_at", "finished_at"))
        .drop("finished_at")
        .select(*scopes.columns)
    )


def is_challenge(message: Column, marker: str = fv.CHALLENGE_MARKER) -> Column:
    """Whether an error message tells of a blocked fetch, in the present or the old form."""
    old_form = F.lit(True)
    for fragment in fv.LEGACY_CHALLENGE_FRAGMENTS:
        old_form = old_form & F.contains(message, F.lit(fragment))
    return F.coalesce(F.contains(message, F.lit(marker)) | old_form, F.lit(False))


def latest_challenge(runs: DataFrame, *, by_scope: bool = False) -> DataFrame:
    """When a failed run last met a challenge, over all runs or per scope."""
    failed = runs.where((F.col("status") == "failed") & is_challenge(F.col("error_message")))
    moment = F.max(F.coalesce("finished_at", "started_at")).alias("challenged_at")
    return failed.groupBy("scope_name").agg(moment) if by_scope else failed.agg(moment)


def eligible_leaves(leaves: DataFrame, *, excluded_regions: list[str], allowed_states: list[str] | None) -> DataFrame:
    """Leaves that may count as evidence of absence: they name a region, not an excluded one, in an allowed state."""
    region, state = [F.try_element_at("site_filter", F.lit(key)) for key in ("region", "state")]
    kept = leaves.where(region.isNotNull() & ~region.isin(*excluded_regions) if excluded_regions else region.isNotNull())
    return kept if allowed_states is None else kept.where(state.isin(*allowed_states))


def missing_evidence(state: DataFrame, leaves: DataFrame, seen: DataFrame) -> DataFrame:
    """How many leaves should have shown each listing but did not.

    ``leaves`` carries the labels of its area and ``completed_at``; ``seen`` is
    (leaf_key, external_id).  A sighting after the leaf was read outweighs it.
    A leaf names a region or a subregion of it, which is its key; a listing offers
    both of its own.  Areas are disjoint, so a listing meets one leaf.
    """
    narrow = lambda region, subregion: F.concat_ws("\x1f", region, subregion)
    subregion = F.col("want_subregion")
    place = F.when(subregion.isNotNull(), narrow("want_region", "want_subregion")).otherwise(F.col("want_region"))
    places = leaves.select("leaf_key", "completed_at", "want_island", "want_subregion", place.alias("_place"))
    own = F.array_compact(F.array("region", F.when(F.col("subregion").isNotNull(), narrow("region", "subregion"))))
    open_listings = state.where(F.col("status").isin("active", "missing_once") & F.col("region").isNotNull()).select(
        "external_id", "island", "region", "subregion", "last_seen_at", F.explode(own).alias("_place")
    )
    inside = covered_by(F.col("want_island"), F.lit(None).cast("string"), F.col("want_subregion"))
    candidates = join_dimension(open_listings, places, ["_place"], spread_by="external_id").where(
        inside & (F.col("last_seen_at") <= F.col("completed_at"))
    )
    absent = candidates.join(seen.select("leaf_key", "external_id"), ["leaf_key", "external_id"], "left_anti")
    return absent.groupBy("external_id").agg(F.count(F.lit(1)).alias("absences"))


def overlapping_leaves(leaves: DataFrame) -> DataFrame:
    """Leaves of one campaign whose area lies in the area of another; none if absences are counted once."""
    outer = leaves.select("campaign_id", F.col("leaf_key").alias("outer_key"), F.col("site_filter").alias("outer_filter"))
    inner = leaves.select("campaign_id", F.col("leaf_key").alias("inner_key"), "site_filter")
    found = maps.containing(outer, inner, part="outer_filter", whole="site_filter", by=("campaign_id",))
    return found.where("inner_key <> outer_key").select("campaign_id", "inner_key", "outer_key")
