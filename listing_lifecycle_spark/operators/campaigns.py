"""Staged campaigns: progress, merged payload and how to split a search under a result cap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listing_lifecycle_spark import fixed_values as fv
from listing_lifecycle_spark.functions import maps
from listing_lifecycle_spark.functions.joins import latest_by


def progress(leaves: DataFrame) -> DataFrame:
    """Finished and total leaves per campaign; a split leaf is replaced by its children and does not count."""
    return leaves.groupBy("campaign_id").agg(
        F.count_if(F.col("status") == "success").alias("completed"),
        F.count_if(F.col("status").isin("pending", "success")).alias("total"),
    )


def latest_challenge(leaves: DataFrame, *, by_scope: bool = False, marker: str = fv.CHALLENGE_MARKER) -> DataFrame:
    """When a leaf last met a challenge, over all campaigns or per scope."""
    challenged = leaves.where(F.col("error_message") == marker)
    moment = F.max("last_attempt_at").alias("challenged_at")
    return challenged.groupBy("scope_id").agg(moment) if by_scope else challenged.agg(moment)


def challenge_by_scope(leaves: DataFrame, campaigns: DataFrame, *, marker: str = fv.CHALLENGE_MARKER) -> DataFrame:
    """Latest challenge per scope; leaves are reduced to one row per campaign before the join."""
    per_campaign = (
        leaves.where(F.col("error_message") == marker).groupBy("campaign_id").agg(F.max("last_attempt_at").alias("at"))
    )
    return (
        per_campaign.join(campaigns.select("campaign_id", "scope_name"), "campaign_id")
        .groupBy("scope_name")
        .agg(F.max("at").alias("challenged_at"))
    )


def staged_listings(leaves: DataFrame) -> DataFrame:
    """Staged listings of finished leaves, one row each with its place in the leaf."""
    return leaves.where(F.col("status") == "success").select(
        "campaign_id", "leaf_key", "ordinal", "completed_at", F.posexplode("listings").alias("position", "listing")
    ).select("campaign_id", "leaf_key", "ordinal", "completed_at", "position", "listing.*")


def merged_payload(staged: DataFrame) -> DataFrame:
    """Latest staged row per listing and campaign; at equal completion the later leaf, then the later row."""
    latest = latest_by(staged, ["campaign_id", "external_id"], ["completed_at", "ordinal", "position"])
    return latest.withColumnRenamed("completed_at", "observed_at").drop("ordinal", "position", "leaf_key")


def seen_by_leaf(staged: DataFrame) -> DataFrame:
    """Which listings each leaf has shown (kept as rows: a leaf's set is never gathered)."""
    return staged.select("campaign_id", "leaf_key", "external_id").distinct()


def leaf_totals(leaves: DataFrame) -> DataFrame:
    """Pages fetched by the finished leaves of each campaign."""
    return leaves.where(F.col("status") == "success").groupBy("campaign_id").agg(
        F.sum("pages_fetched").alias("pages_fetched"), F.count(F.lit(1)).alias("leaves")
    )


def clear_payload(leaves: DataFrame, campaign_id: str) -> DataFrame:
    """New version of the leaves with the payload of a finished campaign dropped."""
    done = F.col("campaign_id") == campaign_id
    return leaves.withColumn("listings", F.when(done, F.slice("listings", 1, 0)).otherwise(F.col("listings")))


def sit_length_code(days: Column) -> Column:
    """Search code of a sit length."""
    code = F.lit(None).cast("string")
    for name, (low, high) in reversed(fv.SIT_LENGTH_CODES.items()):
        inside = (days >= low) if high is None else days.between(low, high)
        code = F.when(inside, name).otherwise(code)
    return code


def split_plan(rows: DataFrame, levels: list[str], *, cap: int = fv.SEARCH_RESULT_CAP, opened: int = 1) -> DataFrame:
    """Searches that together show every row with at most ``cap`` results each.

    ``levels`` go from broad to narrow.  The search starts at level ``opened``; a
    node over the cap is replaced by its children.  The narrowest level cannot be
    split further and is flagged when over the cap.  Rows are counted once, per
    narrowest node; the levels above are sums over those counts.
    """
    leaves = rows.groupBy(*levels).agg(F.count(F.lit(1)).alias("n"))
    sizes = {
        depth: F.sum("n").over(Window.partitionBy(*levels[:depth])) for depth in range(opened, len(levels))
    }
    counted = leaves.withColumns({f"_size{depth}": size for depth, size in sizes.items()})
    chosen = reduce(
        lambda rest, depth: F.when(F.col(f"_size{depth}") <= cap, depth).otherwise(rest),
        reversed(range(opened, len(levels))),
        F.lit(len(levels)),
    )
    node = counted.withColumn("depth", chosen)
    keys = [F.when(F.col("depth") > i, F.col(name)).alias(name) for i, name in enumerate(levels)]
    return (
        node.groupBy("depth", *keys)
        .agg(F.sum("n").alias("results"))
        .withColumn("over_cap", F.col("results") > cap)
    )


def child_filters(filters: DataFrame, children: DataFrame, *, level: str) -> DataFrame:
    """Filters with one more level: each parent map joined with the children of its place.

    ``children`` has ``parent`` (canonical map of the parent) and ``slug``.
    """
    keyed = filters.withColumn("parent", maps.canonical(F.col("site_filter")))
    return keyed.join(children, "parent").select(
        "parent", maps.with_pair(F.col("site_filter"), level, F.col("slug")).alias("site_filter")
    )
