"""Counts, rankings and distributions over listing facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listing_lifecycle_spark.operators.filters import valid_lead, without_baseline


def _distinct(exact: bool) -> Column:
    return F.count_distinct("external_id") if exact else F.approx_count_distinct("external_id")


def _valid_lead() -> Column:
    return F.when(F.col("lead_time_days") >= 0, F.col("lead_time_days"))


def overview(facts: DataFrame, *, distinct: bool = False) -> DataFrame:
    """Rows (or distinct listings), mean and median duration, mean and median valid lead, in one pass.

    The exact medians keep one counter per distinct number of days, not per row.
    """
    listings = F.count_distinct("external_id") if distinct else F.count(F.lit(1))
    return facts.agg(
        listings.alias("listings"),
        F.avg("duration_days").alias("avg_duration_days"),
        F.percentile("duration_days", 0.5).alias("median_duration_days"),
        F.avg(_valid_lead()).alias("avg_lead_time_days"),
        F.percentile(_valid_lead(), 0.5).alias("median_lead_time_days"),
    )


def count_by(facts: DataFrame, column: str, *, limit: int | None = None, exact: bool = True) -> DataFrame:
    """Distinct listings per value, largest first (ties by value); null values are left out."""
    counts = (
        facts.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(_distinct(exact).alias("listings"))
        .orderBy(F.desc("listings"), F.asc(column))
    )
    return counts if limit is None else counts.limit(limit)


def rows_by_region(listings: DataFrame) -> DataFrame:
    """Rows per region, largest first; rows without region are counted too."""
    return (
        listings.groupBy("region")
        .agg(F.count(F.lit(1)).alias("listings"))
        .orderBy(F.desc("listings"), F.asc_nulls_last("region"))
    )


def rows_by_start_month(listings: DataFrame) -> DataFrame:
    """Rows per calendar month of the start."""
    return (
        listings.groupBy(F.month("start_date").alias("month"))
        .agg(F.count(F.lit(1)).alias("listings"))
        .orderBy(F.asc_nulls_last("month"))
    )


def date_bounds(facts: DataFrame) -> DataFrame:
    """Ranges that the date filters start with."""
    return facts.agg(
        F.min("start_date").alias("min_start_date"),
        F.max("start_date").alias("max_start_date"),
        F.to_date(F.min("first_seen_at")).alias("min_first_seen"),
        F.to_date(F.max("first_seen_at")).alias("max_first_seen"),
    )


def lead_rows(facts: DataFrame, *, include_baseline: bool = False) -> DataFrame:
    """Rows whose lead time is known: valid, and not from the first load unless asked for."""
    rows = valid_lead(facts)
    return rows if include_baseline else without_baseline(rows)


def lead_statistics(rows: DataFrame) -> DataFrame:
    """Mean, median and quartiles (linear between neighbours)."""
    quartiles = F.percentile("lead_time_days", [0.25, 0.5, 0.75])
    return rows.agg(F.avg("lead_time_days").alias("mean"), quartiles.alias("q")).select(
        "mean",
        F.col("q")[0].alias("p25"),
        F.col("q")[1].alias("median"),
        F.col("q")[2].alias("p75"),
    )


def lead_histogram(rows: DataFrame, bins: int = 35) -> DataFrame:
    """Equal-width bins between the smallest and the largest lead.

    Rows are first counted per number of days; bounds and bins are worked out on
    those counts, whose number is bounded by the calendar.
    """
    per_day = rows.groupBy("lead_time_days").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(1))
    low, high = F.min("lead_time_days").over(everything), F.max("lead_time_days").over(everything)
    placed = per_day.withColumns({"lo": low, "hi": high})
    offset = (F.col("lead_time_days") - F.col("lo")) * bins
    number = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(
        F.least(F.floor(offset / F.nullif(F.col("hi") - F.col("lo"), F.lit(0))) + 1, F.lit(bins))
    )
    return (
        placed.groupBy(number.cast("int").alias("bin"), "lo", "hi")
        .agg(F.sum("n").alias("listings"))
        .select(
            "bin",
            (F.col("lo") + (F.col("bin") - 1) * (F.col("hi") - F.col("lo")) / bins).alias("bin_from"),
            (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("bin_to"),
            "listings",
        )
    )


def lead_boxes(rows: DataFrame) -> DataFrame:
    """Five-number summary of lead per sit-length bucket."""
    return (
        rows.groupBy("duration_bucket")
        .agg(
            F.count(F.lit(1)).alias("listings"),
            F.percentile("lead_time_days", [0.0, 0.25, 0.5, 0.75, 1.0]).alias("q"),
        )
        .select(
            "duration_bucket",
            "listings",
            *[F.col("q")[i].alias(name) for i, name in enumerate(["low", "p25", "median", "p75", "high"])],
        )
    )


def pet_mix(facts: DataFrame, column: str, *, limit: int = 15, exact: bool = True) -> DataFrame:
    """Distinct listings per value and pet label, for the values that rank highest."""
    top = count_by(facts, column, limit=limit, exact=exact).select(column)
    stacked = facts.groupBy(column, "pet_label").agg(_distinct(exact).alias("listings"))
    # ``limit`` rows at most, so the broadcast is bounded by the argument.
    return stacked.join(F.broadcast(top), column, "left_semi").orderBy(
        F.desc("listings"), F.asc(column), F.asc("pet_label")
    )


def market_card(facts: DataFrame) -> DataFrame:
    """Rows, long sits, mean duration and median valid lead of one market."""
    return facts.agg(
        F.count(F.lit(1)).alias("listings"),
        F.sum(F.col("has_long_sit").cast("bigint")).alias("long_sits"),
        F.avg("duration_days").alias("avg_duration_days"),
        F.percentile(_valid_lead(), 0.5).alias("median_lead_time_days"),
    )
