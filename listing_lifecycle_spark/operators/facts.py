"""Derived columns of listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listing_lifecycle_spark import fixed_values as fv
from listing_lifecycle_spark.functions import text


def count_of(name: str) -> Column:
    """A counter, null taken as zero."""
    return F.coalesce(F.col(name), F.lit(0))


def total_animals(columns: list[str] = fv.PET_COUNT_COLUMNS) -> Column:
    """Sum of the animal counters."""
    return reduce(lambda a, b: a + b, [count_of(name) for name in columns])


def duration_bucket(days: Column) -> Column:
    """Label of the sit length; null stays null, zero and negative lengths fall in the first bucket."""
    label = F.when(days.isNull(), F.lit(None).cast("string"))
    for upper, name in fv.DURATION_BUCKETS:
        label = label.otherwise(name) if upper is None else label.when(days <= upper, name)
    return label


def pet_label() -> Column:
    """One label for the animals of a listing; dogs with cats count as such whatever else is there."""
    dogs, cats = count_of("dogs_count"), count_of("cats_count")
    other = total_animals([c for c in fv.PET_COUNT_COLUMNS if c not in ("dogs_count", "cats_count")])
    return (
        F.when(F.coalesce(F.col("no_pets"), F.lit(False)), "No pets")
        .when((dogs != 0) & (cats != 0), "Dogs and cats")
        .when(((dogs != 0) | (cats != 0)) & (other != 0), "Mixed pets")
        .when(dogs != 0, "Dogs")
        .when(cats != 0, "Cats")
        .otherwise("Other")
    )


def inclusive_days(start: Column, end: Column) -> Column:
    """Days from start to end, both counted (the analytics reading of a stay)."""
    return F.datediff(end, start) + 1


def nights(parsed: Column, start: Column, end: Column) -> Column:
    """Parsed length, or the nights between the dates (the extraction reading); a parsed 0 is missing."""
    return F.coalesce(F.nullif(parsed, F.lit(0)), F.datediff(end, start))


def _coerced(df: DataFrame, name: str, kind: str) -> Column:
    column = F.col(name)
    if dict(df.dtypes)[name] != "string":
        return column.cast(kind)
    return F.try_to_timestamp(column).cast(kind)


def listing_facts(listings: DataFrame) -> DataFrame:
    """Listings with typed dates, filled duration and the derived report columns."""
    typed = listings.withColumns(
        {
            "start_date": _coerced(listings, "start_date", "date"),
            "end_date": _coerced(listings, "end_date", "date"),
            "first_seen_at": _coerced(listings, "first_seen_at", "timestamp_ntz"),
        }
    )
    filled = typed.withColumns(
        {
            "duration_days": F.coalesce(
                F.col("duration_days"), inclusive_days(F.col("start_date"), F.col("end_date"))
            ),
            "lead_time_days": F.datediff(F.col("start_date"), F.to_date("first_seen_at")),
            "pet_label": pet_label(),
            "has_dogs": F.coalesce(F.col("dogs_count") > 0, F.lit(False)),
            "has_cats": F.coalesce(F.col("cats_count") > 0, F.lit(False)),
        }
    )
    return filled.withColumns(
        {
            "duration_bucket": duration_bucket(F.col("duration_days")),
            "has_long_sit": F.coalesce(F.col("duration_days") >= fv.LONG_SIT_DAYS, F.lit(False)),
        }
    )


def explorer_rows(facts: DataFrame) -> DataFrame:
    """Columns of the row explorer, by start date."""
    return facts.select(*fv.EXPLORER_COLUMNS).orderBy(F.col("start_date").asc_nulls_last())


def summary_rows(listings: DataFrame) -> DataFrame:
    """Columns of the short listing summary."""
    return listings.select(*fv.SUMMARY_COLUMNS)


def persistable(listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into rows that may be stored and rows that lack a content hash or url."""
    storable = F.coalesce((F.col("content_hash") != "") & (F.col("url") != ""), F.lit(False))
    columns = [c for c in fv.LISTING_SCHEMA if c in listings.columns]
    rejected = listings.where(~storable).withColumn(
        "reject_reason",
        F.when(F.coalesce(F.col("content_hash"), F.lit("")) == "", "missing content_hash").otherwise("missing url"),
    )
    return listings.where(storable).select(*columns), rejected


def with_island(listings: DataFrame, locations: DataFrame) -> DataFrame:
    """Add the island of the region; an unknown region is kept with a null island."""
    islands = locations.groupBy("region").agg(F.min("island").alias("island"))
    return listings.drop("island").join(islands, "region", "left")


def metric_texts(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``<name>_text`` with rounded days for each metric."""
    return metrics.withColumns({f"{c}_text": text.days_text(F.col(c)) for c in columns})
