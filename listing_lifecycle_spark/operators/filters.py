"""Report filters over listing facts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listing_lifecycle_spark.sources.tables import all_of

MEMBER_COLUMNS = {
    "regions": "region",
    "subregions": "subregion",
    "cities": "city",
    "pet_labels": "pet_label",
    "duration_buckets": "duration_bucket",
    "statuses": "status",
}


@dataclass(frozen=True)
class FactFilter:
    """A report selection.  A missing range and an empty choice restrict nothing."""

    sit_from: date | str | None = None
    sit_to: date | str | None = None
    posted_from: date | str | None = None
    posted_to: date | str | None = None
    regions: Sequence[str] = ()
    subregions: Sequence[str] = ()
    cities: Sequence[str] = ()
    pet_labels: Sequence[str] = ()
    duration_buckets: Sequence[str] = ()
    statuses: Sequence[str] = ()

    def fixed_market(self, region: str, subregion: str) -> FactFilter:
        """The same selection for one market: its region and subregion forced, any city."""
        return replace(self, regions=(region,), subregions=(subregion,), cities=())


def day_range(column: str, first, last) -> list[Column]:
    """Both days inclusive, as a half-open range so that times of the last day count."""
    conditions = []
    if first is not None:
        conditions.append(F.col(column) >= F.lit(first).cast("date"))
    if last is not None:
        conditions.append(F.col(column) < F.date_add(F.lit(last).cast("date"), 1))
    return conditions


def member_of(column: str, chosen: Sequence[str]) -> list[Column]:
    """Membership; an empty choice means all, a null value is in no choice."""
    return [F.col(column).isin(*chosen)] if chosen else []


def filter_facts(facts: DataFrame, selection: FactFilter) -> DataFrame:
    """Apply a selection in one filter, so that its date and text parts reach the scan."""
    conditions = day_range("start_date", selection.sit_from, selection.sit_to)
    conditions += day_range("first_seen_at", selection.posted_from, selection.posted_to)
    for field, column in MEMBER_COLUMNS.items():
        conditions += member_of(column, getattr(selection, field))
    return facts.where(all_of(conditions)) if conditions else facts


def focus_location(facts: DataFrame, *, region: str | None = None, subregion: str | None = None) -> DataFrame:
    """Narrow to one region and then one subregion."""
    for column, value in (("region", region), ("subregion", subregion)):
        if value is not None:
            facts = facts.where(F.col(column) == value)
    return facts


def facet_options(facts: DataFrame, column: str, *, within: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Distinct values to choose from, under choices already made at higher levels."""
    for parent, chosen in (within or {}).items():
        for condition in member_of(parent, chosen):
            facts = facts.where(condition)
    return facts.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def valid_lead(facts: DataFrame) -> DataFrame:
    """Rows first seen on or before their start."""
    return facts.where(F.col("lead_time_days") >= 0)


def without_baseline(facts: DataFrame) -> DataFrame:
    """Drop rows whose first sighting was the first load, because their true age is unknown."""
    return facts.where(~F.col("first_seen_context").eqNullSafe("baseline"))
