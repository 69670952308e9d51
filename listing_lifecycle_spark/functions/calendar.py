"""Periods, local time and quiet hours.

Instants are zone-less timestamps that hold UTC (``timestamp_ntz``, the type
of the stored tables), so results do not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listing_lifecycle_spark import fixed_values as fv

_FIRST_MONDAY = "1970-01-05"


def as_column(value) -> Column:
    """Literal or column; text is taken as a zone-less instant or day by the caller's cast."""
    return value if isinstance(value, Column) else F.lit(value)


def instant(value) -> Column:
    """A zone-less UTC instant from a column, datetime or text."""
    return as_column(value).cast("timestamp_ntz")


def day(value) -> Column:
    """A date from a column, date or text."""
    return as_column(value).cast("date")


def week_start(value: Column) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", value).cast("date")


def month_start(value: Column) -> Column:
    """First day of the month."""
    return F.trunc(value, "MM")


def period_index(value: Column, interval: str) -> Column:
    """Consecutive number of the week or month, so that spans of periods become integer ranges."""
    if interval == "week":
        return F.floor(F.datediff(value, F.lit(_FIRST_MONDAY).cast("date")) / 7).cast("int")
    if interval == "month":
        return (F.year(value) * 12 + F.month(value) - 1).cast("int")
    raise ValueError(f"unknown interval: {interval}")


def period_start(index: Column, interval: str) -> Column:
    """First day of the period with this number."""
    if interval == "week":
        return F.date_add(F.lit(_FIRST_MONDAY).cast("date"), index * 7)
    if interval == "month":
        return F.make_date(F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"), F.lit(1))
    raise ValueError(f"unknown interval: {interval}")


def period_parts(start: Column) -> dict[str, Column]:
    """Calendar year, month and ISO week of a period start (ISO week beside calendar year, on purpose)."""
    return {
        "year": F.year(start).cast("int"),
        "month": F.month(start).cast("int"),
        "week": F.weekofyear(start).cast("int"),
    }


def periods_between(start: Column, end: Column, interval: str) -> Column:
    """Array of period starts; empty for a missing or reversed range."""
    first, last = period_index(start, interval), period_index(end, interval)
    numbers = F.when(end >= start, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.coalesce(numbers, F.array().cast("array<int>")), lambda n: period_start(n, interval))


def local_time(value: Column, zone) -> Column:
    """Wall clock of ``zone`` at a UTC instant."""
    return F.convert_timezone(F.lit("UTC"), as_column(zone), instant(value))


def utc_time(value: Column, zone) -> Column:
    """UTC instant of a wall clock in ``zone``; a skipped hour moves on, a repeated hour means its first pass."""
    return F.convert_timezone(as_column(zone), F.lit("UTC"), value)


def _minutes(clock: Column) -> Column:
    return F.split_part(clock, F.lit(":"), F.lit(1)).cast("int") * 60 + F.split_part(
        clock, F.lit(":"), F.lit(2)
    ).cast("int")


def in_quiet_hours(value: Column, zone=fv.LOCAL_TIME_ZONE, start=fv.QUIET_HOURS[0], end=fv.QUIET_HOURS[1]) -> Column:
    """Whether the local wall clock lies in ``[start, end)``."""
    local = local_time(value, zone)
    minute = F.hour(local) * 60 + F.minute(local)
    return (minute >= _minutes(as_column(start))) & (minute < _minutes(as_column(end)))


def deliver_after(value: Column, zone, start, end) -> Column:
    """End of the quiet window an instant falls in, else the instant itself.  A window may cross midnight."""
    local = local_time(value, zone)
    opens, closes = _minutes(as_column(start)), _minutes(as_column(end))
    minute = F.hour(local) * 60 + F.minute(local)
    midnight = F.date_trunc("day", local).cast("timestamp_ntz")
    closing = midnight + F.make_dt_interval(mins=closes)
    next_closing = midnight + F.make_dt_interval(days=F.lit(1), mins=closes)
    within_day = opens < closes
    return (
        F.when(within_day & (minute >= opens) & (minute < closes), utc_time(closing, zone))
        .when(~within_day & (minute >= opens), utc_time(next_closing, zone))
        .when(~within_day & (minute < closes), utc_time(closing, zone))
        .otherwise(instant(value))
    )
