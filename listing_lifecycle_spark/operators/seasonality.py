"""Calendar profiles: how many listings each week or month holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listing_lifecycle_spark.functions.calendar import period_index, period_parts, period_start


def seasonality(facts: DataFrame, *, basis: str = "sit_dates", interval: str = "month") -> DataFrame:
    """Per period: distinct listings and the mean duration and lead of the rows that touch it.

    A stay touches every period between its dates.  Expanding each stay into its
    periods would multiply the rows before the first shuffle, so stays are kept as
    spans of period numbers:

    * per listing and span, partial sums (combined on the map side);
    * per listing, each span is cut back to the periods no earlier span of the
      same listing covers, so that the cut spans count each listing once;
    * spans with equal ends are added up.  What is left is bounded by the
      calendar, and only that is expanded into periods.
    """
    if basis == "sit_dates":
        start, end = F.col("start_date"), F.col("end_date")
    elif basis == "first_seen":
        start = end = F.to_date("first_seen_at")
    else:
        raise ValueError(f"unknown basis: {basis}")

    spans = (
        facts.where(start.isNotNull() & end.isNotNull() & (end >= start))
        .select(
            "external_id",
            period_index(start, interval).alias("first"),
            period_index(end, interval).alias("last"),
            F.col("duration_days").cast("bigint").alias("duration"),
            F.col("lead_time_days").cast("bigint").alias("lead"),
        )
        .groupBy("external_id", "first", "last")
        .agg(
            F.sum("duration").alias("duration_sum"),
            F.count("duration").alias("duration_n"),
            F.sum("lead").alias("lead_sum"),
            F.count("lead").alias("lead_n"),
        )
    )
    earlier = (
        Window.partitionBy("external_id").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    )
    sums = ["ids", "duration_sum", "duration_n", "lead_sum", "lead_n"]
    nothing = F.lit(0).cast("bigint")
    cut = spans.withColumn("covered", F.max("last").over(earlier)).select(
        F.inline(
            F.array(
                F.struct(
                    F.col("first"), F.col("last"), nothing.alias("ids"),
                    *[F.col(name) for name in sums[1:]],
                ),
                F.struct(
                    F.greatest(F.col("first"), F.col("covered") + 1).alias("first"), F.col("last"),
                    F.col("external_id").isNotNull().cast("bigint").alias("ids"),
                    *[nothing.alias(name) for name in sums[1:]],
                ),
            )
        )
    )
    merged = (
        cut.where(F.col("last") >= F.col("first"))
        .groupBy("first", "last")
        .agg(*[F.sum(name).alias(name) for name in sums])
    )
    periods = (
        merged.select(F.explode(F.sequence("first", "last")).alias("period"), *sums)
        .groupBy("period")
        .agg(*[F.sum(name).alias(name) for name in sums])
        .withColumn("period_start", period_start(F.col("period"), interval))
    )
    return periods.select(
        "period_start",
        *[column.alias(name) for name, column in period_parts(F.col("period_start")).items()],
        F.col("ids").alias("listing_count"),
        F.try_divide("duration_sum", "duration_n").alias("avg_duration_days"),
        F.try_divide("lead_sum", "lead_n").alias("avg_lead_time_days"),
    )


TOTALS = ["listing_count", "duration_sum", "duration_n", "lead_sum", "lead_n"]


def period_changes(before: DataFrame, after: DataFrame, *, interval: str = "month") -> DataFrame:
    """What a run changes in the period totals: the periods of the rows that it replaced are taken back, those of the new rows added.

    ``before`` and ``after`` hold the old and the new facts of the changed listings only, each listing once at most.
    Returns period_start and, for each of ``TOTALS``, the change; periods that stay as they were are left out.  As in
    :func:`seasonality`, equal spans are added up before a span becomes periods.
    """
    def spans(rows: DataFrame, sign: int) -> DataFrame:
        fine = rows.where(F.col("start_date").isNotNull() & F.col("end_date").isNotNull() & (F.col("end_date") >= F.col("start_date")))
        duration, lead = F.col("duration_days").cast("bigint"), F.col("lead_time_days").cast("bigint")
        one = F.lit(sign).cast("bigint")
        return fine.select(
            period_index(F.col("start_date"), interval).alias("first"), period_index(F.col("end_date"), interval).alias("last"),
            one.alias("listing_count"), F.coalesce(duration * sign, F.lit(0)).alias("duration_sum"), F.when(duration.isNotNull(), one).otherwise(0).alias("duration_n"),
            F.coalesce(lead * sign, F.lit(0)).alias("lead_sum"), F.when(lead.isNotNull(), one).otherwise(0).alias("lead_n"),
        )

    add = [F.sum(name).alias(name) for name in TOTALS]
    merged = spans(before, -1).union(spans(after, 1)).groupBy("first", "last").agg(*add)
    moved = merged.where(" OR ".join(f"{name} <> 0" for name in TOTALS))
    periods = moved.select(F.explode(F.sequence("first", "last")).alias("period"), *TOTALS).groupBy("period").agg(*add)
    return periods.where(" OR ".join(f"{name} <> 0" for name in TOTALS)).select(period_start(F.col("period"), interval).alias("period_start"), *TOTALS)


def apply_changes(totals: DataFrame, changes: DataFrame) -> DataFrame:
    """Period totals after ``changes``; periods that no listing touches any more are gone.  Both are calendar-sized."""
    both = totals.select("period_start", *TOTALS).union(changes.select("period_start", *TOTALS))
    return both.groupBy("period_start").agg(*[F.sum(name).alias(name) for name in TOTALS]).where("listing_count <> 0")


def profile_of(totals: DataFrame) -> DataFrame:
    """The profile of :func:`seasonality` from period totals."""
    return totals.select(
        "period_start",
        *[column.alias(name) for name, column in period_parts(F.col("period_start")).items()],
        "listing_count",
        F.try_divide("duration_sum", "duration_n").alias("avg_duration_days"),
        F.try_divide("lead_sum", "lead_n").alias("avg_lead_time_days"),
    )


def heatmap(profile: DataFrame, *, metric: str = "listing_count", interval: str = "month") -> DataFrame:
    """Year by month or week; counts are added, means averaged, absent cells are 0."""
    columns = list(range(1, 13)) if interval == "month" else list(range(1, 54))
    total = F.sum(metric) if metric == "listing_count" else F.avg(metric)
    cells = profile.groupBy("year").pivot("month" if interval == "month" else "week", columns).agg(total)
    prefix = interval[0]
    named = cells.select("year", *[F.col(str(c)).alias(f"{prefix}{c:02d}") for c in columns])
    return named.fillna(0)


def weekly_timeline(facts: DataFrame) -> DataFrame:
    """One row per week from the first to the last with a stay, weeks without any included."""
    weeks = seasonality(facts, basis="sit_dates", interval="week").select("period_start", "listing_count")
    return fill_weeks(weeks)


def fill_weeks(weeks: DataFrame) -> DataFrame:
    """Add the missing weeks with a count of 0.  The input holds one row per week at most.

    Each week writes out those up to the next one, so the input is worked out
    once (one row per week: a single small window).
    """
    following = F.lead("period_start").over(Window.orderBy("period_start"))
    last = F.greatest(F.coalesce(F.date_sub(following, 7), F.col("period_start")), F.col("period_start"))
    spans = weeks.select("period_start", "listing_count", last.alias("last"))
    every = spans.select("listing_count", "period_start", F.explode(F.sequence("period_start", "last", F.expr("interval 7 days"))).alias("week"))
    count = F.when(F.col("week") == F.col("period_start"), F.col("listing_count")).otherwise(0)
    return every.select(F.col("week").alias("period_start"), F.coalesce(count, F.lit(0)).cast("bigint").alias("listing_count"))


def month_boundaries(timeline: DataFrame) -> DataFrame:
    """Mark the weeks whose month differs from the week before (one row per week: a single small window)."""
    order = Window.orderBy("period_start")
    before = F.lag(F.month("period_start")).over(order)
    return timeline.withColumn(
        "month_boundary", F.coalesce(F.month("period_start") != before, F.lit(False))
    )


def select_year(timeline: DataFrame, year: int | None = None) -> DataFrame:
    """Weeks of one calendar year, the latest unless told otherwise."""
    if year is not None:
        return timeline.where(F.year("period_start") == year)
    latest = F.max(F.year("period_start")).over(Window.partitionBy(F.lit(1)))
    return timeline.withColumn("_latest", latest).where(F.year("period_start") == F.col("_latest")).drop("_latest")
