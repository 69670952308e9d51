"""Daily health report of the collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listing_lifecycle_spark import fixed_values as fv
from listing_lifecycle_spark.functions.calendar import instant
from listing_lifecycle_spark.functions.text import age_text


def _since(now, hours: int) -> Column:
    return instant(now) - F.make_dt_interval(F.lit(0), F.lit(hours))


def successes_by_scope(runs: DataFrame, *, now, hours: int = fv.HEALTH_WINDOW_HOURS) -> DataFrame:
    """Successful runs, new and changed listings per scope within the window (by the end of the run)."""
    return (
        runs.where((F.col("status") == "success") & (F.col("finished_at") >= _since(now, hours)))
        .groupBy("scope_name")
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.coalesce(F.sum("new_listings"), F.lit(0)).cast("bigint").alias("new_listings"),
            F.coalesce(F.sum("changed_listings"), F.lit(0)).cast("bigint").alias("changed_listings"),
        )
    )


def failed_attempts(runs: DataFrame, *, now, hours: int = fv.HEALTH_WINDOW_HOURS) -> DataFrame:
    """Unsuccessful runs within the window (by the start of the run)."""
    failed = F.col("status").isin(*fv.UNSUCCESSFUL_RUN_STATUSES)
    return runs.where(failed & (F.col("started_at") >= _since(now, hours))).agg(F.count(F.lit(1)).alias("failed_runs"))


def _age_seconds(now, moment: Column) -> Column:
    seconds = F.timestamp_diff("SECOND", moment, instant(now)).cast("bigint")
    return F.greatest(F.lit(0).cast("bigint"), seconds)


def stalest_scope(scopes: DataFrame, *, now) -> DataFrame:
    """The enabled scope that is oldest in terms of its interval; one that never succeeded is oldest of all."""
    micros = F.greatest(F.lit(0).cast("bigint"), F.timestamp_diff("MICROSECOND", F.col("last_success_at"), instant(now)))
    ratio = F.when(F.col("last_success_at").isNull(), F.lit(float("inf"))).otherwise(
        micros / (F.col("interval_minutes").cast("bigint") * 60_000_000)
    )
    ranked = scopes.where("enabled").select("name", "interval_minutes", "last_success_at", ratio.alias("ratio"))
    return ranked.orderBy(F.desc("ratio"), F.asc("name")).limit(1)


def status_band(failures: Column) -> Column:
    """Band of a number of failed attempts."""
    return (
        F.when(failures == 0, "FLAWLESS")
        .when(failures <= fv.HEALTH_OK_MAX_FAILURES, "OK")
        .when(failures <= fv.HEALTH_WARN_MAX_FAILURES, "WARN")
        .otherwise("CRITICAL")
    )


def freshness_text(now, name: Column, interval: Column, last_success: Column) -> Column:
    """Age of the stalest coverage in words."""
    place = F.concat(F.lit(" ("), name, F.lit(", interval "), interval.cast("string"), F.lit("m)"))
    return (
        F.when(name.isNull(), "no enabled scopes")
        .when(last_success.isNull(), F.concat(F.lit("never"), place))
        .otherwise(F.concat(age_text(_age_seconds(now, last_success)), place))
    )


def health_summary(runs: DataFrame, scopes: DataFrame, *, now, hours: int = fv.HEALTH_WINDOW_HOURS) -> DataFrame:
    """Totals, stalest scope and status in one row.

    The parts are one-row results; they are put side by side by a union and one
    aggregation.
    """
    scope_type = "struct<name: string, interval_minutes: int, last_success_at: timestamp_ntz>"
    per_scope = successes_by_scope(runs, now=now, hours=hours)
    totals = per_scope.agg(
        F.coalesce(F.sum("runs"), F.lit(0)).cast("bigint").alias("successful_runs"),
        F.coalesce(F.sum("new_listings"), F.lit(0)).cast("bigint").alias("new_listings"),
        F.coalesce(F.sum("changed_listings"), F.lit(0)).cast("bigint").alias("changed_listings"),
    )
    stalest = stalest_scope(scopes, now=now).select(
        F.struct(F.col("name"), F.col("interval_minutes").cast("int"), F.col("last_success_at").cast("timestamp_ntz"))
        .cast(scope_type).alias("stalest")
    )
    parts = totals.unionByName(failed_attempts(runs, now=now, hours=hours), allowMissingColumns=True).unionByName(
        stalest, allowMissingColumns=True
    )
    row = parts.agg(
        *[F.max(c).alias(c) for c in ("successful_runs", "new_listings", "changed_listings", "failed_runs")],
        F.first("stalest", ignorenulls=True).alias("stalest"),
    )
    name, interval, success = [F.col(f"stalest.{c}") for c in ("name", "interval_minutes", "last_success_at")]
    limit = interval.cast("bigint") * F.lit(fv.HEALTH_STALE_INTERVALS) * F.lit(60_000_000)
    too_old = name.isNull() | success.isNull() | (F.timestamp_diff("MICROSECOND", success, instant(now)) > limit)
    return row.select(
        "successful_runs", "failed_runs", "new_listings", "changed_listings",
        name.alias("stalest_name"), interval.alias("stalest_interval"), success.alias("stalest_success"),
        F.when((F.col("successful_runs") == 0) | F.coalesce(too_old, F.lit(True)), "CRITICAL")
        .otherwise(status_band(F.col("failed_runs"))).alias("status"),
        freshness_text(now, name, interval, success).alias("freshness"),
    )


def health_lines(runs: DataFrame, scopes: DataFrame, *, now, hours: int = fv.HEALTH_WINDOW_HOURS) -> DataFrame:
    """Lines of the report in order (``position``, ``line``); a scope contributes one line."""
    per_scope = successes_by_scope(runs, now=now, hours=hours)
    scope_lines = per_scope.select(
        F.lit(1).alias("part"), F.col("scope_name").alias("sort_key"),
        F.concat(F.lit("- "), "scope_name", F.lit(": "), F.col("runs").cast("string")).alias("line"),
    )
    row = health_summary(runs, scopes, now=now, hours=hours)

    def text_line(part: int, line: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), F.lit("").alias("sort_key"), line.alias("line"))

    fixed = row.select(
        F.inline(
            F.array(
                text_line(0, F.concat(F.lit("-- Health check -- "), "status")),
                text_line(1, F.when(F.col("successful_runs") == 0, "Scans: none")),
                text_line(2, F.concat(
                    F.lit("Total: "), F.col("successful_runs"), F.lit(" scans, "), F.col("new_listings"), F.lit(" new, "),
                    F.col("changed_listings"), F.lit(" changed"))),
                text_line(3, F.concat(F.lit("Failed scan attempts: "), F.col("failed_runs"))),
                text_line(4, F.concat(F.lit("Stalest coverage: "), "freshness")),
            )
        )
    )
    return fixed.where("line is not null").unionByName(scope_lines).orderBy("part", "sort_key")
