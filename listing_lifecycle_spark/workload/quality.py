"""Constraint checks and the health report over the bound tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from listing_lifecycle_spark import fixed_values as fv
from listing_lifecycle_spark.functions import text
from listing_lifecycle_spark.operators import quality as qu
from listing_lifecycle_spark.plans import health as he
from listing_lifecycle_spark.session import shared_folder
from listing_lifecycle_spark.sources import tables as ta
from listing_lifecycle_spark.workload.bindings import with_views
from listing_lifecycle_spark.workload.catalog import query


def spoiled(t):
    """Listings with some values that break the rules."""
    return t.listings.withColumns(
        {
            "duration_days": F.col("duration_days") - F.when(F.col("house_type") == "1-URGENT", 10).otherwise(0),
            "reply_rating_score": F.col("reply_rating_score") + 2,
            "status": F.when(F.col("no_pets"), "gone").otherwise(F.col("status")),
            "island": F.when(F.col("region") == "ASIA", "East Island").otherwise(F.col("island")),
            "url": F.when(F.col("cats_count") == 0, F.col("url")),
            "end_date": F.when(F.col("fish_count") == 1, F.date_add("end_date", -30)).otherwise(F.col("end_date")),
            "content_hash": F.sha2("title", 256),
        }
    )


SPOILED_RULES = {
    "duration_days_not_negative": "duration_days - CASE WHEN house_type = '1-URGENT' THEN 10 ELSE 0 END < 0",
    "reply_rating_range": "reply_rating_score + 2 > 10",
    "status_known": "no_pets",
    "island_known": "region = 'ASIA'",
    "url_present": "cats_count <> 0",
    "date_order": "fish_count = 1 AND end_date - 30 < start_date",
}
#: Rules that no spoiled row breaks; they count nothing.
KEPT_RULES = [
    *(f"{c}_not_negative" for c in ("total_animals", *fv.PET_COUNT_COLUMNS)), "context_known", "external_id_present", "content_hash_present",
]


@query(
    "listing_violations", "DQ1 DQ2 DQ3 DQ4",
    with_views("places", "listings", body="\nUNION ALL ".join(
        f"SELECT external_id, start_date, '{name}' AS rule FROM listings WHERE {broken}" for name, broken in SPOILED_RULES.items())),
    dates="start_date",
)
def listing_violations(t):
    rows = spoiled(t)
    return qu.violations(rows, qu.listing_rules(rows.columns), ["external_id", "start_date"])


@query(
    "violation_counts", "DQ1 DQ2 DQ3 DQ4",
    with_views("places", "listings", body="\nUNION ALL ".join(
        f"SELECT '{name}' AS rule, count(*) AS violations FROM listings WHERE {broken}" for name, broken in (SPOILED_RULES | dict.fromkeys(KEPT_RULES, "false")).items())),
)
def violation_counts(t):
    rows = spoiled(t)
    return qu.violation_counts(rows, qu.listing_rules(rows.columns))


@query(
    "checked_write", "DQ1 DQ2 DQ3 DQ4 DQ7",
    with_views("places", "listings", body="\nUNION ALL ".join(
        f"SELECT '{name}' AS rule, count(*) AS counted, count(*) AS set_apart FROM listings WHERE {broken}" for name, broken in SPOILED_RULES.items())
        + "\nUNION ALL SELECT 'kept', count(*), count(*) FROM listings WHERE NOT coalesce(" + " OR ".join(f"coalesce({b}, false)" for b in SPOILED_RULES.values()) + ", false)"),
)
def checked_write(t):
    """Spoiled listings written in one pass: what was counted on the way, and what lies in the table of violations."""
    rows = spoiled(t)
    done = qu.check_and_write(rows, qu.listing_rules(rows.columns), f"{shared_folder(t.spark)}/checked-{uuid.uuid4().hex}", contract=dict(rows.dtypes))
    counted = [(name, n) for name, n in done.violations.items() if n] + [("kept", done.rows - done.broken(t.spark).count())]
    apart = done.broken(t.spark).select(F.explode("broken_rules").alias("rule")).unionByName(done.kept(t.spark).select(F.lit("kept").alias("rule")))
    return t.spark.createDataFrame(counted, "rule string, counted bigint").join(apart.groupBy("rule").agg(F.count(F.lit(1)).alias("set_apart")), "rule")


#: What a table of orders is held to have: one column more, one less, and another type.
ORDER_CONTRACT = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "int", "o_orderdate": "timestamp_ntz", "o_clerk": "string"}


@query(
    "contract_differences", "DQ7",
    """SELECT 'missing: o_clerk' AS difference, count(*) AS rows FROM orders UNION ALL SELECT 'not in contract: o_orderpriority', count(o_orderpriority) FROM orders
      UNION ALL SELECT 'type of o_totalprice: double, expected int', count(o_totalprice) FROM orders""",
)
def contract_differences(t):
    """How the orders differ from a contract, and how many rows it concerns."""
    rows = t.table("orders")
    found = [(d, d.removeprefix("type of ").removeprefix("not in contract: ").split(":")[0]) for d in qu.schema_differences(rows, ORDER_CONTRACT)]
    named = [F.struct(F.lit(d).alias("difference"), F.count(F.col(c) if c in rows.columns else F.lit(1)).alias("rows")) for d, c in found]
    return rows.agg(F.array(*named).alias("found")).select(F.inline("found"))


@query(
    "run_violations", "DQ1 DQ2",
    with_views("places", "locations", "runs", body="SELECT id, 'status_known' AS rule FROM runs WHERE status = 'partial_failure'"),
)
def run_violations(t):
    odd = t.runs.withColumn("status", F.when(F.col("status") == "partial_failure", "odd").otherwise(F.col("status")))
    return qu.violations(odd, qu.run_rules(), ["id"])


@query(
    "duplicate_listings", "DQ5",
    with_views("places", "listings", body="SELECT external_id, count(*) AS occurrences FROM listings GROUP BY 1 HAVING count(*) > 1"),
)
def duplicate_listings(t):
    return qu.duplicate_keys(t.listings, ["external_id"])


@query(
    "duplicate_active_listings", "DQ5",
    with_views("places", "listings", body="SELECT external_id, count(*) AS occurrences FROM listings WHERE status = 'active' GROUP BY 1 HAVING count(*) > 1"),
)
def duplicate_active_listings(t):
    return qu.duplicate_keys(t.listings, ["external_id"], F.col("status") == "active")


@query("orders_without_lines", "DQ6",
       "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orders_without_lines(t):
    return qu.orphans(t.table("orders").select("o_orderkey", "o_custkey"), t.table("lineitem"), "o_orderkey", "l_orderkey")


@query(
    "listing_json", "STR0 SNK5",
    with_views("places", "listings", body="""SELECT external_id, start_date, CAST(to_json({'external_id': external_id, 'region': region,
      'duration_days': duration_days, 'start_date': start_date, 'no_pets': no_pets}) AS VARCHAR) AS json FROM listings"""),
    dates="start_date",
)
def listing_json(t):
    rows = t.listings.select("external_id", "region", "duration_days", "start_date", "no_pets")
    fields = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    return rows.select("external_id", "start_date", fields.alias("json"))


@query(
    "listing_json_round_trip", "STR0 S20",
    with_views("places", "listings", body="SELECT external_id, region, duration_days, start_date, no_pets, title FROM listings"),
    dates="start_date",
)
def listing_json_round_trip(t):
    back = ta.from_json(ta.as_json(t.listings))
    return back.select("external_id", "region", "duration_days", "start_date", "no_pets", "title")


@query(
    "snapshot_columns", "SRC2",
    with_views("places", "state", body="""SELECT external_id, region, end_date, first_seen_at, status, CAST(missing_count AS INTEGER) AS missing_count,
      CAST(NULL AS INTEGER) AS dogs_count, CAST(NULL AS VARCHAR) AS title FROM state"""),
    dates="end_date", instants="first_seen_at",
)
def snapshot_columns(t):
    whole = ta.complete_columns(t.state)
    return whole.select("external_id", "region", "end_date", "first_seen_at", "status", "missing_count", "dogs_count", "title")


@query(
    "snapshot_metadata", "SNK1",
    with_views("places", "listings", body="""SELECT 'source' AS key, 'orders' AS value UNION ALL SELECT 'listing_count', CAST(count(*) AS VARCHAR) FROM listings
      UNION ALL SELECT 'refreshed_at', '2026-06-01T00:00:00'"""),
)
def snapshot_metadata(t):
    return ta.snapshot_metadata(t.listings, source="orders", refreshed_at="2026-06-01T00:00:00")


NOW = "2001-08-03 06:00:00"
HOURS = 240
HEALTH = ("places", "locations", "scopes", "runs")
#: The status in SQL: no success or coverage too old is critical, else the number of failures decides.
STATUS_SQL = f"""CASE WHEN successful_runs = 0 OR stalest_name IS NULL OR stalest_success IS NULL
  OR epoch_us(now_at) - epoch_us(stalest_success) > stalest_interval * {fv.HEALTH_STALE_INTERVALS} * 60000000::BIGINT THEN 'CRITICAL'
  WHEN failed_runs = 0 THEN 'FLAWLESS' WHEN failed_runs <= {fv.HEALTH_OK_MAX_FAILURES} THEN 'OK' WHEN failed_runs <= {fv.HEALTH_WARN_MAX_FAILURES} THEN 'WARN' ELSE 'CRITICAL' END"""
WINDOW = f"TIMESTAMP '{NOW}' - INTERVAL {HOURS} HOUR"


@query(
    "health_by_scope", "AGG16 ANA9",
    with_views(*HEALTH, body=f"""SELECT scope_name, count(*) AS runs, CAST(sum(new_listings) AS BIGINT) AS new_listings,
      CAST(sum(changed_listings) AS BIGINT) AS changed_listings FROM runs WHERE status = 'success' AND finished_at >= {WINDOW} GROUP BY 1"""),
)
def health_by_scope(t):
    return he.successes_by_scope(t.runs, now=NOW, hours=HOURS)


@query(
    "failed_attempts", "AGG17",
    with_views(*HEALTH, body=f"""SELECT count(*) AS failed_runs FROM runs WHERE status IN ('failed', 'partial_failure', 'suspicious')
      AND started_at >= {WINDOW}"""),
)
def failed_attempts(t):
    return he.failed_attempts(t.runs, now=NOW, hours=HOURS)


STALEST = f"""SELECT name, interval_minutes, last_success_at, CASE WHEN last_success_at IS NULL THEN 'Infinity'::DOUBLE
  ELSE greatest(0, epoch(TIMESTAMP '{NOW}') - epoch(last_success_at)) / (interval_minutes * 60) END AS ratio
  FROM scopes WHERE enabled ORDER BY ratio DESC, name LIMIT 1"""


@query(
    "stalest_scope", "WIN4",
    with_views(*HEALTH, body=f"SELECT name, interval_minutes, last_success_at FROM ({STALEST})"), instants="last_success_at",
)
def stalest_scope(t):
    return he.stalest_scope(t.scopes, now=NOW).select("name", "interval_minutes", "last_success_at")


@query(
    "stalest_successful_scope", "WIN4 S14",
    with_views(*HEALTH, body=f"""SELECT name, round(ratio, 6) AS ratio, concat(CAST(round_even((epoch(TIMESTAMP '{NOW}') - epoch(last_success_at)) / 86400, 0) AS BIGINT),
      'd (', name, ', interval ', interval_minutes, 'm)') AS freshness FROM ({STALEST.replace('FROM scopes', "FROM (SELECT * FROM scopes WHERE last_success_at IS NOT NULL) scopes")})"""),
)
def stalest_successful_scope(t):
    known = t.scopes.where("last_success_at is not null")
    return he.stalest_scope(known, now=NOW).select(
        "name", "ratio",
        he.freshness_text(NOW, F.col("name"), F.col("interval_minutes"), F.col("last_success_at")).alias("freshness"),
    )


@query(
    "run_age_texts", "S14",
    with_views("places", "locations", "runs", body=f"""SELECT id, CASE WHEN s < 5400 THEN concat(CAST(round_even(s / 60, 0) AS BIGINT), 'm')
      WHEN s < 172800 THEN concat(CAST(round_even(s / 3600, 0) AS BIGINT), 'h') ELSE concat(CAST(round_even(s / 86400, 0) AS BIGINT), 'd') END AS age
      FROM (SELECT id, CAST(abs(epoch(started_at) - epoch(finished_at)) * (1 + id % 9) AS BIGINT) AS s FROM runs WHERE finished_at IS NOT NULL)"""),
)
def run_age_texts(t):
    seconds = F.timestamp_diff("SECOND", F.col("started_at"), F.col("finished_at")) * (1 + F.col("id") % 9)
    return t.runs.where("finished_at is not null").select("id", text.age_text(seconds).alias("age"))


BANDS = """CASE WHEN failed_runs = 0 THEN 'FLAWLESS' WHEN failed_runs <= 4 THEN 'OK' WHEN failed_runs <= 19 THEN 'WARN' ELSE 'CRITICAL' END"""


@query(
    "daily_status_bands", "AGG18",
    with_views("places", "locations", "runs", body=f"""SELECT day, failed_runs, {BANDS} AS status FROM (SELECT CAST(started_at AS DATE) AS day,
      count(*) FILTER (WHERE status IN ('failed', 'partial_failure', 'suspicious')) AS failed_runs FROM runs GROUP BY 1)"""),
    dates="day",
)
def daily_status_bands(t):
    failed = F.col("status").isin("failed", "partial_failure", "suspicious")
    daily = t.runs.groupBy(F.to_date("started_at").alias("day")).agg(F.count_if(failed).alias("failed_runs"))
    return daily.withColumn("status", he.status_band(F.col("failed_runs")))


@query(
    "health_summary", "AGG18 ANA9 S14",
    with_views(*HEALTH, body=f"""SELECT coalesce(s.runs, 0) AS successful_runs, f.failed_runs, CAST(s.new_listings AS BIGINT) AS new_listings,
      CAST(s.changed_listings AS BIGINT) AS changed_listings, x.name AS stalest_name, CAST(x.interval_minutes AS INTEGER) AS stalest_interval,
      'CRITICAL' AS status, concat('never (', x.name, ', interval ', x.interval_minutes, 'm)') AS freshness
      FROM (SELECT count(*) AS runs, sum(new_listings) AS new_listings, sum(changed_listings) AS changed_listings FROM runs
        WHERE status = 'success' AND finished_at >= {WINDOW}) s,
      (SELECT count(*) AS failed_runs FROM runs WHERE status IN ('failed', 'partial_failure', 'suspicious') AND started_at >= {WINDOW}) f,
      ({STALEST}) x"""),
)
def health_summary(t):
    return he.health_summary(t.runs, t.scopes, now=NOW, hours=HOURS).drop("stalest_success")


@query(
    "health_lines", "ANA9",
    with_views(*HEALTH, body=f"""SELECT 1 AS part, scope_name AS sort_key, concat('- ', scope_name, ': ', count(*)) AS line FROM runs
      WHERE status = 'success' AND finished_at >= {WINDOW} GROUP BY scope_name
      UNION ALL SELECT 0, '', '-- Health check -- CRITICAL'
      UNION ALL SELECT 2, '', concat('Total: ', count(*), ' scans, ', sum(new_listings), ' new, ', sum(changed_listings), ' changed') FROM runs
        WHERE status = 'success' AND finished_at >= {WINDOW}
      UNION ALL SELECT 3, '', concat('Failed scan attempts: ', count(*)) FROM runs WHERE status IN ('failed', 'partial_failure', 'suspicious') AND started_at >= {WINDOW}
      UNION ALL SELECT 4, '', concat('Stalest coverage: never (', name, ', interval ', interval_minutes, 'm)') FROM ({STALEST})"""),
)
def health_lines(t):
    return he.health_lines(t.runs, t.scopes, now=NOW, hours=HOURS)


#: Moments and windows (hours) of health reports, from quiet ones to one with many failures.
REPORTS = [("1995-02-01 00:00:00", 24), ("1995-03-05 00:00:00", 24), ("1995-03-09 00:00:00", 240), ("1995-04-01 12:00:00", 24), ("1995-05-01 00:00:00", 720)]


@query(
    "health_reports", "ANA9 AGG16 AGG17 AGG18 WIN4",
    with_views(*HEALTH, body=f"""SELECT strftime(now_at, '%Y-%m-%d %H:%M') AS at, successful_runs, failed_runs, stalest_name, {STATUS_SQL} AS status FROM (
      SELECT d.now_at, (SELECT count(*) FROM runs r WHERE r.status = 'success' AND r.finished_at >= d.now_at - to_hours(d.hours) AND r.finished_at < d.now_at) AS successful_runs,
        (SELECT count(*) FROM runs r WHERE r.status IN ('failed', 'partial_failure', 'suspicious') AND r.started_at >= d.now_at - to_hours(d.hours) AND r.started_at < d.now_at) AS failed_runs,
        s.name AS stalest_name, s.interval_minutes AS stalest_interval, s.latest AS stalest_success
      FROM (VALUES {", ".join(f"(TIMESTAMP '{at}', {hours})" for at, hours in REPORTS)}) d(now_at, hours)
      JOIN (SELECT *, row_number() OVER (PARTITION BY now_at ORDER BY (epoch_us(now_at) - epoch_us(latest)) / (interval_minutes * 60000000::BIGINT) DESC, name) AS rn FROM (
          SELECT x.now_at, c.name, c.interval_minutes * 4000 AS interval_minutes, max(r.finished_at) AS latest FROM (VALUES {", ".join(f"(TIMESTAMP '{at}')" for at, _ in REPORTS)}) x(now_at)
          JOIN runs r ON r.status = 'success' AND r.finished_at < x.now_at JOIN scopes c ON c.name = r.scope_name AND c.enabled AND c.subregion_slug IS NOT NULL GROUP BY ALL)) s
        ON s.now_at = d.now_at AND s.rn = 1)"""),
)
def health_reports(t):
    """Health reports of several moments, each from the runs before it: bands from flawless to critical."""
    runs, out = t.runs, None
    watched = t.scopes.where("subregion_slug IS NOT NULL").select("name", "enabled", (F.col("interval_minutes") * 4000).alias("interval_minutes"))
    for now, hours in REPORTS:
        counted = F.when(F.col("status") == "success", F.col("finished_at")).otherwise(F.col("started_at"))
        past = runs.where(counted < F.lit(now).cast("timestamp_ntz"))
        latest = past.where("status = 'success'").groupBy(F.col("scope_name").alias("name")).agg(F.max("finished_at").alias("last_success_at"))
        row = he.health_summary(past, watched.join(latest, "name"), now=now, hours=hours)
        row = row.select(F.lit(now[:16]).alias("at"), "successful_runs", "failed_runs", "stalest_name", "status")
        out = row if out is None else out.unionByName(row)
    return out
