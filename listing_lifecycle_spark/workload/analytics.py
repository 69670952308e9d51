"""Market analytics over the bound listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from listing_lifecycle_spark import fixed_values as fv
from listing_lifecycle_spark.functions import calendar, text
from listing_lifecycle_spark.operators import facts as fa
from listing_lifecycle_spark.operators import filters as fl
from listing_lifecycle_spark.operators import ranking as rk
from listing_lifecycle_spark.operators import seasonality as se
from listing_lifecycle_spark.workload.bindings import SQL, with_views
from listing_lifecycle_spark.workload.catalog import query

FACTS = ("places", "listings", "facts")


def facts_sql(body: str) -> str:
    return with_views(*FACTS, body=body)


@query(
    "listing_facts", "SRC1 PRJ1 PRJ2 PRJ3 PRJ4 PRJ5 PRJ6 PRJ10",
    facts_sql("""SELECT external_id, start_date, end_date, CAST(first_seen_at AS DATE) AS first_seen, duration_days,
      duration_bucket, lead_time_days, pet_label, has_dogs, has_cats, has_long_sit, total_animals FROM facts"""),
    dates="start_date end_date first_seen",
)
def listing_facts(t):
    return t.facts.select(
        "external_id", "start_date", "end_date", F.to_date("first_seen_at").alias("first_seen"), "duration_days",
        "duration_bucket", "lead_time_days", "pet_label", "has_dogs", "has_cats", "has_long_sit",
        fa.total_animals().alias("total_animals"),
    )


@query(
    "explorer_rows", "PRJ7 ANA7 SRT6",
    facts_sql("""SELECT external_id, region, subregion, city, start_date, end_date, duration_days, pet_label,
      dogs_count, cats_count, CAST(first_seen_at AS DATE) AS first_seen_at, lead_time_days, status, url FROM facts
      ORDER BY start_date NULLS LAST"""),
    dates="start_date end_date first_seen_at",
)
def explorer_rows(t):
    return fa.explorer_rows(t.facts).withColumn("first_seen_at", F.to_date("first_seen_at"))


@query(
    "summary_rows", "PRJ8",
    with_views("places", "listings", body="SELECT " + ", ".join(fv.SUMMARY_COLUMNS) + " FROM listings"),
    dates="start_date end_date",
)
def summary_rows(t):
    return fa.summary_rows(t.listings)


@query(
    "sit_date_range", "FLT1",
    facts_sql("""SELECT external_id, start_date FROM facts
      WHERE start_date >= DATE '1996-01-01' AND start_date < DATE '1996-12-31' + 1"""),
    dates="start_date",
)
def sit_date_range(t):
    return fl.filter_facts(t.facts, fl.FactFilter(sit_from="1996-01-01", sit_to="1996-12-31")).select(
        "external_id", "start_date"
    )


@query(
    "posted_range", "FLT2",
    facts_sql("""SELECT external_id, CAST(first_seen_at AS DATE) AS posted FROM facts
      WHERE first_seen_at >= DATE '1997-03-01' AND first_seen_at < DATE '1997-08-31' + 1"""),
    dates="posted",
)
def posted_range(t):
    return fl.filter_facts(t.facts, fl.FactFilter(posted_from="1997-03-01", posted_to="1997-08-31")).select(
        "external_id", F.to_date("first_seen_at").alias("posted")
    )


@query(
    "member_filter", "FLT3",
    facts_sql("""SELECT external_id, region, status FROM facts
      WHERE region IN ('ASIA', 'EUROPE') AND status IN ('active')"""),
)
def member_filter(t):
    return fl.filter_facts(t.facts, fl.FactFilter(regions=("ASIA", "EUROPE"), statuses=("active",))).select(
        "external_id", "region", "status"
    )


SELECTION = fl.FactFilter(
    sit_from="1995-01-01", sit_to="1999-12-31", posted_from="1994-01-01", posted_to="1999-06-30",
    regions=("AMERICA", "ASIA"), pet_labels=("Dogs", "Cats", "Mixed pets"),
    duration_buckets=("15-30 days", "31-60 days"), statuses=("active", "expired_by_date"),
)
SELECTION_SQL = """start_date >= DATE '1995-01-01' AND start_date < DATE '2000-01-01'
  AND first_seen_at >= DATE '1994-01-01' AND first_seen_at < DATE '1999-07-01'
  AND pet_label IN ('Dogs', 'Cats', 'Mixed pets') AND duration_bucket IN ('15-30 days', '31-60 days')
  AND status IN ('active', 'expired_by_date')"""


@query(
    "dashboard_filter", "FLT4",
    facts_sql(f"""SELECT external_id, start_date, region, pet_label, duration_bucket FROM facts
      WHERE {SELECTION_SQL} AND region IN ('AMERICA', 'ASIA')"""),
    dates="start_date",
)
def dashboard_filter(t):
    return fl.filter_facts(t.facts, SELECTION).select(
        "external_id", "start_date", "region", "pet_label", "duration_bucket"
    )


@query(
    "fixed_market_filter", "FLT5",
    facts_sql(f"""SELECT external_id, region, subregion, city FROM facts
      WHERE {SELECTION_SQL} AND region = 'EUROPE' AND subregion = 'NATION_3'"""),
)
def fixed_market_filter(t):
    return fl.filter_facts(t.facts, SELECTION.fixed_market("EUROPE", "NATION_3")).select(
        "external_id", "region", "subregion", "city"
    )


@query(
    "cascading_facets", "FLT6 FLT24",
    facts_sql("""SELECT DISTINCT city AS city FROM facts WHERE region IN ('ASIA') AND subregion IN ('NATION_2', 'NATION_7')
      AND city IS NOT NULL ORDER BY city"""),
)
def cascading_facets(t):
    return fl.facet_options(t.facts, "city", within={"region": ("ASIA",), "subregion": ("NATION_2", "NATION_7")})


@query("facet_options", "FLT24", facts_sql("SELECT DISTINCT subregion FROM facts WHERE subregion IS NOT NULL ORDER BY 1"))
def facet_options(t):
    return fl.facet_options(t.facts, "subregion")


@query("valid_lead_rows", "FLT7", facts_sql("SELECT external_id, lead_time_days FROM facts WHERE lead_time_days >= 0"))
def valid_lead_rows(t):
    return fl.valid_lead(t.facts).select("external_id", "lead_time_days")


@query(
    "observed_only_rows", "FLT8",
    facts_sql("SELECT external_id, first_seen_context FROM facts WHERE first_seen_context IS DISTINCT FROM 'baseline'"),
)
def observed_only_rows(t):
    return fl.without_baseline(t.facts).select("external_id", "first_seen_context")


OVERVIEW_SQL = """count(*) AS listings, round(avg(duration_days), 6) AS avg_duration_days,
  CAST(quantile_cont(duration_days, 0.5) AS DOUBLE) AS median_duration_days,
  round(avg(lead_time_days) FILTER (WHERE lead_time_days >= 0), 6) AS avg_lead_time_days,
  CAST(quantile_cont(lead_time_days, 0.5) FILTER (WHERE lead_time_days >= 0) AS DOUBLE) AS median_lead_time_days"""


@query("overview_card", "AGG1 ANA1", facts_sql(f"SELECT {OVERVIEW_SQL} FROM facts"))
def overview_card(t):
    return (rk.overview(t.facts))


@query(
    "overview_texts", "S13",
    facts_sql("""SELECT region, CASE WHEN a IS NULL THEN '-' ELSE concat(CAST(round_even(a, 0) AS BIGINT), ' days') END AS avg_duration_days_text,
      CASE WHEN m IS NULL THEN '-' ELSE concat(CAST(round_even(m, 0) AS BIGINT), ' days') END AS median_duration_days_text
      FROM (SELECT region, avg(duration_days) AS a, CAST(quantile_cont(duration_days, 0.5) AS DOUBLE) AS m FROM facts GROUP BY region)"""),
)
def overview_texts(t):
    per_region = t.facts.groupBy("region").agg(
        F.avg("duration_days").alias("avg_duration_days"), F.percentile("duration_days", 0.5).alias("median_duration_days")
    )
    texts = fa.metric_texts(per_region, ["avg_duration_days", "median_duration_days"])
    return texts.select("region", "avg_duration_days_text", "median_duration_days_text")


@query(
    "region_ranking", "AGG2 SRT1 ANA1",
    facts_sql("""SELECT region, count(DISTINCT external_id) AS listings FROM facts WHERE region IS NOT NULL
      GROUP BY region ORDER BY listings DESC, region LIMIT 12"""),
)
def region_ranking(t):
    return rk.count_by(t.facts, "region", limit=12)


@query(
    "pet_label_ranking", "AGG2 ANA1",
    facts_sql("""SELECT pet_label, count(DISTINCT external_id) AS listings FROM facts WHERE pet_label IS NOT NULL
      GROUP BY pet_label ORDER BY listings DESC, pet_label LIMIT 10"""),
)
def pet_label_ranking(t):
    return rk.count_by(t.facts, "pet_label", limit=10)


def seasonality_sql(interval: str, basis: str) -> str:
    low, high = ("start_date", "end_date") if basis == "sit_dates" else ("CAST(first_seen_at AS DATE)",) * 2
    step = "INTERVAL 7 DAY" if interval == "week" else "INTERVAL 1 MONTH"
    return f"""SELECT CAST(p AS DATE) AS period_start, CAST(year(p) AS INTEGER) AS year, CAST(month(p) AS INTEGER) AS month,
      CAST(week(p) AS INTEGER) AS week, count(DISTINCT external_id) AS listing_count,
      round(avg(duration_days), 6) AS avg_duration_days, round(avg(lead_time_days), 6) AS avg_lead_time_days
      FROM (SELECT external_id, duration_days, lead_time_days,
        unnest(generate_series(date_trunc('{interval}', {low})::TIMESTAMP, date_trunc('{interval}', {high})::TIMESTAMP, {step})) AS p
        FROM facts WHERE {high} >= {low}) GROUP BY p"""


for _interval in ("week", "month"):
    for _basis in ("sit_dates", "first_seen"):
        query(
            f"seasonality_{_interval}_{_basis}", "AGG3 ANA2 SRT3 S5 S6 S7 S8",
            facts_sql(seasonality_sql(_interval, _basis) + " ORDER BY 1"),
            dates="period_start",
        )(
            lambda t, interval=_interval, basis=_basis: (
                se.seasonality(t.facts, basis=basis, interval=interval).orderBy("period_start")
            )
        )


def heatmap_sql(interval: str, count: int, metric: str, aggregate: str) -> str:
    cast = "::BIGINT" if aggregate == "sum" else ""
    cells = ", ".join(
        f"coalesce({aggregate}({metric}) FILTER (WHERE {interval} = {i}), 0){cast} AS {interval[0]}{i:02d}"
        for i in range(1, count + 1)
    )
    return facts_sql(f"SELECT year, {cells} FROM ({seasonality_sql(interval, 'sit_dates')}) GROUP BY year")


@query("heatmap_month_counts", "AGG4 ANA2", heatmap_sql("month", 12, "CAST(listing_count AS BIGINT)", "sum"))
def heatmap_month_counts(t):
    return se.heatmap(se.seasonality(t.facts, interval="month"), interval="month")


@query("heatmap_week_durations", "AGG4 ANA2", heatmap_sql("week", 53, "avg_duration_days", "avg").replace("coalesce(avg", "round(coalesce(avg").replace(", 0) AS", ", 0), 3) AS"))
def heatmap_week_durations(t):
    grid = se.heatmap(se.seasonality(t.facts, interval="week"), metric="avg_duration_days", interval="week")
    return grid.select("year", *[F.round(c, 3).alias(c) for c in grid.columns if c != "year"])


LEAD_SQL = "lead_time_days >= 0 AND first_seen_context IS DISTINCT FROM 'baseline'"


@query(
    "lead_statistics", "AGG5 ANA3",
    facts_sql(f"""SELECT round(avg(lead_time_days), 6) AS mean, CAST(quantile_cont(lead_time_days, 0.25) AS DOUBLE) AS p25,
      CAST(quantile_cont(lead_time_days, 0.5) AS DOUBLE) AS median, CAST(quantile_cont(lead_time_days, 0.75) AS DOUBLE) AS p75
      FROM facts WHERE {LEAD_SQL}"""),
)
def lead_statistics(t):
    return (rk.lead_statistics(rk.lead_rows(t.facts)))


@query(
    "lead_histogram", "AGG6 ANA3",
    facts_sql(f"""SELECT bin, round(lo + (bin - 1) * (hi - lo) / 35, 6) AS bin_from, round(lo + bin * (hi - lo) / 35, 6) AS bin_to,
      count(*) AS listings FROM (SELECT lo, hi, CAST(least(floor((lead_time_days - lo) * 35 / (hi - lo)) + 1, 35) AS INTEGER) AS bin
        FROM (SELECT lead_time_days, min(lead_time_days) OVER () AS lo, max(lead_time_days) OVER () AS hi FROM facts WHERE {LEAD_SQL}))
      GROUP BY bin, lo, hi"""),
)
def lead_histogram(t):
    return (rk.lead_histogram(rk.lead_rows(t.facts)))


@query(
    "lead_boxes", "AGG7 ANA3",
    facts_sql(f"""SELECT duration_bucket, count(*) AS listings, CAST(min(lead_time_days) AS DOUBLE) AS low,
      CAST(quantile_cont(lead_time_days, 0.25) AS DOUBLE) AS p25, CAST(quantile_cont(lead_time_days, 0.5) AS DOUBLE) AS median,
      CAST(quantile_cont(lead_time_days, 0.75) AS DOUBLE) AS p75, CAST(max(lead_time_days) AS DOUBLE) AS high
      FROM facts WHERE {LEAD_SQL} GROUP BY duration_bucket"""),
)
def lead_boxes(t):
    return rk.lead_boxes(rk.lead_rows(t.facts))


@query(
    "location_pet_mix", "AGG8 JN2 ANA4 FLT6",
    facts_sql("""SELECT subregion, pet_label, count(DISTINCT external_id) AS listings FROM facts WHERE region = 'ASIA'
      AND subregion IN (SELECT subregion FROM facts WHERE region = 'ASIA' GROUP BY 1 ORDER BY count(DISTINCT external_id) DESC, 1 LIMIT 3)
      GROUP BY 1, 2 ORDER BY listings DESC, subregion, pet_label"""),
)
def location_pet_mix(t):
    return rk.pet_mix(fl.focus_location(t.facts, region="ASIA"), "subregion", limit=3)


@query(
    "market_card", "AGG9 ANA5 FLT5",
    facts_sql("""SELECT count(*) AS listings, CAST(sum(CASE WHEN has_long_sit THEN 1 ELSE 0 END) AS BIGINT) AS long_sits,
      round(avg(duration_days), 6) AS avg_duration_days,
      CAST(quantile_cont(lead_time_days, 0.5) FILTER (WHERE lead_time_days >= 0) AS DOUBLE) AS median_lead_time_days
      FROM facts WHERE region = 'ASIA' AND subregion = 'NATION_2'"""),
)
def market_card(t):
    market = fl.filter_facts(t.facts, fl.FactFilter().fixed_market("ASIA", "NATION_2"))
    return (rk.market_card(market))


@query(
    "rows_by_region", "AGG10 ANA8",
    with_views("places", "listings", body="SELECT region, count(*) AS listings FROM listings GROUP BY region ORDER BY 2 DESC, 1"),
)
def rows_by_region(t):
    return rk.rows_by_region(t.listings)


@query(
    "rows_by_start_month", "AGG11 ANA8",
    with_views(
        "places", "listings",
        body="SELECT CAST(month(start_date) AS INTEGER) AS month, count(*) AS listings FROM listings GROUP BY 1 ORDER BY 1",
    ),
)
def rows_by_start_month(t):
    return rk.rows_by_start_month(t.listings)


@query(
    "date_bounds", "AGG12",
    facts_sql("""SELECT min(start_date) AS min_start_date, max(start_date) AS max_start_date,
      CAST(min(first_seen_at) AS DATE) AS min_first_seen, CAST(max(first_seen_at) AS DATE) AS max_first_seen FROM facts"""),
    dates="min_start_date max_start_date min_first_seen max_first_seen",
)
def date_bounds(t):
    return rk.date_bounds(t.facts)


def timeline_sql(where: str = "true") -> str:
    return f"""WITH weeks AS (SELECT CAST(p AS DATE) AS period_start, count(DISTINCT external_id) AS n FROM (
        SELECT external_id, unnest(generate_series(date_trunc('week', start_date)::TIMESTAMP, date_trunc('week', end_date)::TIMESTAMP, INTERVAL 7 DAY)) AS p
        FROM facts WHERE end_date >= start_date AND {where}) GROUP BY 1)
      SELECT CAST(s.p AS DATE) AS period_start, CAST(coalesce(w.n, 0) AS BIGINT) AS listing_count
      FROM (SELECT unnest(generate_series(min(period_start)::TIMESTAMP, max(period_start)::TIMESTAMP, INTERVAL 7 DAY)) AS p FROM weeks) s
      LEFT JOIN weeks w ON w.period_start = CAST(s.p AS DATE)"""


@query("weekly_timeline", "ANA6 JN1", facts_sql(f"SELECT * FROM ({timeline_sql()}) ORDER BY 1"),
    dates="period_start",
)
def weekly_timeline(t):
    return se.weekly_timeline(t.facts).orderBy("period_start")


SPARSE = "region = 'ASIA' AND subregion = 'NATION_2' AND city = 'BUILDING' AND house_type = '1-URGENT' AND lead_time_days BETWEEN 0 AND 90"


@query("sparse_weekly_timeline", "ANA6 JN1", facts_sql(f"SELECT * FROM ({timeline_sql(SPARSE)}) ORDER BY 1"),
    dates="period_start",
)
def sparse_weekly_timeline(t):
    return se.weekly_timeline(t.facts.where(SPARSE)).orderBy("period_start")


@query(
    "latest_year_timeline", "WIN3 WIN8 S22 ANA5 ANA6",
    facts_sql(f"""SELECT period_start, listing_count,
      coalesce(month(period_start) <> lag(month(period_start)) OVER (ORDER BY period_start), false) AS month_boundary,
      strftime(period_start, '%d/%m') AS week_label, strftime(period_start, '%d %b %Y') AS week_title,
      min(listing_count) OVER () AS quiet, max(listing_count) OVER () AS busy
      FROM (SELECT *, max(year(period_start)) OVER () AS y FROM ({timeline_sql("region = 'ASIA' AND subregion = 'NATION_2'")}))
      WHERE year(period_start) = y"""),
    dates="period_start",
)
def latest_year_timeline(t):
    from listing_lifecycle_spark.plans.dashboard import market_timeline

    return market_timeline(t.facts, region="ASIA", subregion="NATION_2")


@query(
    "market_monthly_trend", "ANA5 AGG3",
    facts_sql(f"""SELECT period_start, listing_count FROM ({seasonality_sql('month', 'sit_dates')
      .replace('FROM facts WHERE', "FROM facts WHERE region = 'ASIA' AND subregion = 'NATION_2' AND")}) ORDER BY 1"""),
    dates="period_start",
)
def market_monthly_trend(t):
    market = fl.filter_facts(t.facts, fl.FactFilter().fixed_market("ASIA", "NATION_2"))
    return se.seasonality(market, interval="month").select("period_start", "listing_count").orderBy("period_start")


@query(
    "sample_rows", "SRT2 ANA8",
    with_views("places", "listings", body="SELECT external_id, region, city, start_date FROM listings ORDER BY external_id, start_date, region, city LIMIT 10"),
    dates="start_date",
)
def sample_rows(t):
    rows = t.listings.select("external_id", "region", "city", "start_date")
    return rows.orderBy("external_id", "start_date", "region", "city").limit(10)


@query(
    "period_labels", "S5 S6 S8 S9 S10 S20 S22",
    facts_sql("""SELECT external_id, CAST(date_trunc('week', start_date) AS DATE) AS week_start,
      CAST(date_trunc('month', start_date) AS DATE) AS month_start, CAST(week(start_date) AS INTEGER) AS iso_week,
      strftime(start_date, '%-d %b %Y') AS date_text, strftime(start_date, '%Y-%m-%d') AS iso_date,
      CASE WHEN d IS NULL THEN 'Not stated' WHEN d = 7 THEN '1 week' WHEN d % 7 = 0 THEN concat(d // 7, ' weeks')
           WHEN d = 1 THEN '1 day' ELSE concat(d, ' days') END AS duration_text
      FROM (SELECT *, CASE WHEN has_cats THEN duration_days END AS d FROM facts)"""),
    dates="week_start month_start",
)
def period_labels(t):
    start = F.col("start_date")
    return t.facts.select(
        "external_id",
        calendar.week_start(start).alias("week_start"),
        calendar.month_start(start).alias("month_start"),
        calendar.period_parts(start)["week"].alias("iso_week"),
        text.date_text(start).alias("date_text"),
        start.cast("string").alias("iso_date"),
        text.duration_text(F.when(F.col("has_cats"), F.col("duration_days"))).alias("duration_text"),
    )


# Orders as listings in three runs: the second changes some and adds some, the third again.
SQL["run_listings"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS external_id, start_date, CASE WHEN third AND o_orderkey % 5 = 0 THEN start_date + 3 ELSE end_date END AS end_date,
  duration_days, CASE WHEN third AND o_orderkey % 5 = 0 THEN NULL ELSE lead_time_days END AS lead_time_days FROM (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) + CASE WHEN second THEN 30 ELSE 0 END AS start_date,
    CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_orderdate AS DATE) + CASE WHEN second THEN 30 ELSE 0 END + CAST(o_orderkey % 40 AS INTEGER) END AS end_date,
    CAST(o_orderkey % 40 AS INTEGER) + CASE WHEN second THEN 1 ELSE 0 END AS duration_days, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderkey % 13 AS INTEGER) END AS lead_time_days, third
  FROM (SELECT *, o_orderkey % 3 = 0 AND o_orderstatus <> 'O' AS second, o_orderstatus <> 'O' OR o_orderkey % 2 = 0 AS third FROM orders))"""


@query(
    "seasonality_by_runs", "AGG3 JN1 ANA6 SET2",
    with_views("run_listings", body="""SELECT period_start, CAST(year(period_start) AS INTEGER) AS year, CAST(month(period_start) AS INTEGER) AS month, CAST(week(period_start) AS INTEGER) AS week,
      count(*) AS listing_count, round(avg(duration_days), 6) AS avg_duration_days, round(avg(lead_time_days), 6) AS avg_lead_time_days
      FROM (SELECT *, CAST(unnest(generate_series(date_trunc('week', start_date), date_trunc('week', end_date), INTERVAL 7 DAY)) AS DATE) AS period_start FROM run_listings WHERE end_date >= start_date)
      GROUP BY period_start"""),
    dates="period_start",
)
def seasonality_by_runs(t):
    """Weekly totals that three runs bring up to date, each from the rows it has changed, not from all."""
    key, start = F.col("o_orderkey"), F.to_date("o_orderdate")
    days = (key % 40).cast("int")
    first = t.table("orders").select(
        key, F.col("o_orderstatus").alias("kind"), start.alias("start_date"), F.when(F.col("o_orderpriority") != "5-LOW", F.date_add(start, days)).alias("end_date"),
        days.alias("duration_days"), F.when(key % 7 > 0, (key % 13).cast("int")).alias("lead_time_days"),
    )
    shifted = {"start_date": F.date_add("start_date", 30), "end_date": F.date_add("end_date", 30), "duration_days": F.col("duration_days") + 1}
    old, moved = F.col("kind") != "O", F.col("o_orderkey") % 3 == 0
    before_second = first.where(old & moved)
    after_second = before_second.withColumns(shifted).unionByName(first.where(~old & (F.col("o_orderkey") % 2 == 0)))
    second = first.where(old & ~moved).unionByName(after_second)
    third = F.col("o_orderkey") % 5 == 0
    before_third = second.where(third)
    after_third = before_third.withColumns({"end_date": F.date_add("start_date", 3), "lead_time_days": F.lit(None).cast("int")})
    late = first.where(~old & (F.col("o_orderkey") % 2 == 1))
    none = first.limit(0)
    totals = None
    for before, after in ((none, first.where(old)), (before_second, after_second), (before_third, after_third.unionByName(late))):
        changes = se.period_changes(before, after, interval="week")
        totals = changes if totals is None else se.apply_changes(totals, changes)
    return se.profile_of(totals)
