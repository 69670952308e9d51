import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from listing_lifecycle_spark import fixed_values as fv
from listing_lifecycle_spark.functions.calendar import periods_between
from listing_lifecycle_spark.operators import facts as fa
from listing_lifecycle_spark.operators import filters as fl
from listing_lifecycle_spark.operators import ranking as rk
from listing_lifecycle_spark.operators import seasonality as se
from listing_lifecycle_spark.plans import dashboard

COLUMNS = ["external_id", "region", "subregion", "city", "start_date", "end_date", "duration_days", *fv.PET_COUNT_COLUMNS,
           "no_pets", "first_seen_at", "first_seen_context", "status", "url"]
DDL = ", ".join(
    f"{c} " + ("int" if c.endswith("_count") or c == "duration_days" else "boolean" if c == "no_pets" else "string") for c in COLUMNS
)


def row(external_id, region, subregion, city, start, end, days, seen, context="observed", status="active", **counts):
    pets = [counts.get(c, 0) for c in fv.PET_COUNT_COLUMNS]
    return (external_id, region, subregion, city, start, end, days, *pets, counts.get("no_pets", False), seen, context, status, "u")


ONE = row("one", "Auckland", "Auckland - Central", "Auckland CBD", "2026-01-05", "2026-01-18", 14, "2025-12-05 10:00:00", dogs_count=1)
TWO = row("two", "Wellington", "Wellington", "Island Bay", "2026-02-01", "2026-02-20", 20, "2026-01-08 10:00:00", cats_count=1)


@pytest.fixture(scope="module")
def facts(spark):
    return fa.listing_facts(spark.createDataFrame([ONE, TWO], DDL)).cache()


def test_derived_columns(facts):
    got = [(r.duration_bucket, r.lead_time_days, r.pet_label, r.has_dogs, r.has_long_sit) for r in facts.orderBy("external_id").collect()]
    assert got == [("8-14 days", 31, "Dogs", True, False), ("15-30 days", 24, "Cats", False, False)]


def test_bad_dates_and_missing_duration(spark):
    rows = [
        row("a", None, None, None, "2026-01-05", "2026-01-18", None, "nonsense"),
        row("b", None, None, None, "not a day", "2026-01-18", None, "2026-01-01"),
    ]
    got = {r.external_id: r for r in fa.listing_facts(spark.createDataFrame(rows, DDL)).collect()}
    assert got["a"].duration_days == 14 and got["a"].lead_time_days is None
    assert got["b"].start_date is None and got["b"].duration_bucket is None and got["b"].has_long_sit is False


@pytest.mark.parametrize(
    "days,label",
    [(7, "0-7 days"), (8, "8-14 days"), (30, "15-30 days"), (31, "31-60 days"), (61, "61+ days"), (0, "0-7 days"), (-3, "0-7 days"), (None, None)],
)
def test_duration_buckets(spark, days, label):
    assert spark.range(1).select(fa.duration_bucket(F.lit(days).cast("int"))).first()[0] == label


def test_pet_labels(spark):
    cases = {
        "No pets": dict(no_pets=True, dogs_count=1), "Dogs and cats": dict(dogs_count=1, cats_count=1, fish_count=2),
        "Mixed pets": dict(cats_count=1, horses_count=1), "Dogs": dict(dogs_count=3), "Cats": dict(cats_count=1), "Other": {},
    }
    rows = [row(label, None, None, None, None, None, None, None, **counts) for label, counts in cases.items()]
    rows.append(row("birds", None, None, None, None, None, None, None, birds_count=1))
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, DDL).select("external_id", fa.pet_label()).collect()}
    assert got == {**{label: label for label in cases}, "birds": "Other"}


def test_filters(facts):
    ids = lambda selection: [r[0] for r in fl.filter_facts(facts, selection).orderBy("external_id").select("external_id").collect()]
    assert ids(fl.FactFilter()) == ["one", "two"]
    assert ids(fl.FactFilter(sit_from="2026-01-05", sit_to="2026-01-05")) == ["one"]
    assert ids(fl.FactFilter(posted_from="2026-01-08", posted_to="2026-01-08")) == ["two"]
    assert ids(fl.FactFilter(regions=("Auckland",), pet_labels=("Cats",))) == []
    assert ids(fl.FactFilter(cities=("Island Bay",)).fixed_market("Auckland", "Auckland - Central")) == ["one"]


def test_baseline_context_null_is_kept(spark):
    rows = [row("a", *[None] * 6, "2026-01-01", context=c) for c in ("baseline",)] + [row("b", *[None] * 6, "2026-01-01", context=None)]
    assert [r.external_id for r in fl.without_baseline(spark.createDataFrame(rows, DDL)).collect()] == ["b"]


def test_weeks_of_one_stay(facts):
    weeks = se.seasonality(facts.where("external_id = 'one'"), interval="week").orderBy("period_start").collect()
    assert [(r.week, r.listing_count) for r in weeks] == [(2, 1), (3, 1)]


def test_timeline_has_empty_weeks(spark):
    later = row("two", "Wellington", "Wellington", "Island Bay", "2026-01-26", "2026-01-26", 1, "2026-01-08")
    timeline = se.weekly_timeline(fa.listing_facts(spark.createDataFrame([ONE, later], DDL))).orderBy("period_start").collect()
    assert [(str(r.period_start), r.listing_count) for r in timeline] == [
        ("2026-01-05", 1), ("2026-01-12", 1), ("2026-01-19", 0), ("2026-01-26", 1)
    ]
    assert se.weekly_timeline(fa.listing_facts(spark.createDataFrame([], DDL))).count() == 0


def month_or_week(day, interval):
    return day.replace(day=1) if interval == "month" else day - timedelta(days=day.weekday())


@pytest.mark.parametrize("interval", ["week", "month"])
def test_seasonality_equals_plain_expansion(spark, interval):
    """Repeated ids, nested and touching stays, reversed dates, one id with a third of the rows."""
    rng = random.Random(5)
    rows = []
    for i in range(600):
        start = date(2025, 1, 1) + timedelta(days=rng.randrange(500))
        end = start + timedelta(days=rng.randrange(-5, 90))
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(120)}"
        days = None if i % 11 == 0 else rng.randrange(1, 60)
        rows.append(row(key, "R", "S", "C", str(start), str(end), days, str(start - timedelta(days=rng.randrange(-9, 50)))))
    facts = fa.listing_facts(spark.createDataFrame(rows, DDL))
    ids, durations, leads = defaultdict(set), defaultdict(list), defaultdict(list)
    for r in facts.collect():
        if r.end_date < r.start_date:
            continue
        touched = {month_or_week(r.start_date + timedelta(days=n), interval) for n in range((r.end_date - r.start_date).days + 1)}
        for period in touched:
            ids[period].add(r.external_id)
            durations[period].append(r.duration_days)
            leads[period].append(r.lead_time_days)
    got = {r.period_start: r for r in se.seasonality(facts, interval=interval).collect()}
    assert set(got) == set(ids)
    for period, r in got.items():
        assert r.listing_count == len(ids[period])
        assert r.avg_duration_days == pytest.approx(sum(durations[period]) / len(durations[period]))
        assert r.avg_lead_time_days == pytest.approx(sum(leads[period]) / len(leads[period]))


def test_iso_week_beside_calendar_year(spark):
    facts = fa.listing_facts(spark.createDataFrame([row("a", *[None] * 3, "2024-12-30", "2024-12-31", 2, "2024-12-01")], DDL))
    r = se.seasonality(facts, interval="week").first()
    assert (r.year, r.month, r.week) == (2024, 12, 1)


def test_period_lists(spark):
    day = lambda text: F.lit(text).cast("date")
    got = spark.range(1).select(
        periods_between(day("2026-01-31"), day("2026-03-01"), "month").alias("m"),
        periods_between(day("2026-03-01"), day("2026-01-31"), "month").alias("reversed"),
        periods_between(F.lit(None).cast("date"), day("2026-01-31"), "week").alias("missing"),
        periods_between(day("1969-12-28"), day("1970-01-05"), "week").alias("w"),
    ).first()
    assert [str(d) for d in got.m] == ["2026-01-01", "2026-02-01", "2026-03-01"]
    assert got.reversed == [] and got.missing == []
    assert [str(d) for d in got.w] == ["1969-12-22", "1969-12-29", "1970-01-05"]


def test_lead_statistics_are_linear(spark):
    rows = [row(str(n), *[None] * 3, "2026-02-01", "2026-02-02", 2, str(date(2026, 2, 1) - timedelta(days=n))) for n in (1, 2, 3, 10)]
    rows.append(row("late", *[None] * 3, "2026-02-01", "2026-02-02", 2, "2026-02-05"))
    rows.append(row("base", *[None] * 3, "2026-02-01", "2026-02-02", 2, "2026-01-01", context="baseline"))
    facts = fa.listing_facts(spark.createDataFrame(rows, DDL))
    report = dashboard.lead_report(facts)
    r = report["statistics"].first()
    assert (r.mean, r.p25, r.median, r.p75) == (4.0, 1.75, 2.5, 4.75)
    bins = {b.bin: b.listings for b in report["histogram"].collect()}
    assert bins == {1: 1, 4: 1, 8: 1, 35: 1}
    assert rk.lead_rows(facts, include_baseline=True).count() == 5


def test_rankings(spark):
    rows = [row(i, r, None, None, "2026-02-01", "2026-02-02", 2, "2026-01-01") for i, r in
            [("a", "X"), ("a", "X"), ("b", "X"), ("c", "Y"), ("d", None), ("e", "Z")]]
    facts = fa.listing_facts(spark.createDataFrame(rows, DDL))
    assert [tuple(r) for r in rk.count_by(facts, "region", limit=2).collect()] == [("X", 2), ("Y", 1)]
    assert [tuple(r) for r in rk.rows_by_region(facts).collect()][0] == ("X", 3)
    assert rk.overview(facts).first().listings == 6 and rk.overview(facts, distinct=True).first().listings == 5
    assert {(r.region, r.listings) for r in dashboard.location_report(facts, limit=1)["pets"].collect()} == {("X", 2)}


def test_reports_run(facts):
    assert dashboard.overview_report(facts)["pets"].count() == 2
    grid = dashboard.seasonality_report(facts)["heatmap"].first()
    assert (grid.year, grid.m01, grid.m02, grid.m03) == (2026, 1, 1, 0)
    market = dashboard.market_report(facts, fl.FactFilter(), region="Auckland", subregion="Auckland - Central")
    assert market["card"].first().listings == 1 and market["trend"].count() == 1
    weeks = market["weeks"].orderBy("period_start").collect()
    assert [(w.week_label, w.month_boundary, w.quiet, w.busy) for w in weeks] == [("05/01", False, 1, 1), ("12/01", False, 1, 1)]
    assert dashboard.sanity_report(facts)["months"].count() == 2
    assert dashboard.explorer_report(facts).columns == fv.EXPLORER_COLUMNS
