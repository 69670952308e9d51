import pytest
from pyspark.sql import functions as F

from helpers import listing, listings, moment, state
from listing_lifecycle_spark import fixed_values as fv
from listing_lifecycle_spark.operators import quality as qu
from listing_lifecycle_spark.plans import health as he

NOW = "2026-05-02 10:00:00"
RUNS = "id long, scope_name string, status string, started_at timestamp_ntz, finished_at timestamp_ntz, new_listings int, changed_listings int"
SCOPES = "name string, enabled boolean, interval_minutes int, last_success_at timestamp_ntz"


def runs(spark, rows):
    return spark.createDataFrame([(i, s, st, moment(a), moment(b) if b else None, n, c) for i, (s, st, a, b, n, c) in enumerate(rows)], RUNS)


def scopes(spark, rows):
    return spark.createDataFrame([(n, e, m, moment(s) if s else None) for n, e, m, s in rows], SCOPES)


def test_report_lines(spark):
    log = runs(spark, [
        ("central", "success", "2026-05-01T12:00:00", "2026-05-01T12:05:00", 3, 4), ("central", "success", "2026-05-02T09:00:00", "2026-05-02T09:05:00", 1, None),
        ("region", "success", "2026-05-01T09:50:00", "2026-05-01T10:05:00", 0, 5), ("region", "success", "2026-05-01T09:00:00", "2026-05-01T09:59:00", 9, 9),
        ("region", "suspicious", "2026-05-01T10:00:00", None, 0, 0), ("region", "failed", "2026-05-01T09:59:59", None, 0, 0),
        ("region", "running", "2026-05-02T09:59:59", None, 0, 0),
    ])
    fresh = scopes(spark, [("central", True, 5, "2026-05-02T09:59:00"), ("region", True, 60, "2026-05-02T09:02:00"), ("off", False, 5, None)])
    assert [r.line for r in he.health_lines(log, fresh, now=NOW).collect()] == [
        "-- Health check -- OK", "- central: 2", "- region: 1", "Total: 3 scans, 4 new, 9 changed", "Failed scan attempts: 1",
        "Stalest coverage: 58m (region, interval 60m)",
    ]


def test_no_success_is_critical(spark):
    none = runs(spark, [])
    lines = [r.line for r in he.health_lines(none, scopes(spark, []), now=NOW).collect()]
    assert lines == ["-- Health check -- CRITICAL", "Scans: none", "Total: 0 scans, 0 new, 0 changed", "Failed scan attempts: 0", "Stalest coverage: no enabled scopes"]


@pytest.mark.parametrize("success,status", [("2026-05-02T08:00:00", "FLAWLESS"), ("2026-05-02T07:59:59", "CRITICAL"), (None, "CRITICAL")])
def test_twice_the_interval(spark, success, status):
    log = runs(spark, [("region", "success", "2026-05-02T08:00:00", "2026-05-02T08:05:00", 0, 0)])
    assert he.health_summary(log, scopes(spark, [("region", True, 60, success)]), now=NOW).first().status == status


def test_bands(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 4, 5, 19, 20, 206)], "n long")
    assert [r[0] for r in df.select(he.status_band(F.col("n"))).collect()] == ["FLAWLESS", "OK", "OK", "WARN", "WARN", "CRITICAL", "CRITICAL"]


def test_stalest_ties_and_never(spark):
    rows = [("b", True, 10, "2026-05-02T09:50:00"), ("a", True, 5, "2026-05-02T09:55:00"), ("c", True, 60, "2026-05-02T09:59:00")]
    assert he.stalest_scope(scopes(spark, rows), now=NOW).first().name == "a"
    assert he.stalest_scope(scopes(spark, [*rows, ("z", True, 60, None)]), now=NOW).first().name == "z"


def test_age_texts(spark):
    ages = {"89m": 89 * 60 + 10, "2h": 90 * 60, "48h": 48 * 3600 - 1, "2d": 48 * 3600}
    df = spark.createDataFrame([(t, s) for t, s in ages.items()], "t string, s long")
    from listing_lifecycle_spark.functions.text import age_text

    assert all(r[0] == r[1] for r in df.select("t", age_text(F.col("s"))).collect())


def test_violations(spark):
    stored = state(spark, [
        dict(external_id="good", end_date=None), dict(external_id="bad", dogs_count=-1, status="lost", island="West", missing_count=-1, appearance_sequence=0,
                                                      reply_rating_score=11, first_seen_context="other"),
    ])
    found = qu.violations(stored, qu.listing_rules(stored.columns), ["external_id"])
    assert {(r.external_id, r.rule) for r in found.collect()} == {("bad", r) for r in (
        "dogs_count_not_negative", "missing_count_not_negative", "status_known", "island_known", "reply_rating_range", "context_known", "appearance_positive")}
    counts = {r.rule: r.violations for r in qu.violation_counts(stored, qu.listing_rules(stored.columns)).collect()}
    assert counts["status_known"] == 1 and counts["url_present"] == 0


def test_keys_references_and_contract(spark):
    sent = spark.createDataFrame([("e", "sms", "sent"), ("e", "sms", "failed"), ("e", "sms", "sent"), ("e", "web", "failed"), ("e", "web", "failed")],
                                 "event_id string, channel string, status string")
    double = qu.duplicate_keys(sent, ["event_id", "channel"], F.col("status") == "sent").collect()
    assert [(r.channel, r.occurrences) for r in double] == [("sms", 2)]
    parent = spark.createDataFrame([("e",)], "id string")
    child = spark.createDataFrame([("e",), ("x",), (None,)], "event_id string")
    assert [r.event_id for r in qu.orphans(child, parent, "event_id", "id").collect()] == ["x"]
    rows = listings(spark, [listing()])
    assert qu.schema_differences(rows, fv.LISTING_SCHEMA) == []
    odd = rows.drop("url").withColumn("raw_html", F.lit("x")).withColumn("no_pets", F.lit(1))
    assert qu.schema_differences(odd, fv.LISTING_SCHEMA) == ["missing: url", "not in contract: raw_html", "type of no_pets: int, expected boolean"]
    assert qu.violations(spark.createDataFrame([(1, 0, 3)], "id int, interval_minutes int, missing_threshold_runs int"), qu.scope_rules(), ["id"]).first().rule == "interval_positive"


def test_checked_write(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, "a"), (2, -1, "b"), (3, None, None), (4, -2, None)], "id int, n int, s string")
    rules = {"n_positive": F.col("n") >= 0, "s_present": F.col("s").isNotNull()}
    done = qu.check_and_write(rows, rules, str(tmp_path / "out"), contract={"id": "int", "n": "int", "s": "string"})
    assert (done.rows, done.violations) == (4, {"n_positive": 2, "s_present": 2})
    assert sorted(r.id for r in done.kept(spark).collect()) == [1] and done.kept(spark).columns == ["id", "n", "s"]
    assert sorted((r.id, tuple(r.broken_rules)) for r in done.broken(spark).collect()) == [(2, ("n_positive",)), (3, ("s_present",)), (4, ("n_positive", "s_present"))]
    clean = qu.check_and_write(rows.where("id = 1"), rules, str(tmp_path / "clean"))
    assert clean.violations == {"n_positive": 0, "s_present": 0} and clean.broken(spark).count() == 0 and clean.kept(spark).count() == 1
    empty = qu.check_and_write(rows.limit(0), rules, str(tmp_path / "empty"))
    assert (empty.rows, empty.kept(spark).count(), empty.broken(spark).count()) == (0, 0, 0)
    with pytest.raises(ValueError, match="missing: x"):
        qu.check_and_write(rows, rules, str(tmp_path / "refused"), contract={"id": "int", "n": "int", "s": "string", "x": "int"})
    assert not (tmp_path / "refused").exists()
