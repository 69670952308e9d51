import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import batch, by, listing, moment, state
from listing_lifecycle_spark.operators import lifecycle as lc
from listing_lifecycle_spark.operators.facts import persistable
from listing_lifecycle_spark.plans.persist import EVENT_LOG_TYPES, commit_run, complete_campaign, finish_campaign, run_once
from listing_lifecycle_spark.session import cut_lineage
from listing_lifecycle_spark.sources.rules import make_rules
from listing_lifecycle_spark.sources.versions import VersionedTables

NOW, TODAY = "2026-05-02 10:00:00", "2026-05-02"
CENTRAL = lc.RunScope("central", "North Island", "Auckland", "Auckland - Central", missing_threshold=6)


def test_insert_same_changed(spark):
    stored = state(spark, [dict(external_id="same"), dict(external_id="other")])
    rows = [listing("new"), listing("same"), listing("other", content_hash="h2", city="Ponsonby")]
    merged = lc.merge_batch(stored, batch(spark, rows), run_id=5, context="baseline")
    got = by(lc.outcomes(merged))
    assert (got["new"]["created"], got["new"]["changed"], got["new"]["previous_status"]) == (True, False, None)
    assert (got["same"]["created"], got["same"]["changed"]) == (False, False)
    assert got["other"]["changed"] and got["other"]["previous_content_hash"] == "h1"
    assert {r["appearance_sequence"] for r in got.values()} == {1}
    after = by(lc.new_state(merged))
    assert after["new"]["first_seen_context"] == "baseline" and after["other"]["first_seen_context"] == "observed"
    assert after["other"]["city"] == "Ponsonby" and after["other"]["last_seen_run_id"] == 5 and after["other"]["first_seen_run_id"] == 1
    assert lc.counters(merged).first().asDict() == {"listings_seen": 3, "new_listings": 1, "changed_listings": 1, "missing_marked": 0}


def test_records_without_hash_or_url_are_set_aside(spark):
    from helpers import listings

    rows = listings(spark, [listing("a"), listing("b", content_hash=""), listing("c", url=None)])
    good, bad = persistable(rows)
    assert [r.external_id for r in good.collect()] == ["a"]
    assert {r.external_id: r.reject_reason for r in bad.collect()} == {"b": "missing content_hash", "c": "missing url"}


def test_only_covered_listings_go_missing(spark):
    stored = state(spark, [dict(external_id="in"), dict(external_id="out", subregion="Rodney"), dict(external_id="nowhere", subregion=None)])
    merged = lc.apply_run(stored, batch(spark, [listing("seen")]), CENTRAL, run_id=2, now=NOW, today=TODAY)
    got = by(lc.new_state(merged))
    assert (got["in"]["status"], got["in"]["missing_count"]) == ("missing_once", 1)
    assert got["in"]["missing_since"] == moment(NOW) and got["in"]["closed_at"] is None
    assert got["out"]["status"] == got["nowhere"]["status"] == "active"
    assert lc.counters(merged).first().missing_marked == 1


def test_first_success_marks_nothing(spark):
    first = lc.RunScope("central", "North Island", "Auckland", succeeded_before=False)
    got = by(lc.apply_run(state(spark, [dict(external_id="in")]), batch(spark, [listing("x")]), first, run_id=2, now=NOW, today=TODAY))
    assert got["in"]["status"] == "active" and got["x"]["first_seen_context"] == "baseline"


@pytest.mark.parametrize("count,status,closed", [(4, "missing_once", None), (5, "missing_confirmed", moment(NOW))])
def test_threshold(spark, count, status, closed):
    stored = state(spark, [dict(external_id="in", status="missing_once", missing_count=count, missing_since=moment("2026-05-01"))])
    got = by(lc.apply_run(stored, batch(spark, [listing("x")]), CENTRAL, run_id=2, now=NOW, today=TODAY))["in"]
    assert (got["status"], got["missing_count"], got["closed_at"]) == (status, count + 1, closed)
    assert got["missing_since"] == moment("2026-05-01")


@pytest.mark.parametrize("before,sequence", [("missing_confirmed", 2), ("missing_once", 1), ("expired_by_date", 1)])
def test_return(spark, before, sequence):
    stored = state(spark, [dict(external_id="one", status=before, missing_count=6, closed_at=moment("2026-05-01"))])
    got = by(lc.merge_batch(stored, batch(spark, [listing("one")]), run_id=2))["one"]
    assert (got["status"], got["appearance_sequence"], got["missing_count"], got["closed_at"]) == ("active", sequence, 0, None)


def test_expiry_and_revival_in_one_run(spark):
    stored = state(spark, [
        dict(external_id="past", end_date=date(2026, 5, 1)), dict(external_id="today", end_date=date(2026, 5, 2)),
        dict(external_id="open", end_date=None), dict(external_id="gone", end_date=date(2026, 4, 1), status="expired_by_date"),
    ])
    seen = batch(spark, [listing(k, end_date=d) for k, d in
                         [("past", date(2026, 5, 1)), ("today", date(2026, 5, 2)), ("open", None), ("gone", date(2026, 4, 1))]])
    got = by(lc.apply_run(stored, seen, CENTRAL, run_id=2, now=NOW, today=TODAY))
    assert {k: r["status"] for k, r in got.items()} == {
        "past": "expired_by_date", "today": "active", "open": "active", "gone": "expired_by_date"
    }
    assert got["gone"]["appearance_sequence"] == 1 and got["gone"]["previous_status"] == "expired_by_date"


def test_stale_observation_changes_nothing(spark):
    stored = state(spark, [dict(external_id="one", last_seen_at=moment("2026-05-03"), city="Newer")])
    merged = lc.apply_run(stored, batch(spark, [listing("one", content_hash="h9")]), CENTRAL, run_id=2, now=NOW, today=TODAY)
    got = by(merged)["one"]
    assert not got["observation_applied"] and not got["changed"] and got["city"] == "Newer" and got["status"] == "active"
    assert lc.counters(merged).first().listings_seen == 1
    equal = state(spark, [dict(external_id="one", last_seen_at=moment(NOW))])
    assert by(lc.merge_batch(equal, batch(spark, [listing("one")]), run_id=2))["one"]["observation_applied"]


def test_empty_run_is_suspicious(spark, locations):
    stored = state(spark, [dict(external_id="in")])
    result = run_once(
        stored, batch(spark, []), CENTRAL, rules=make_rules(spark, [dict(rule_name="any")]), locations=locations,
        event_log=spark.createDataFrame([], EVENT_LOG_TYPES), run_id=3, now=NOW, today=TODAY,
    )
    assert result.status == "suspicious" and result.merged is None and result.run.first().listings_seen == 0


def scopes(spark):
    return spark.createDataFrame(
        [("central", True, {"state": "north-island", "region": "auckland", "subregion": "auckland-central"}, 5, 6, None),
         ("north", True, {"state": "north-island"}, 720, 3, None)],
        "name string, enabled boolean, site_filter map<string,string>, interval_minutes int, missing_threshold_runs int, last_success_at timestamp_ntz",
    )


def test_run_end_to_end(spark, locations, tmp_path):
    tables = VersionedTables(spark, str(tmp_path / "tables"))
    rules = make_rules(spark, [dict(rule_name="central", site_filter={"region": "auckland", "subregion": "auckland-central"}, dogs_allowed=True)])
    empty_log = spark.createDataFrame([], EVENT_LOG_TYPES)

    def run(rows, run_id, now):
        stored = tables.read("state")
        log = tables.read_log("events")
        result = run_once(
            state(spark, []) if stored is None else stored, batch(spark, rows, at=now.replace(" ", "T")), CENTRAL, rules=rules, locations=locations,
            event_log=empty_log if log is None else log, run_id=run_id, now=now, today=now[:10],
        )
        commit_run(tables, result, scopes=scopes(spark) if tables.read("scopes") is None else tables.read("scopes"), batch_key=f"run-{run_id}")
        return result

    run([listing("a", dogs_count=1), listing("b", cats_count=1)], 1, "2026-05-01 10:00:00")
    assert {(r.external_id, r.event_type) for r in tables.read_log("events").collect()} == {("a", "first_match")}
    run([listing("a", dogs_count=1, content_hash="h2", title="Other words")], 2, "2026-05-02 10:00:00")
    assert tables.read_log("events").count() == 1 and by(tables.read("state"))["b"]["missing_count"] == 1
    run([listing("a", dogs_count=1, content_hash="h3", end_date=date(2026, 9, 9))], 3, "2026-05-03 10:00:00")
    assert sorted(r.event_type for r in tables.read_log("events").collect()) == ["first_match", "material_change"]
    run([], 4, "2026-05-04 10:00:00")
    assert by(tables.read("state"))["b"]["missing_count"] == 2
    assert [r.status for r in tables.read_log("runs").orderBy("id").collect()] == ["success"] * 3 + ["suspicious"]
    assert tables.current() == 4 and tables.current("state") == 3 and tables.has_batch("run-2") and not tables.has_batch("run-9")
    assert tables.read("state", version=1).count() == 2


def leaf(spark, rows):
    one = spark.createDataFrame([], "x int").sparkSession
    ddl = ("campaign_id string, leaf_key string, ordinal int, site_filter map<string,string>, status string, pages_fetched int, "
           "listings array<struct<external_id: string, content_hash: string, island: string, region: string, subregion: string, end_date: date>>, "
           "last_attempt_at timestamp_ntz, completed_at timestamp_ntz, error_message string")
    return one.createDataFrame(rows, ddl)


def test_campaign_counts_each_absence_once(spark, locations):
    """South by the broad campaign only; Auckland left to its own scope; a later sighting outweighs a leaf."""
    stored = state(spark, [
        dict(external_id="south", island="South Island", region="Otago", subregion="Dunedin"),
        dict(external_id="later", island="South Island", region="Otago", subregion="Dunedin", last_seen_at=moment("2026-05-09")),
        dict(external_id="auckland"), dict(external_id="north", region="Waikato", subregion="Hamilton"),
        dict(external_id="kept", island="South Island", region="Otago", subregion="Clutha"),
    ])
    at = moment("2026-05-02T09:00:00")
    kept = ("kept", "h2", "South Island", "Otago", "Clutha", None)
    leaves = leaf(spark, [
        ("c", "otago", 0, {"state": "south-island", "region": "otago"}, "success", 2, [kept], at, at, None),
        ("c", "auckland", 1, {"state": "north-island", "region": "auckland"}, "success", 1, [], at, at, None),
        ("c", "waikato", 2, {"state": "north-island", "region": "waikato"}, "success", 1, [], at, at, None),
        ("c", "nelson", 3, {"state": "south-island", "region": "nelson-marlborough"}, "pending", 0, [], at, None, None),
    ])
    merged = finish_campaign(
        stored, leaves, campaign_id="c", threshold=3, locations=locations, excluded_regions=["auckland"],
        allowed_states=["south-island"], succeeded_before=True, run_id=8, now=NOW, today=TODAY,
    )
    got = by(merged)
    assert {k: r["missing_count"] for k, r in got.items()} == {"south": 1, "later": 0, "auckland": 0, "north": 0, "kept": 0}
    assert got["kept"]["changed"] and lc.counters(merged).first().missing_marked == 1


def test_campaign_without_rows_or_with_a_wrong_leaf(spark, locations):
    stored = state(spark, [dict(external_id="a", island="South Island", region="Otago", subregion="Dunedin")])
    at = moment("2026-05-02T09:00:00")
    how = dict(threshold=3, locations=locations, excluded_regions=[], allowed_states=None, succeeded_before=True, run_id=8, now=NOW, today=TODAY)
    rules = make_rules(spark, [dict(rule_name="r", site_filter={"region": "otago"})])
    more = dict(rules=rules, event_log=spark.createDataFrame([], EVENT_LOG_TYPES), started_at=at)
    empty = leaf(spark, [("c", "otago", 0, {"state": "south-island", "region": "otago"}, "success", 2, [], at, at, None)])
    result = complete_campaign(stored, empty, "all", campaign_id="c", **how, **more)
    assert result.status == "suspicious" and result.merged is None and result.events is None
    assert result.run.first().listings_seen == 0
    with pytest.raises(ValueError, match="staged no listing"):
        finish_campaign(stored, empty, campaign_id="c", **how)
    row = ("b", "h2", "South Island", "Otago", "Clutha", None)
    wrong = leaf(spark, [("c", "x", 0, {"state": "south-island", "region": "otago", "subregion": "nowhere"}, "success", 2, [row], at, at, None)])
    with pytest.raises(ValueError, match="unknown subregion"):
        finish_campaign(stored, wrong, campaign_id="c", **how)
    fine = leaf(spark, [("c", "otago", 0, {"state": "south-island", "region": "otago"}, "success", 2, [row], at, at, None)])
    result = complete_campaign(stored, fine, "all", campaign_id="c", **how, **more)
    assert result.status == "success" and {k: r["missing_count"] for k, r in by(result.merged).items()} == {"a": 1, "b": 0}
    assert result.run.first().new_listings == 1


def plain_replay(observations, threshold):
    """The rules of single runs, one after the other, on plain dictionaries."""
    result = {}
    for scope in {o[0] for o in observations}:
        rows = [o for o in observations if o[0] == scope]
        known = {}
        for run in sorted({o[2] for o in rows}):
            seen = {o[1] for o in rows if o[2] == run}
            for key in seen:
                old = known.setdefault(key, {"sequence": 1, "count": 0, "status": "active"})
                if old["status"] == "missing_confirmed":
                    old["sequence"] += 1
                old.update(count=0, status="active")
            for key, old in known.items():
                if key not in seen and old["status"] != "missing_confirmed":
                    old["count"] += 1
                    old["status"] = "missing_confirmed" if old["count"] >= threshold else "missing_once"
        result.update({(scope, k): (v["sequence"], v["count"], v["status"]) for k, v in known.items()})
    return result


@pytest.mark.parametrize("searched", [2_000_000, 3])
def test_replay_equals_run_by_run(spark, monkeypatch, searched):
    monkeypatch.setattr(lc, "SEARCHED", searched)  # beyond it, a join
    rng = random.Random(3)
    rows = [
        (s, f"{s}-{k}", date(2026, 1, 1) + timedelta(days=d))
        for s in ("x", "y") for k in range(25) for d in range(30) if rng.random() < (0.9 if k == 0 else 0.25)
    ]
    observations = spark.createDataFrame(rows, "scope_name string, external_id string, run_day date")
    got = {(r.scope_name, r.external_id): (r.appearance_sequence, r.missing_count, r.status)
           for r in lc.replay(observations, threshold=3).collect()}
    assert got == plain_replay(rows, 3)


def test_replay_by_numbers_and_instants(spark):
    """Runs may be days, numbers or instants; a hot run, repeated sightings and a scope without a name change nothing."""
    rows = [(s, f"k{k}", d) for s in ("x", None) for k in range(12) for d in range(9) if (k * d) % 4 < 2 or d == 5] * 2
    numbers = spark.createDataFrame(rows, "scope_name string, external_id string, run int")
    days = numbers.withColumn("run", F.date_add(F.lit("2026-01-01").cast("date"), F.col("run")))
    instants = numbers.withColumn("run", F.lit("2026-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("run")))
    want = {(r.scope_name, r.external_id): tuple(r)[4:] for r in lc._replay_by_join(numbers.where("scope_name IS NOT NULL"), 2, "run").collect()}
    for table in (numbers, days, instants):
        got = {(r.scope_name, r.external_id): tuple(r)[4:] for r in lc.replay(table, threshold=2, run="run").collect()}
        assert {k: v for k, v in got.items() if k[0]} == want and {k[1]: v for k, v in got.items() if not k[0]} == {k[1]: v for k, v in want.items()}
    assert lc.replay(numbers.limit(0), threshold=2, run="run").collect() == []


def test_replay_equals_merging_runs(spark):
    rng = random.Random(9)
    days = [date(2026, 1, d) for d in range(1, 8)]
    rows = [("x", f"k{k}", d) for k in range(12) for d in days if rng.random() < 0.5]
    whole = spark.createDataFrame(rows, "scope_name string, external_id string, run_day date")
    current = spark.createDataFrame(
        [], "external_id string, content_hash string, island string, region string, subregion string, end_date date, "
        "last_seen_at timestamp_ntz, status string, missing_count int, missing_since timestamp_ntz, closed_at timestamp_ntz, appearance_sequence int"
    )
    for n, day in enumerate(sorted({r[2] for r in rows})):
        seen = whole.where(F.col("run_day") == F.lit(day)).select(
            "external_id", F.lit("h").alias("content_hash"), *[F.lit(None).cast("string").alias(c) for c in ("island", "region", "subregion")],
            F.lit(None).cast("date").alias("end_date"), F.col("run_day").cast("timestamp_ntz").alias("observed_at"),
        )
        merged = lc.apply_run(current, seen, lc.RunScope("all", missing_threshold=2), run_id=n, now=f"{day} 00:00:00", today="2026-01-01")
        current = cut_lineage(lc.new_state(merged))
    got = {r.external_id: (r.appearance_sequence, r.missing_count, r.status) for r in current.collect()}
    want = {r.external_id: (r.appearance_sequence, r.missing_count, r.status) for r in lc.replay(whole, threshold=2).collect()}
    assert got == want
