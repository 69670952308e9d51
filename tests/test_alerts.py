import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from helpers import listing, listings, moment
from listing_lifecycle_spark import fixed_values as fv
from listing_lifecycle_spark.functions import calendar, text
from listing_lifecycle_spark.functions.hashing import alert_fingerprint, stable_hash
from listing_lifecycle_spark.operators import deliveries as de
from listing_lifecycle_spark.operators import events as ev
from listing_lifecycle_spark.operators import matching as ma
from listing_lifecycle_spark.plans.persist import EVENT_LOG_TYPES
from listing_lifecycle_spark.sources.rules import make_rules

BASE = listing("base", dogs_count=1, cats_count=1, total_animals=2)
RULE = dict(
    site_filter={"state": "north-island", "region": "auckland", "subregion": "auckland-central"},
    start_date_on_or_after="2026-08-01", end_date_on_or_before="2026-11-30", min_duration_days=14, max_duration_days=60,
    allowed_islands=["North Island"], allowed_regions=["Auckland"], allowed_subregions=["Auckland - Central"], max_total_animals=3,
    max_dogs=1, dogs_allowed=True, cats_allowed=True, min_reply_rating_score=8, allowed_house_types=["House"],
    excluded_house_types=["Farm House"], include_keywords=["SUNNY", "calm"], exclude_keywords=["horse"],
)
REJECTED = {
    "island": dict(island="South Island"), "no island": dict(island=None), "region": dict(region="Waikato"), "subregion": dict(subregion="Rodney"),
    "starts early": dict(start_date=date(2026, 7, 31)), "no start": dict(start_date=None), "ends late": dict(end_date=date(2026, 12, 1)),
    "no end": dict(end_date=None), "short": dict(duration_days=13), "long": dict(duration_days=61), "no length": dict(duration_days=None),
    "animals": dict(total_animals=4), "dogs": dict(dogs_count=2), "rating": dict(reply_rating_score=7), "no rating": dict(reply_rating_score=None),
    "house": dict(house_type="Unit"), "no house": dict(house_type=None), "word missing": dict(title="Dark home"), "bad word": dict(intro="calm HORSES"),
    "no pets": dict(no_pets=True), "fish": dict(fish_count=1),
}


def matched(spark, locations, rows, rules, **options):
    found = ma.match_rules(listings(spark, rows), make_rules(spark, rules), locations, **options)
    return {(r.external_id, r.rule_name) for r in found.select("external_id", "rule_name").collect()}


def test_single_changes_reject(spark, locations):
    rows = [BASE] + [{**BASE, **change, "external_id": name} for name, change in REJECTED.items()]
    assert matched(spark, locations, rows, [dict(rule_name="r", **RULE)]) == {("base", "r")}


def test_animals_are_opt_in(spark, locations):
    rows = [listing(c, **{c: 1}) for c in fv.PET_COUNT_COLUMNS] + [listing("none", no_pets=True)]
    rules = [dict(rule_name="nothing")] + [dict(rule_name=c, **{c.replace("_count", "_allowed"): True}) for c in fv.PET_COUNT_COLUMNS]
    rules.append(dict(rule_name="none", no_pets_allowed=True))
    assert matched(spark, locations, rows, rules) == {(c, c) for c in [*fv.PET_COUNT_COLUMNS, "none"]}


def test_windows_codes_lists_and_disabled_rules(spark, locations):
    window = dict(start_date_on_or_after="2026-08-01", end_date_on_or_before="2026-11-30")
    stay = listing("stay", start_date=date(2026, 7, 20), end_date=date(2026, 8, 3), duration_days=21)
    rules = [
        dict(rule_name="contained", **window), dict(rule_name="overlaps", date_window_match="overlaps", **window),
        dict(rule_name="62", site_filter={"sitlengths": "62"}), dict(rule_name="60", site_filter={"sitlengths": "60"}),
        dict(rule_name="empty list", allowed_regions=[]), dict(rule_name="off", enabled=False), dict(rule_name="bad mode", date_window_match="near"),
        dict(rule_name="bad place", site_filter={"region": "narnia"}), dict(rule_name="no channel", channels=[]),
        dict(rule_name="state", site_filter={"state": "north-island"}), dict(rule_name="south", site_filter={"state": "south-island"}),
    ]
    assert matched(spark, locations, [stay], rules) == {("stay", "overlaps"), ("stay", "62"), ("stay", "state")}
    errors = {r.rule_name: r.rule_error for r in ma.rule_errors(make_rules(spark, rules), locations).collect()}
    assert errors == {"bad mode": "unknown date window mode", "bad place": "unknown region", "no channel": "invalid channels"}


def test_sliced_join_equals_broadcast(spark, locations):
    """A third of the listings share one place; rules beyond the broadcast bound take the sliced join."""
    rows = [listing(f"l{i}", subregion="Auckland - Central" if i % 3 else "Rodney", region="Auckland" if i % 5 else None,
                    island="North Island" if i % 7 else None, duration_days=i % 70) for i in range(300)]
    rules = [dict(rule_name=f"r{n}", min_duration_days=n, site_filter=f) for n in (1, 30, 60)
             for f in ({"region": "auckland"},)] + [dict(rule_name="any", min_duration_days=10), dict(rule_name="s", site_filter=RULE["site_filter"])]
    assert matched(spark, locations, rows, rules) == matched(spark, locations, rows, rules, slices=5)


def test_index_equals_join_on_random_rules(spark, locations):
    """Nulls, empty lists, words in other cases, reversed dates, unknown places: the index and the join find the same."""
    r = random.Random(8)
    some = lambda *values: r.choice([None, *values])
    day = lambda: date(2026, r.randint(1, 12), r.randint(1, 28))
    places = r.sample(fv.LOCATIONS, 6) + [("North Island", "Nowhere", "x", "Nothing", "y")]
    rows = []
    for i in range(400):
        island, region, _, subregion, _ = r.choice(places)
        rows.append(listing(
            f"l{i}", island=some(island, island), region=some(region, region), subregion=some(subregion, subregion, subregion), duration_days=some(1, 7, 8, 30, 61, 200), start_date=some(day(), day()),
            end_date=some(day(), day()), house_type=some("House", "Unit", "Boat"), total_animals=some(0, 1, 5), dogs_count=some(0, 0, 2), cats_count=some(0, 0, 1), no_pets=some(True, False, False),
            reply_rating_score=some(0, 5, 10), title=some("Große Straße", "STRASSE", "", "abc"), intro=some("ab", "Bc d", ""), listing_tag=some("x", "")))
    slug = {p[:2] + (p[3],): s for p, s in (((x["island"], x["region"], "", x["subregion"]), (x["state_slug"], x["region_slug"], x["subregion_slug"])) for x in locations.collect())}
    rules = []
    for i in range(150):
        state_slug, region_slug, subregion_slug = r.choice([slug[p[0], p[1], p[3]] for p in places[:-1]])
        site = r.choice([{}, {}, {"state": state_slug}, {"region": region_slug}, {"region": region_slug, "subregion": subregion_slug}])
        rule = dict(
            rule_name=f"r{i}", site_filter={**site, **r.choice([{}, {}, {"sitlengths": r.choice(["60", "61", "62", "63", "64"])}])}, date_window_match=some("contained", "overlaps"),
            start_date_on_or_after=some(str(day())), end_date_on_or_before=some(str(day())), min_duration_days=some(5), max_duration_days=some(40), max_total_animals=some(1), max_dogs=some(1),
            min_reply_rating_score=some(5), allowed_islands=some(["North Island"], []), allowed_regions=some([places[0][1], places[1][1], None]), allowed_subregions=some([places[0][3], places[2][3]]),
            allowed_house_types=some(["House", "Unit"]), excluded_house_types=some(["Boat"], [], [None]), include_keywords=some([], ["STRASSE"], ["B", "a"], [None], [""]), exclude_keywords=some([], ["ß"], ["D", None]),
            dogs_allowed=r.random() < 0.8, cats_allowed=r.random() < 0.8, no_pets_allowed=r.random() < 0.8)
        for name in ("allowed_islands", "allowed_regions", "allowed_subregions", "allowed_house_types", "include_keywords", "start_date_on_or_after", "min_reply_rating_score"):
            rule[name] = r.choice([None, None, rule[name]])  # else hardly any rule would match anything
        rules.append(rule)
    indexed = matched(spark, locations, rows, rules, indexed=True)
    assert indexed == matched(spark, locations, rows, rules) == matched(spark, locations, rows, rules, slices=3) and len(indexed) > 500
    wide = ma.match_rules(listings(spark, rows), make_rules(spark, rules), locations, indexed=True)
    other = ma.match_rules(listings(spark, rows), make_rules(spark, rules), locations, slices=2)
    assert wide.columns == other.columns and wide.dtypes == other.dtypes
    assert sorted(map(str, wide.collect())) == sorted(map(str, other.collect()))


def test_no_rules_match_nothing(spark, locations):
    for indexed in (True, False):
        assert matched(spark, locations, [BASE], [dict(rule_name="off", enabled=False)], indexed=indexed) == set()


def test_stable_hash_counts_nulls(spark):
    rows = spark.createDataFrame([(1, None, 2), (1, 2, None), (1, None, 2)], "a int, b int, c int")
    hashes = [r[0] for r in rows.select(stable_hash(["c", "a", "b"])).collect()]
    assert hashes[0] == hashes[2] != hashes[1]
    assert len(hashes[0]) == 64


def test_fingerprint_ignores_display_fields(spark):
    rows = listings(spark, [BASE, {**BASE, "title": "x", "starts_soon": True, "content_hash": "z"}, {**BASE, "city": "x"}])
    a, b, c = [r[0] for r in rows.select(alert_fingerprint()).collect()]
    assert a == b != c


@pytest.mark.parametrize(
    "zone,opens,closes,at,want",
    [
        ("Pacific/Auckland", "00:00", "06:00", "2026-08-01T14:30:00", "2026-08-01T18:00:00"),
        ("Pacific/Auckland", "22:00", "06:00", "2026-08-01T11:30:00", "2026-08-01T18:00:00"),
        ("Pacific/Auckland", "22:00", "06:00", "2026-08-01T14:30:00", "2026-08-01T18:00:00"),
        ("Pacific/Auckland", "00:00", "06:00", "2026-08-01T18:00:00", "2026-08-01T18:00:00"),
        ("Pacific/Auckland", "22:00", "06:00", "2026-08-01T00:00:00", "2026-08-01T00:00:00"),
        ("Pacific/Auckland", "00:00", "02:30", "2026-09-26T12:30:00", "2026-09-26T14:30:00"),
        ("Pacific/Auckland", "00:00", "02:30", "2026-04-04T12:30:00", "2026-04-04T13:30:00"),
    ],
)
def test_quiet_hours(spark, zone, opens, closes, at, want):
    got = spark.range(1).select(calendar.deliver_after(calendar.instant(at), zone, opens, closes)).first()[0]
    assert got == datetime.fromisoformat(want)


def observation(external_id="a", **changes):
    return {**listing(external_id, dogs_count=1), "created": False, "observation_applied": True, "previous_status": "active",
            "appearance_sequence": 1, "rule_name": "r", "channels": ["telegram"], "quiet_timezone": "Pacific/Auckland",
            "quiet_start": "00:00", "quiet_end": "06:00", **changes}


EXTRA = ("created boolean, observation_applied boolean, previous_status string, appearance_sequence int, rule_name string, "
         "channels array<string>, quiet_timezone string, quiet_start string, quiet_end string")


def observations(spark, rows):
    names = [*fv.LISTING_SCHEMA, *[part.split()[0] for part in EXTRA.split(", ")]]
    ddl = ", ".join(f"{n} {k}" for n, k in fv.LISTING_SCHEMA.items()) + ", " + EXTRA
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ddl)


def test_event_sequences(spark):
    """Each step is one run over the log of the runs before."""
    log = spark.createDataFrame([], EVENT_LOG_TYPES)
    steps = [
        (observation(created=True), ["first_match"]),
        (observation(title="other words", content_hash="h2"), []),
        (observation(city="B"), ["material_change"]),
        (observation(), []),  # back to the first fingerprint within one appearance
        (observation(city="B", previous_status="missing_confirmed", appearance_sequence=2), []),
        (observation(city="C", previous_status="missing_confirmed", appearance_sequence=3), ["confirmed_reappearance"]),
        (observation(previous_status="active", appearance_sequence=3), ["material_change"]),
        (observation(city="Z", observation_applied=False), []),
        (observation("b"), ["became_match"]),
    ]
    for n, (row, want) in enumerate(steps):
        fresh = ev.create_events(observations(spark, [row]), log, run_id=n, event_time=f"2026-08-0{n + 1} 00:00:00").collect()
        assert [e.event_type for e in fresh] == want, n
        log = log.union(spark.createDataFrame(fresh, log.sparkSession.createDataFrame([], EVENT_LOG_TYPES).select(*ev.EVENT_COLUMNS).schema)
                        .select(*log.columns)) if fresh else log
        log = spark.createDataFrame(log.collect(), log.schema)
    assert log.count() == 5 and log.select("event_id").distinct().count() == 5
    first = log.orderBy("created_at").first()
    assert first.target_channels == ["telegram"] and first.deliver_after == moment("2026-08-01T00:00:00") and first.detected_run_id == 0


def event_rows(spark):
    return spark.createDataFrame(
        [("e1", "base", "r", ["telegram", "email"], moment("2026-08-01")), ("e2", "base", "r", ["telegram"], moment("2026-08-03"))],
        "event_id string, external_id string, rule_name string, target_channels array<string>, deliver_after timestamp_ntz",
    )


ATTEMPTS = "event_id string, channel string, attempted_at timestamp_ntz, status string, message string, error_message string"


def test_delivery_rounds(spark):
    """A failure is tried again, a success is not; later events and unknown channels are left."""
    rules, now = make_rules(spark, [dict(rule_name="r")]), "2026-08-02 00:00:00"
    cards = listings(spark, [BASE])
    none = spark.createDataFrame([], ATTEMPTS)
    pending = de.pending_deliveries(event_rows(spark), rules, cards, none, now=now)
    routed = de.route(pending, spark.createDataFrame([("telegram",)], "channel string"))
    assert [(r.event_id, r.channel) for r in de.unconfigured(routed).collect()] == [("e1", "email")]
    failed = spark.createDataFrame([("e1", "telegram", False, None)], "event_id string, channel string, sent boolean, error_message string")
    first = de.record_attempts(routed, failed, now=now)
    assert [(r.status, r.error_message) for r in first.collect()] == [("failed", "Provider send failed")]
    again = de.due_targets(event_rows(spark), first, now=now)
    assert {(r.event_id, r.channel) for r in again.collect()} == {("e1", "telegram"), ("e1", "email")}
    second = de.record_attempts(routed, failed.withColumn("sent", F.lit(True)), now=now)
    left = de.due_targets(event_rows(spark), first.union(second), now=now)
    assert {(r.event_id, r.channel) for r in left.collect()} == {("e1", "email")}
    counts = de.summary(routed, second).first().asDict()
    assert counts == {"deliveries_due": 2, "attempts_made": 1, "sent": 1, "failed": 0, "unconfigured": 1}


def test_message_text(spark):
    rows = listings(spark, [
        listing("a", dogs_count=1, cats_count=2), listing("b", no_pets=True, duration_days=0, city=None, end_date=None),
        listing("c", duration_days=1, city=None, region="", rabbits_guinea_pigs_count=1), listing("d", duration_days=7),
    ])
    got = {r[0]: r[1] for r in rows.select("external_id", text.alert_message(F.lit("Name"), {c: F.col(c) for c in rows.columns})).collect()}
    assert got["a"] == ("Name\n\nGREY LYNN, AUCKLAND\n\nDATES: 13 Aug 2026 - 3 Sep 2026\nLENGTH: 3 weeks\nPETS: 1 dog, 2 cats\n\n"
                        "VIEW HOUSE AD: https://listings.example/a")
    assert "\n\nAUCKLAND\n\nDATES: 13 Aug 2026 - Not stated\nLENGTH: 0 weeks\nPETS: No pets\n" in got["b"]
    assert "NEW MATCHING HOUSE SIT" in got["c"] and "LENGTH: 1 day\nPETS: 1 rabbit/guinea pig\n" in got["c"]
    assert "LENGTH: 1 week\nPETS: Not stated" in got["d"]
