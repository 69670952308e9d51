import random

import pytest
from pyspark.sql import functions as F

from helpers import moment
from listing_lifecycle_spark.functions import maps
from listing_lifecycle_spark.operators import campaigns as ca
from listing_lifecycle_spark.operators import coverage as co
from listing_lifecycle_spark.sources.locations import resolve_site_filter, site_filters

NOW = "2026-05-02 10:00:00"
TOWN = {"state": "south-island", "region": "otago", "subregion": "dunedin"}
COAST = {"state": "south-island", "region": "otago", "subregion": "clutha"}
REGION_WIDE = {"state": "south-island", "region": "otago"}
SEED = [(1, "dunedin_town", 7, TOWN), (2, "clutha_coast", 15, COAST), (3, "otago_wide", 90, REGION_WIDE),
        (4, "south_part", 600, {"state": "south-island"}), (5, "everywhere", 2000, {})]
DDL = "id long, name string, enabled boolean, interval_minutes int, site_filter map<string,string>, last_success_at timestamp_ntz"


def scopes(spark, success=None, names=None, disabled=()):
    rows = [(i, n, n not in disabled, m, f, (success or {}).get(n)) for i, n, m, f in SEED if names is None or n in names]
    return spark.createDataFrame(rows, DDL)


def test_never_succeeded_is_due_in_interval_order(spark):
    assert [r.id for r in co.due_scopes(scopes(spark), now=NOW).collect()] == [1, 2, 3, 4, 5]
    assert "everywhere" not in [r.name for r in co.due_scopes(scopes(spark, disabled=("everywhere",)), now=NOW).collect()]


@pytest.mark.parametrize("at,due", [("2026-05-02T09:46:30", False), ("2026-05-02T09:45:30", True), ("2026-05-02T09:46:00", True)])
def test_grace(spark, at, due):
    rows = co.due_scopes(scopes(spark, {"clutha_coast": moment(at)}, ["clutha_coast"]), now=NOW).collect()
    assert bool(rows) == due


@pytest.mark.parametrize(
    "names,kept",
    [
        (["dunedin_town", "clutha_coast"], {"dunedin_town", "clutha_coast"}),
        (["dunedin_town", "otago_wide"], {"otago_wide"}),
        (["dunedin_town", "south_part", "everywhere"], {"everywhere"}),
        (["clutha_coast", "south_part"], {"south_part"}),
    ],
)
def test_broadest(spark, names, kept):
    assert {r.name for r in co.broadest_scopes(scopes(spark, names=names)).collect()} == kept


def test_equal_maps_do_not_remove_each_other(spark):
    rows = [(1, "a", True, 5, REGION_WIDE, None), (2, "b", True, 5, REGION_WIDE, None)]
    assert co.broadest_scopes(spark.createDataFrame(rows, DDL)).count() == 2


def test_success_reaches_covered_scopes_and_only_forward(spark):
    newer = moment("2026-05-02T09:59:00")
    stored = scopes(spark, {"dunedin_town": newer}, disabled=("clutha_coast",))
    runs = spark.createDataFrame(
        [("otago_wide", "success", moment("2026-05-02T09:00:00")), ("otago_wide", "success", moment("2026-05-02T08:00:00")),
         ("everywhere", "failed", moment("2026-05-02T09:30:00"))],
        "scope_name string, status string, finished_at timestamp_ntz",
    )
    got = {r.name: r.last_success_at for r in co.advance_scopes(stored, runs).collect()}
    assert got == {"dunedin_town": newer, "clutha_coast": None, "otago_wide": moment("2026-05-02T09:00:00"),
                   "south_part": None, "everywhere": None}
    own = {r.name: r.last_success_at for r in co.advance_scopes(stored, runs, covered_too=False).collect()}
    assert own["otago_wide"] == moment("2026-05-02T09:00:00") and own["south_part"] is None


def test_map_containment(spark):
    rows = spark.createDataFrame([(REGION_WIDE, {"state": "south-island"}), (REGION_WIDE, {}), ({}, REGION_WIDE), ({"a": "1"}, {"a": "2"})],
                                 "whole map<string,string>, part map<string,string>")
    assert [r[0] for r in rows.select(maps.map_contains(F.col("whole"), F.col("part"))).collect()] == [True, True, False, False]


def test_containing_has_no_limit_on_keys(spark):
    ddl = "c string, i int, m map<string,string>"
    wide = {str(i): str(i) for i in range(30)}
    wholes = [("x", 1, wide), ("x", 2, {"1": "1", "2": "2"}), ("x", 3, {}), ("y", 4, {"1": "1"})]
    parts = [("x", 10, {"1": "1"}), ("x", 11, {"29": "29", "1": "1"}), ("x", 12, {}), ("x", 13, {"1": "2"}), ("x", 14, dict(wide)), ("y", 15, {"1": "1", "9": "9"}), ("x", 16, {"1": None})]
    left = spark.createDataFrame(parts, ddl).withColumnsRenamed({"i": "p", "m": "part"})
    right = spark.createDataFrame(wholes, ddl)
    got = sorted((r.i, r.p) for r in maps.containing(left, right, part="part", whole="m", by=("c",)).collect())
    assert got == sorted((w[1], p[1]) for w in wholes for p in parts if w[0] == p[0] and p[2].items() <= w[2].items())


def test_challenges(spark):
    runs = spark.createDataFrame(
        [("a", "failed", "access_challenge; x", "2026-01-01 00:00:00", "2026-01-01 00:05:00"), ("a", "failed", "timeout", "2026-01-03 00:00:00", None),
         ("b", "failed", "Unexpected status code: 202; awsWafCookieDomainList", "2026-01-02 00:00:00", None),
         ("b", "failed", "Unexpected status code: 202;", "2026-01-04 00:00:00", None), ("b", "success", "access_challenge", "2026-01-05 00:00:00", None),
         ("c", "failed", None, "2026-01-05 00:00:00", None)],
        "scope_name string, status string, error_message string, s string, f string",
    ).select("*", F.col("s").cast("timestamp_ntz").alias("started_at"), F.col("f").cast("timestamp_ntz").alias("finished_at"))
    assert co.latest_challenge(runs).first()[0] == moment("2026-01-02")
    assert {r.scope_name: r.challenged_at for r in co.latest_challenge(runs, by_scope=True).collect()} == {
        "a": moment("2026-01-01T00:05:00"), "b": moment("2026-01-02")
    }


def test_location_dimension(spark, locations):
    assert locations.count() == 66
    regions = {r.region_slug: r.island for r in locations.select("region_slug", "island").distinct().collect()}
    assert len(regions) == 15 and regions["manawatu-whanganui"] == "North Island" and regions["nelson-marlborough"] == "South Island"
    row = locations.where("subregion_slug = 'auckland-central'").first()
    assert (row.region_id, row.subregion_id, row.subregion, row.state_slug) == ("33", "178", "Auckland - Central", "north-island")
    assert site_filters(locations).count() == 1 + 2 + 15 + 66


@pytest.mark.parametrize(
    "site_filter,error",
    [
        (TOWN, None), ({}, None), ({"sitlengths": "62"}, None), ({"state": "east"}, "unknown state"), ({"region": "narnia"}, "unknown region"),
        ({"state": "south-island", "region": "auckland"}, "region outside state"), ({"subregion": "rodney"}, "subregion without region"),
        ({"region": "auckland", "subregion": "napier"}, "unknown subregion"), ({"sitlengths": "65"}, "unknown sit length"),
    ],
)
def test_filter_validation(spark, locations, site_filter, error):
    df = spark.createDataFrame([(site_filter,)], "site_filter map<string,string>")
    assert resolve_site_filter(df, locations).first().filter_error == error


def plain_split(rows, levels, cap, prefix=()):
    depth = len(prefix)
    here = [r for r in rows if r[:depth] == prefix]
    if depth >= 1 and (len(here) <= cap or depth == levels):
        return {prefix: len(here)}
    found = {}
    for value in sorted({r[depth] for r in here}):
        found.update(plain_split(rows, levels, cap, (*prefix, value)))
    return found


def test_split_plan_equals_recursion(spark):
    rng = random.Random(1)
    rows = [("N" if rng.random() < 0.7 else "S", f"r{rng.randrange(3)}", f"s{rng.randrange(4)}", str(60 + rng.randrange(2))) for _ in range(900)]
    df = spark.createDataFrame(rows, "state string, region string, subregion string, code string")
    levels = ["state", "region", "subregion", "code"]
    got = {tuple(v for v in (r[c] for c in levels) if v is not None): r.results for r in ca.split_plan(df, levels, cap=40).collect()}
    assert got == plain_split(rows, 4, 40) and sum(got.values()) == 900
    flags = ca.split_plan(df, levels, cap=5).where("over_cap").collect()
    assert flags and all(r.depth == 4 for r in flags)


def test_overlapping_leaves(spark):
    rows = [("c", "a", REGION_WIDE), ("c", "b", TOWN), ("c", "w", {"state": "north-island", "region": "waikato"}), ("d", "x", TOWN)]
    leaves = spark.createDataFrame(rows, "campaign_id string, leaf_key string, site_filter map<string,string>")
    assert [tuple(r) for r in co.overlapping_leaves(leaves).collect()] == [("c", "b", "a")]


def test_payload_latest_wins_later_leaf_on_ties(spark):
    early, late = moment("2026-05-01T00:00:00"), moment("2026-05-02T00:00:00")
    rows = [("c", "p", 1, late, 0, "k", "first"), ("c", "q", 2, late, 0, "k", "second"), ("c", "r", 3, early, 0, "k", "old"), ("c", "q", 2, late, 1, "k", "third")]
    staged = spark.createDataFrame(rows, "campaign_id string, leaf_key string, ordinal int, completed_at timestamp_ntz, position int, external_id string, content_hash string")
    got = ca.merged_payload(staged).collect()
    assert [(r.content_hash, r.observed_at) for r in got] == [("third", late)]


def test_clear_payload_and_children(spark):
    leaves = spark.createDataFrame([("c", ["x"]), ("d", ["y"])], "campaign_id string, listings array<string>")
    assert {r.campaign_id: r.listings for r in ca.clear_payload(leaves, "c").collect()} == {"c": [], "d": ["y"]}
    parents = spark.createDataFrame([(REGION_WIDE,)], "site_filter map<string,string>")
    children = parents.select(maps.canonical(F.col("site_filter")).alias("parent")).withColumn("slug", F.lit("rodney"))
    child = ca.child_filters(parents, children, level="subregion").first()
    assert child.site_filter == {**REGION_WIDE, "subregion": "rodney"}
