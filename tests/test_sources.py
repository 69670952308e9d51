import json

import pytest
from pyspark.sql import functions as F

from helpers import listing, listings, state
from listing_lifecycle_spark import fixed_values as fv
from listing_lifecycle_spark.functions.joins import join_dimension, latest_by
from listing_lifecycle_spark.session import cut_lineage, shared_folder
from listing_lifecycle_spark.sources import rules as ru
from listing_lifecycle_spark.sources import tables as ta
from listing_lifecycle_spark.sources.versions import VersionedTables

DEFAULTS = {
    "enabled": True,
    "local_filter": {"date_window_match": "contained", "min_duration_days": 7, "max_dogs": 2, "dogs_allowed": False, "allowed_house_types": None,
                     "excluded_house_types": ["Boat"], "include_keywords": [], "exclude_keywords": []},
    "delivery": {"channels": ["telegram"], "quiet_hours": {"timezone": "Pacific/Auckland", "start": "00:00", "end": "06:00"}},
}
FILTERS = {"filters": [
    {"name": "plain", "site_filter": {"state": "north-island"}},
    {"name": "own", "enabled": False, "site_filter": {}, "local_filter": {
        "min_duration_days": None, "dogs_allowed": True, "allowed_house_types": ["House", "Unit"], "start_date_on_or_after": "2027-01-30"},
     "delivery": {"channels": ["email"], "quiet_hours": {"end": "07:00"}}},
]}


def test_rules_from_json(spark, tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps(FILTERS, indent=2))
    (tmp_path / "defaults.json").write_text(json.dumps(DEFAULTS, indent=2))
    rules = {r.rule_name: r for r in ru.read_rules(spark, str(tmp_path / "rules.json"), str(tmp_path / "defaults.json")).collect()}
    plain, own = rules["plain"], rules["own"]
    assert (plain.enabled, plain.min_duration_days, plain.max_dogs, plain.excluded_house_types, plain.channels) == (True, 7, 2, ["Boat"], ["telegram"])
    assert plain.allowed_house_types is None and plain.include_keywords == [] and plain.site_filter == {"state": "north-island"}
    assert own.enabled is False and own.min_duration_days is None and own.max_dogs == 2 and own.dogs_allowed is True
    assert own.allowed_house_types == ["House", "Unit"] and str(own.start_date_on_or_after) == "2027-01-30"
    assert (own.channels, own.quiet_timezone, own.quiet_start, own.quiet_end) == (["email"], "Pacific/Auckland", "00:00", "07:00")


def test_synchronize(spark):
    stored = ru.make_rules(spark, [dict(rule_name=n, site_filter={"a": "1", "b": "2"}) for n in ("same", "edited", "gone")] + [dict(rule_name="old", enabled=False)])
    defined = ru.make_rules(spark, [dict(rule_name="same", site_filter={"b": "2", "a": "1"}), dict(rule_name="edited", max_dogs=1), dict(rule_name="new")])
    got = {r.rule_name: (r.change, r.enabled) for r in ru.synchronize(stored, defined).collect()}
    assert got == {"same": ("unchanged", True), "edited": ("updated", True), "gone": ("disabled", False), "old": ("unchanged", False), "new": ("inserted", True)}
    assert ru.duplicate_names(stored.union(stored.limit(1))).count() == 1


def test_versions(spark, tmp_path):
    tables = VersionedTables(spark, str(tmp_path))
    assert tables.current() is None and tables.read("state") is None and tables.read_log("events") is None and not tables.has_batch("a")
    tables.commit({"state": spark.range(2)}, logs={"events": spark.range(1)}, batch_key="a")
    # A commit that stops before its pointer is written stays invisible, in tables and logs.
    spark.range(9).write.parquet(f"{tmp_path}/v2/state")
    spark.range(9).write.parquet(f"{tmp_path}/events/version=2")
    assert tables.current() == 1 and tables.read("state").count() == 2 and tables.read_log("events").count() == 1
    tables.commit(logs={"events": spark.range(3)}, batch_key="b")
    assert tables.current() == 2 and tables.current("state") == 1 and tables.read("state").count() == 2
    assert tables.read_log("events").count() == 4 and tables.read_log("events").columns == ["id"]
    tables.commit({"state": spark.range(3)})
    assert tables.read("state").count() == 3 and tables.read("state", 1).count() == 2
    assert tables.has_batch("a") and tables.read("other") is None


def test_snapshot_csv_log_json(spark, tmp_path):
    whole = ta.complete_columns(state(spark, [dict(external_id="one")]))
    assert whole.columns == ta.PERSISTED_COLUMNS
    whole.write.parquet(str(tmp_path / "snapshot"))
    assert ta.read_source_of_truth(spark, path=str(tmp_path / "snapshot")).count() == 1
    assert ta.read_snapshot(spark, str(tmp_path / "snapshot")).first().external_id == "one"
    meta = {r.key: r.value for r in ta.snapshot_metadata(whole, source="x", refreshed_at="now").collect()}
    assert meta == {"source": "x", "listing_count": "1", "refreshed_at": "now"}
    rows = listings(spark, [listing("a", title="x, y"), listing("b", end_date=None)])
    ta.write_csv(rows.select("external_id", "title"), str(tmp_path / "csv"))
    assert {r.title for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {"x, y", "Sunny home"}
    assert ta.from_json(ta.as_json(rows)).exceptAll(rows).count() == 0
    log = spark.createDataFrame([("k", "2026-05-01 10:00:00"), ("k", "2026-05-02 10:00:00"), ("m", "2026-05-02 10:00:00")], "key string, at string").withColumn(
        "at", F.col("at").cast("timestamp_ntz"))
    ta.append_log(log, str(tmp_path / "log"), date_column="at")
    stored = spark.read.parquet(str(tmp_path / "log"))
    assert stored.where("log_date = '2026-05-02'").count() == 2
    fresh = ta.absent_from_log(log.withColumn("key", F.concat("key", F.lit("2"))), stored, ["key"])
    assert fresh.count() == 2 and ta.absent_from_log(log, stored, ["key"]).count() == 0


def test_joins(spark):
    large = spark.range(1000).select(F.col("id").cast("string").alias("external_id"), F.when(F.col("id") < 700, "hot").otherwise("cold").alias("k"))
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("cold", 3), ("none", 4)], "k string, v int")
    a = join_dimension(large, small, ["k"], spread_by="external_id")
    b = join_dimension(large, small, ["k"], spread_by="external_id", slices=7)
    assert a.count() == b.count() == 1700 and a.exceptAll(b.select(*a.columns)).count() == 0
    rows = spark.createDataFrame([("a", 1, None, "x"), ("a", 1, 2, "y"), ("b", 0, 0, "z")], "k string, o1 int, o2 int, v string")
    assert {(r.k, r.v) for r in latest_by(rows, ["k"], ["o1", "o2"]).collect()} == {("a", "y"), ("b", "z")}


def test_shared_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert cut_lineage(spark.range(3)).count() == 3
