from datetime import date

import pytest
from pyspark.sql import functions as F

from helpers import LISTING_DDL, by, listing, moment, state
from listing_lifecycle_spark import fixed_values as fv
from listing_lifecycle_spark.operators import lifecycle as lc
from listing_lifecycle_spark.plans.persist import EVENT_LOG_TYPES
from listing_lifecycle_spark.sources.rules import make_rules
from listing_lifecycle_spark.sources.versions import VersionedTables
from listing_lifecycle_spark.streaming import deliveries, periods, runs
from listing_lifecycle_spark.streaming import state as st

STREAM = LISTING_DDL + ", observed_at timestamp_ntz, kind string, run_id bigint, scope_name string, completed_at timestamp_ntz"


def stream_rows(spark, rows):
    names = [*fv.LISTING_SCHEMA, "observed_at", "kind", "run_id", "scope_name", "completed_at"]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], STREAM)


def seen(run_id, key, at, **changes):
    return {**listing(key, dogs_count=1, **changes), "observed_at": moment(at), "kind": "listing", "run_id": run_id, "scope_name": "central"}


def complete(run_id, at):
    return {"kind": "complete", "run_id": run_id, "scope_name": "central", "completed_at": moment(at)}


def add_file(df, folder, n):
    df.coalesce(1).write.mode("append").parquet(str(folder))


def test_runs_deliveries_and_restart(spark, locations, tmp_path):
    source, progress = tmp_path / "source", str(tmp_path / "progress")
    tables = VersionedTables(spark, str(tmp_path / "tables"))
    rules = make_rules(spark, [dict(rule_name="r", site_filter={"region": "auckland"}, dogs_allowed=True)])
    scope_ddl = "name string, enabled boolean, site_filter map<string,string>, interval_minutes int, missing_threshold_runs int, last_success_at timestamp_ntz"
    empty = {
        "state": state(spark, []), "events": spark.createDataFrame([], EVENT_LOG_TYPES),
        "scopes": spark.createDataFrame([("central", True, {"region": "auckland"}, 5, 2, moment("2026-04-01"))], scope_ddl),
    }
    sink = runs.RunSink(
        tables, empty, rules=rules, locations=locations, listing_columns=list(fv.LISTING_SCHEMA),
        scope_of=lambda control: lc.RunScope(control["scope_name"], region="Auckland", missing_threshold=2),
    )

    def go():
        stream = spark.readStream.schema(STREAM).parquet(str(source))
        runs.apply_runs(stream, sink, checkpoint=progress).awaitTermination()

    add_file(stream_rows(spark, [seen(1, "a", "2026-05-01T10:00:00"), seen(1, "b", "2026-05-01T10:00:00"), complete(1, "2026-05-01T10:05:00")]), source, 1)
    go()
    assert set(by(tables.read("state"))) == {"a", "b"} and tables.read_log("events").count() == 2
    # A run that broke off has no control row, so b is not missed by it.
    add_file(stream_rows(spark, [seen(2, "a", "2026-05-01T11:00:00")]), source, 2)
    go()
    assert by(tables.read("state"))["b"]["missing_count"] == 0
    # Rows of run 3 come in two batches; the run is applied when it is complete.
    add_file(stream_rows(spark, [seen(3, "a", "2026-05-01T12:00:00", end_date=date(2026, 9, 9))]), source, 3)
    go()
    add_file(stream_rows(spark, [seen(3, "c", "2026-05-01T12:01:00"), complete(3, "2026-05-01T12:05:00")]), source, 4)
    go()
    got = by(tables.read("state"))
    assert set(got) == {"a", "b", "c"} and got["b"]["missing_count"] == 1 and got["a"]["last_seen_at"] == moment("2026-05-01T12:00:00")
    assert sorted(r.event_type for r in tables.read_log("events").collect()) == ["first_match", "first_match", "first_match", "material_change"]
    version = tables.current()
    sink(stream_rows(spark, [complete(3, "2026-05-01T12:05:00")]), 99)  # delivered again after a restart
    assert tables.current() == version

    tries = []

    def send(due):
        tries.append(due.count())
        return due.select("event_id", "channel", F.lit(len(tries) > 1).alias("sent"), F.lit("down").alias("error_message"))

    delivery = deliveries.DeliverySink(tables, rules, spark.createDataFrame([("telegram",)], "channel string"), send)
    ticks = tmp_path / "ticks"
    for n, at in enumerate(("2026-05-01T13:00:00", "2026-05-01T13:05:00", "2026-05-01T13:10:00", "2026-05-02T00:00:00")):
        add_file(spark.createDataFrame([(moment(at),)], "now timestamp_ntz"), ticks, n)
        stream = spark.readStream.schema("now timestamp_ntz").parquet(str(ticks))
        deliveries.deliver_on_ticks(stream, delivery, checkpoint=str(tmp_path / "tick-progress")).awaitTermination()
    # 13:00 UTC is night in Auckland: events made in the night wait for 06:00, which is 18:00 UTC.
    attempts = tables.read_log("attempts").groupBy("status").count().collect()
    assert {r.status: r["count"] for r in attempts} == {"failed": 2, "sent": 4}
    assert tables.read("state").count() == 3


def test_merged_observations_and_stale_rows(spark, tmp_path):
    tables = VersionedTables(spark, str(tmp_path / "tables"))
    types = "external_id string, content_hash string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, status string, missing_count int, appearance_sequence int"
    empty, ddl = spark.createDataFrame([], types), "external_id string, content_hash string, observed_at timestamp_ntz"
    source = tmp_path / "source"
    for n, rows in enumerate([[("a", "h1", "2026-05-01T10:00:00"), ("a", "h2", "2026-05-01T11:00:00")], [("a", "h0", "2026-05-01T09:00:00"), ("b", "h", "2026-05-01T09:00:00")]]):
        add_file(spark.createDataFrame([(k, h, moment(t)) for k, h, t in rows], ddl), source, n)
        st.merge_stream(spark.readStream.schema(ddl).parquet(str(source)), tables, empty, checkpoint=str(tmp_path / "progress")).awaitTermination()
    got = by(tables.read("state"))
    assert got["a"]["content_hash"] == "h2" and got["a"]["last_seen_at"] == moment("2026-05-01T11:00:00") and set(got) == {"a", "b"}
    sink = st.ObservationSink(tables, empty, ["observed_at"])
    version = tables.current()
    sink(spark.createDataFrame([("z", "h", moment("2026-06-01"))], ddl), 1)  # batch 1 was merged before
    assert tables.current() == version


def test_first_sighting_does_not_depend_on_batches(spark, tmp_path):
    types = "external_id string, content_hash string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, status string, missing_count int, appearance_sequence int"
    empty, ddl = spark.createDataFrame([], types), "external_id string, content_hash string, observed_at timestamp_ntz"
    rows = [("a", "h1", moment("2026-01-01")), ("a", "h9", moment("2026-01-09")), ("b", "h", moment("2026-01-05"))]
    for name, batches in (("one", [rows]), ("two", [rows[:1], rows[1:]]), ("back", [rows[1:], rows[:1]])):
        tables = VersionedTables(spark, str(tmp_path / name))
        sink = st.ObservationSink(tables, empty, ["observed_at"])
        for n, batch in enumerate(batches):
            sink(spark.createDataFrame(batch, ddl), n)
        got = by(tables.read("state"))
        assert {k: (r["first_seen_at"], r["last_seen_at"], r["content_hash"]) for k, r in got.items()} == {
            "a": (moment("2026-01-01"), moment("2026-01-09"), "h9"), "b": (moment("2026-01-05"), moment("2026-01-05"), "h")
        }


def test_a_first_run_without_rows_is_suspicious(spark, locations, tmp_path):
    tables = VersionedTables(spark, str(tmp_path / "tables"))
    scope_ddl = "name string, enabled boolean, site_filter map<string,string>, interval_minutes int, missing_threshold_runs int, last_success_at timestamp_ntz"
    empty = {
        "state": state(spark, []), "events": spark.createDataFrame([], EVENT_LOG_TYPES),
        "scopes": spark.createDataFrame([("central", True, {"region": "auckland"}, 5, 2, None)], scope_ddl),
    }
    sink = runs.RunSink(
        tables, empty, rules=make_rules(spark, [dict(rule_name="r", site_filter={})]), locations=locations, listing_columns=list(fv.LISTING_SCHEMA),
        scope_of=lambda control: lc.RunScope(control["scope_name"], region="Auckland", missing_threshold=2),
    )
    sink(stream_rows(spark, [complete(1, "2026-05-01T10:05:00")]), 0)
    assert [r.status for r in tables.read_log("runs").collect()] == ["suspicious"] and tables.read("state") is None
    sink(stream_rows(spark, [seen(2, "a", "2026-05-01T10:00:00"), complete(2, "2026-05-01T10:06:00")]), 1)
    assert set(by(tables.read("state"))) == {"a"}


def test_other_read_errors_are_not_an_empty_store(spark, tmp_path):
    (tmp_path / "t" / "_commits").mkdir(parents=True)
    assert VersionedTables(spark, str(tmp_path / "t")).current() is None
    assert VersionedTables(spark, str(tmp_path / "none")).current() is None
    with pytest.raises(Exception, match="(?i)scheme|filesystem"):
        VersionedTables(spark, "nosuchstore://x/t").current()


@pytest.mark.parametrize("cuts", [[4], [1, 1, 2], [2, 2]])
def test_period_counts_are_exact_for_any_batches(spark, tmp_path, cuts):
    rows = [("a", "2026-05-01"), ("a", "2026-05-20"), ("b", "2026-05-03"), ("a", "2026-06-01")]
    for unit, want in (("month", {"2026-05-01": 2, "2026-06-01": 1}), ("week", {"2026-04-27": 2, "2026-05-18": 1, "2026-06-01": 1})):
        sink, at = periods.PeriodSink(str(tmp_path / unit), unit), 0
        for n, size in enumerate(cuts):
            batch = spark.createDataFrame(rows[at : at + size], "external_id string, at string")
            at += size
            for _ in range(2):  # a repeated batch changes nothing
                sink(batch.select("external_id", F.col("at").cast("timestamp").alias("first_seen_at")), n)
        assert {str(r.period_start): r.listing_count for r in sink.counts(spark).collect()} == want


def test_a_short_delay_is_refused(spark):
    with pytest.raises(ValueError, match="7 days"):
        periods.closed_week_counts(spark.range(1), delay_days=3)
