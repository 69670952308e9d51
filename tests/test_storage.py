"""Bucketed tables: untouched files stay, versions differ where they were written, pointers fold, old folders go."""

import os

from pyspark.sql import functions as F

from listing_lifecycle_spark.sources import eventlog as el
from listing_lifecycle_spark.sources import versions as ve
from listing_lifecycle_spark.sources.eventlog import EventLog
from listing_lifecycle_spark.sources.versions import VersionedTables, bucket_of, changed_buckets


def rows(spark, values):
    return spark.createDataFrame(list(values.items()), "external_id string, n int").checkpoint()


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def commit(tables, df, changed):
    return tables.commit(buckets={"state": changed_buckets(df, "external_id", changed, 16)})


def test_only_touched_buckets_are_written(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cut"))
    tables = VersionedTables(spark, str(tmp_path / "t"))
    values = {f"k{i}": i for i in range(200)}
    first = commit(tables, rows(spark, values), F.lit(True))
    before, places = files(tmp_path / "t" / "state"), tables.bucket_versions("state")
    values |= {"k7": -7, "new": 1}
    second = commit(tables, rows(spark, values), F.col("external_id").isin("k7", "new"))
    after, now = files(tmp_path / "t" / "state"), tables.bucket_versions("state")
    assert {k: v for k, v in after.items() if k in before} == before  # nothing that lay there was touched
    touched = {r[0] for r in spark.createDataFrame([("k7",), ("new",)], "k string").select(bucket_of(F.col("k"), 16)).collect()}
    assert {b for b in now if now[b] == second} == touched and {b: places[b] for b in places if b not in touched} == {b: now[b] for b in now if b not in touched}
    assert {r.external_id: r.n for r in tables.read("state").collect()} == values
    assert {r.external_id: r.n for r in tables.read("state", first).collect()}["k7"] == 7
    assert {r.external_id for r in tables.read_buckets("state", sorted(touched)).collect()} >= {"k7", "new"}
    assert tables.read_buckets("state", []) is None


def test_differences_between_versions(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cut"))
    tables = VersionedTables(spark, str(tmp_path / "t"))
    values = {f"k{i}": i for i in range(300)}
    first = commit(tables, rows(spark, values), F.lit(True))
    values |= {"k1": 5, "new": 0}
    second = commit(tables, rows(spark, values), F.col("external_id").isin("k1", "new"))
    df = rows(spark, values)
    third = tables.commit(buckets={"state": changed_buckets(df, "external_id", F.col("external_id") == "k2", 16).where("external_id <> 'k2'")})
    diff = lambda a, b: {(r.external_id, r.change) for r in tables.differences("state", a, b, "external_id").collect()}
    assert diff(first, second) == {("k1", "changed"), ("new", "inserted")}
    assert diff(second, third) == {("k2", "removed")} and diff(third, first) == {("k1", "changed"), ("new", "removed"), ("k2", "inserted")}
    assert diff(first, first) == set()
    plan = tables.differences("state", second, third, "external_id")._jdf.queryExecution().toString()
    assert plan.count("bucket=") <= 4  # one bucket of each version, not sixteen


def test_pointers_fold_and_old_folders_go(spark, tmp_path, monkeypatch):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cut"))
    monkeypatch.setattr(ve, "FOLD", 3)
    tables = VersionedTables(spark, str(tmp_path / "t"))
    values = {f"k{i}": 0 for i in range(40)}
    for n in range(8):
        values["k3"] = n
        df = rows(spark, values)
        tables.commit({"scopes": spark.range(n + 1)}, logs={"runs": spark.range(1)}, buckets={"state": changed_buckets(df, "external_id", F.lit(n == 0) | (F.col("external_id") == "k3"), 8)}, batch_key=f"b{n}")
    pointers = [f for f in os.listdir(tmp_path / "t" / "_commits") if f.endswith(".json")]
    assert len(pointers) < 3 and len(os.listdir(tmp_path / "t" / "_folded")) == 1
    assert all(tables.has_batch(f"b{n}") for n in range(8)) and not tables.has_batch("b8") and tables.current() == 8
    assert tables.read("scopes").count() == 8 and tables.read_log("runs").count() == 8
    gone = tables.forget(keep=2)
    assert gone and tables.read("scopes").count() == 8 and tables.read("scopes", 7).count() == 7
    assert {r.external_id: r.n for r in tables.read("state").collect()} == values
    assert {r.external_id: r.n for r in tables.read("state", 7).collect()}["k3"] == 6
    assert tables.read_log("runs").count() == 8 and tables.forget(keep=2) == []


def events(spark, part, listings):
    return spark.createDataFrame([(f"{part}-{x}", f"l{x}", "r", f"2026-01-{part:02d} 10:00:00") for x in listings], "event_id string, external_id string, rule_name string, created_at string").checkpoint()


def test_only_parts_that_may_hold_a_key_are_read(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cut"))
    tables = VersionedTables(spark, str(tmp_path / "t"))
    log = EventLog(tables)
    keys = lambda *names: spark.createDataFrame([(n, "r") for n in names], "external_id string, rule_name string")
    assert log.of(keys("l1")) is None
    for part in range(1, 11):  # part n has the listings n * 100 to n * 100 + 59, and listing 5
        tables.commit(logs=log.logs(events(spark, part, [*range(part * 100, part * 100 + 60), *([5] if part in (3, 7) else [])])))
    assert log.parts() == list(range(1, 11))
    assert log.parts_with(keys("l430")) == [4] and log.parts_with(keys("l430", "l915")) == [4, 9] and log.parts_with(keys("l5")) == [3, 7]
    assert log.parts_with(keys("nowhere")) == [] and log.of(keys("nowhere")).count() == 0
    found = log.of(keys("l5"))
    assert found.count() == 122 and {f.split("version=")[1].split("/")[0] for f in found.inputFiles()} == {"3", "7"}
    spark.range(3).write.parquet(f"{tmp_path}/t/events/version=11")  # a commit that failed
    assert log.parts()[-1] == 10 and tables.read_log("events").count() == 602
    assert log.fold() == 11 and log.parts() == [11] and log.fold() is None
    assert tables.read_log("events").count() == 602 and log.parts_with(keys("l5")) == [11] and log.parts_with(keys("nowhere")) == []
    tables.commit(logs=log.logs(events(spark, 12, [7])))
    assert log.parts() == [11, 12] and log.parts_with(keys("l7")) == [12]


def test_filters_of_many_keys_miss_none(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cut"))
    tables = VersionedTables(spark, str(tmp_path / "t"))
    log = EventLog(tables, key=("external_id",))
    rows = spark.range(9000).selectExpr("concat('k', id) AS external_id", "'2026-01-01' AS created_at").checkpoint()
    tables.commit(logs=log.logs(rows))
    assert tables.read_log("events_filter").count() == 5  # 9,000 keys, 2,048 to a block
    others = spark.range(3000).selectExpr("concat('other', id) AS external_id")
    assert all(log.parts_with(rows.where(f"external_id = 'k{i}'")) == [1] for i in (0, 17, 4097, 8999))
    wrong = sum(log.parts_with(others.where(f"external_id = 'other{i}'")) == [1] for i in range(0, 40))
    assert wrong <= 1 and el.ASKED == 1_000_000
