"""The alert log over order lines: what is shuffled and stored on the way, and the SQL twins on rows with copies and nulls."""

import random
from datetime import date, timedelta
from pathlib import Path

import pytest

from listing_lifecycle_spark.operators import matching as ma
from listing_lifecycle_spark.sources.rules import make_rules
from listing_lifecycle_spark.workload import alerts
from listing_lifecycle_spark.workload.bindings import Bound
from listing_lifecycle_spark.workload.catalog import load


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """400 orders of up to seven lines, which match several rules."""
    top, r = tmp_path_factory.mktemp("orders"), random.Random(7)
    day = lambda n: date(1996, 1, 1) + timedelta(days=n)
    lines = [
        (o, n, r.randint(1, 3), r.randint(1, 3), float(r.randint(1, 50)), 100.0, r.choice([0.0, 0.06, 0.1]), r.choice("RAN"), r.choice("OF"), day(r.randint(0, 900)))
        for o in range(1, 401) for n in range(1, r.randint(1, 7) + 1)
    ]
    tables = {
        "region": ("r_regionkey long, r_name string", [(0, "AFRICA"), (2, "ASIA"), (3, "EUROPE")]),
        "nation": ("n_nationkey long, n_name string, n_regionkey long", [(1, "NATION_1", 0), (2, "NATION_2", 2), (3, "NATION_3", 3)]),
        "customer": ("c_custkey long, c_mktsegment string, c_nationkey long", [(c, r.choice(["HOUSEHOLD", "BUILDING"]), 1 + c % 3) for c in range(40)]),
        "orders": (
            "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate date, o_orderstatus string",
            [(o, r.randrange(40), r.choice(["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]), day(0), "F") for o in range(1, 401)],
        ),
        "lineitem": (
            "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, "
            "l_returnflag string, l_linestatus string, l_shipdate date", lines,
        ),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{top}/{name}.parquet")
    return str(top)


def twin(folder, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in ("region", "nation", "customer", "orders", "lineitem"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    found = connection.execute(load()[name].sql)
    columns = [d[0] for d in found.description]
    return sorted(str(sorted(zip(columns, row))) for row in found.fetchall())


def same_as_twin(spark, folder, name):
    got = [str(sorted(r.asDict().items())) for r in load()[name].run(spark, folder).collect()]
    assert got and sorted(got) == twin(folder, name)


def writes(spark, folder, monkeypatch, name):
    """Plans of what a query stores, without adaptive changes and without broadcasts by size."""
    plans = []
    monkeypatch.setattr(alerts, "stored", lambda df, old=alerts.stored: plans.append(df._jdf.queryExecution().executedPlan().toString()) or old(df))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        load()[name].run(spark, folder)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return plans


def test_created_events_shuffle_lines_once(spark, folder, monkeypatch):
    """After lines have met their order, neither their history nor the rules shuffle them."""
    (plan, *_) = writes(spark, folder, monkeypatch, "created_events")
    after = plan[: plan.index("SortMergeJoin [l_orderkey")]
    assert "Window" in after and "BroadcastHashJoin" in after and "Exchange hashpartitioning" not in after
    same_as_twin(spark, folder, "created_events")


def test_gathered_rules_match_as_joined_ones(spark, folder):
    t = Bound(spark, folder)
    rows = lambda df: sorted(str(r) for r in df.select("rule_name", "external_id", "start_date").collect())
    for rules in (alerts.rules(t), make_rules(spark, [{"rule_name": "none", "enabled": False}])):
        assert rows(ma.match_rules(t.listings, rules, t.locations, gathered=True)) == rows(ma.match_rules(t.listings, rules, t.locations))


def checkpoints(spark):
    """Folders of rows that were checkpointed whole."""
    return sorted(str(p) for p in Path(spark.conf.get("spark.checkpoint.dir")).glob("**/rdd-*"))


def test_event_types_store_matches_as_a_narrow_table(spark, folder, monkeypatch):
    tables, before = [], checkpoints(spark)
    monkeypatch.setattr(alerts, "stored", lambda df, old=alerts.stored: tables.append(old(df)) or tables[-1])
    same_as_twin(spark, folder, "event_types")
    assert checkpoints(spark) == before and len(tables) == 1
    assert not {"allowed_islands", "include_keywords", "intro", "url", "house_type"} & set(tables[0].columns)


def test_latest_prior_event_keeps_of_a_log_row_only_its_event(spark, folder, monkeypatch):
    """A match that is not its order's latest line is stored without the columns of its listing and its rule."""
    tables = []
    monkeypatch.setattr(alerts, "stored", lambda df, old=alerts.stored: tables.append(old(df)) or tables[-1])
    same_as_twin(spark, folder, "latest_prior_event")
    event = {"external_id", "rule_name", "last", "alert_fingerprint", "created_at", "event_id"}
    rest = [c for c in tables[0].columns if c not in event]
    assert rest and tables[0].where("NOT last").count() > 100
    assert tables[0].where(f"NOT last AND coalesce({', '.join(f'CAST({c} AS STRING)' for c in rest)}) IS NOT NULL").count() == 0


def test_created_events_from_parts_store_the_log_once(spark, folder):
    """Parts are written from the stored log as it is, not from another copy of it."""
    before = checkpoints(spark)
    same_as_twin(spark, folder, "created_events_from_parts")
    assert checkpoints(spark) == before
