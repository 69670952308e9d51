"""Keyed state with timers: one batch, many batches and a restart give the same; silence is judged by the timer."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row

from listing_lifecycle_spark.streaming import keyed
from listing_lifecycle_spark.streaming.keyed import LatestStates, keep_states, keyed_states, merged_spans
from listing_lifecycle_spark.workload import streams
from listing_lifecycle_spark.workload.catalog import load

DDL = "external_id string, content_hash string, observed_at timestamp_ntz, reported_at timestamp_ntz, tie bigint"
START = datetime(2026, 1, 1)


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", keyed.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def sightings():
    r = random.Random(5)
    out = []
    for n in range(160):
        key = f"k{r.randrange(8)}"
        reported = START + timedelta(hours=3 * n)
        if key == "k0" and n > 40:
            key = "k1"  # k0 falls silent
        out.append((key, f"h{r.randrange(3)}", reported - timedelta(hours=r.choice([0, 0, 5, 100])), reported, n))
    return out


def plain(rows, gap, silence, delay):
    """Every listing at the end, from all its rows at once."""
    clock, out = max(r[3] for r in rows) - delay, {}
    for key in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == key)
        times = sorted(r[2] for r in own)
        appearances = 1 + sum(b - a >= gap for a, b in zip(times, times[1:]))
        content = max((r[2], r[4], r[1]) for r in own)[2]
        missing = max(r[3] for r in own) + silence <= clock
        out[key] = (content, times[0], times[-1], appearances, len(own), "missing_confirmed" if missing else "active")
    return out


@pytest.mark.parametrize("cuts", [[160], [30, 50, 1, 79]])
def test_any_batches_and_a_restart(spark, tmp_path, rocksdb, cuts):
    rows, at = sightings(), 0
    gap, silence = timedelta(hours=30), timedelta(hours=60)
    sink = LatestStates(str(tmp_path / "states"))
    for size in cuts:  # each file is a start of its own: state and timers come back from the checkpoint
        spark.createDataFrame(rows[at : at + size], DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "source"))
        at += size
        stream = spark.readStream.schema(DDL).parquet(str(tmp_path / "source"))
        keep_states(keyed_states(stream, gap=gap, silence=silence), sink, checkpoint=str(tmp_path / "progress")).awaitTermination()
    got = {r.external_id: (r.content_hash, r.first_seen_at, r.last_seen_at, r.appearance_sequence, r.sightings, r.status) for r in sink.read(spark).collect()}
    want = plain(rows, gap, silence, timedelta(hours=1))
    assert got == want and want["k0"][-1] == "missing_confirmed" and {v[-1] for v in want.values()} == {"active", "missing_confirmed"}


def test_spans():
    assert merged_spans([5, 1, 30], [6, 2, 31], 10) == ([1, 30], [6, 31])
    assert merged_spans([1, 11], [1, 11], 10) == ([1, 11], [1, 11]) and merged_spans([1, 10], [1, 10], 10) == ([1], [10])
    assert merged_spans([], [], 10) == ([], [])


class Store:
    """A state store that counts what is asked of it."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name == "exists":
                return self.value is not None
            if name == "get":
                return self.value
            if name == "update":
                self.value = args[0]
            else:
                (self.timers.add if name == "registerTimer" else self.timers.remove)(*args)

        return call


def test_a_listing_costs_few_calls_to_the_store():
    """Rows come as they are, without a frame for each listing; the state is asked for once and written once."""
    store, processor = Store(), keyed.ListingProcessor(timedelta(days=3), timedelta(days=4))
    processor.init(store)
    row, day = Row("content_hash", "tie", "reported_ms", "observed_us"), 86_400_000
    first = list(processor.handleInputRows(("k",), iter([row("a", 1, 5 * day, 5000 * day), row("b", 2, 6 * day, 1000 * day)]), None))
    assert store.calls == 3 and store.timers == {10 * day}
    second = list(processor.handleInputRows(("k",), iter([row("c", 3, 7 * day, 4000 * day)]), None))
    assert store.calls == 7 and store.timers == {11 * day}
    (silent,) = processor.handleExpiredTimer(("k",), None, None)
    assert [tuple(r) for r in (*first, *second, silent)] == [
        ("k", 1, "a", 1000 * day, 5000 * day, 2, 2, "active"), ("k", 2, "a", 1000 * day, 5000 * day, 2, 3, "active"), ("k", 3, "a", 1000 * day, 5000 * day, 2, 3, "missing_confirmed"),
    ]


def test_parts_of_several_files_give_the_same(spark, tmp_path, monkeypatch):
    """Where there are many sightings a part is written by several tasks."""
    duckdb = pytest.importorskip("duckdb")
    r, path = random.Random(2), str(tmp_path / "events.parquet")
    rows = [(n, datetime(2024, 1, 1) + timedelta(hours=n), r.randrange(9), r.choice(["view", "click"]), float(r.randrange(200))) for n in range(300)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double").repartition(4).write.parquet(path)
    monkeypatch.setattr(streams, "PART_ROWS", 40)
    folders = []
    monkeypatch.setattr(streams, "shared_folder", lambda s, old=streams.shared_folder: folders.append(str(tmp_path / "shared")) or folders[-1])
    found = load()["streamed_appearances"]
    got = sorted(str(sorted(x.asDict().items())) for x in found.run(spark, str(tmp_path)).collect())
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    want = connection.execute(found.sql)
    columns = [d[0] for d in want.description]
    assert got == sorted(str(sorted(zip(columns, x))) for x in want.fetchall()) and len(got) == 18
    assert len(list((tmp_path / "shared").glob("keyed-*/source/part-*"))) > 3
