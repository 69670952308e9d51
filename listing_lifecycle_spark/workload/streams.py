"""Streaming operators over the event table, read as a file stream until it is used up."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from listing_lifecycle_spark import fixed_values as fv
from listing_lifecycle_spark.operators import lifecycle
from listing_lifecycle_spark.plans.persist import EVENT_LOG_TYPES
from listing_lifecycle_spark.session import cut_lineage, shared_folder
from listing_lifecycle_spark.sources.rules import make_rules
from listing_lifecycle_spark.sources.tables import write_csv
from listing_lifecycle_spark.sources.versions import VersionedTables, changed_buckets
from listing_lifecycle_spark.streaming import deliveries, keyed, periods, runs, state
from listing_lifecycle_spark.workload.alerts import alert_events, order_cards
from listing_lifecycle_spark.workload.bindings import SQL, with_views
from listing_lifecycle_spark.workload.catalog import query


def event_stream(t):
    """The events as a stream; a folder per query holds its progress."""
    schema = t.table("events").schema
    stream = t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{t.sf_dir}/events*.parquet")
    return stream, f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


def observed(stream):
    return stream.select(
        F.concat_ws("-", "event_type", "user_id").alias("external_id"),
        F.sha2(F.floor(F.col("value") / 50).cast("bigint").cast("string"), 256).alias("content_hash"),
        F.col("ts").alias("observed_at"),
        "event_id",
    )


@query(
    "streamed_listing_state", "STM1 STM2 STM8 UPS2",
    """SELECT external_id, content_hash, first_seen_at, last_seen_at, 'active' AS status, 1 AS appearance_sequence FROM (
      SELECT min(ts) OVER (PARTITION BY event_type, user_id) AS first_seen_at, concat(event_type, '-', user_id) AS external_id, sha256(CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR)) AS content_hash, ts AS last_seen_at,
        row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
    instants="first_seen_at last_seen_at",
)
def streamed_listing_state(t):
    stream, folder = event_stream(t)
    tables = VersionedTables(t.spark, f"{folder}/tables")
    types = "external_id string, content_hash string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, status string, missing_count int, appearance_sequence int"
    empty = t.spark.createDataFrame([], types)
    # Of two events of one instant the later id counts, so the order ends with it.
    rows = observed(stream)
    running = state.merge_stream(rows, tables, empty, checkpoint=f"{folder}/progress", order=["observed_at", "event_id"])
    running.awaitTermination()
    return tables.read("state").select("external_id", "content_hash", "first_seen_at", "last_seen_at", "status", "appearance_sequence")


@query(
    "streamed_sightings", "STM1 STM2",
    """SELECT concat(event_type, '-', user_id) AS external_id, min(ts) AS first_seen_at, max(ts) AS last_seen_at, count(*) AS sightings,
      sha256(CAST(CAST(floor(arg_max(value, event_id) FILTER (ts = last) / 50) AS BIGINT) AS VARCHAR)) AS content_hash
      FROM (SELECT *, max(ts) OVER (PARTITION BY event_type, user_id) AS last FROM events) GROUP BY event_type, user_id""",
    instants="first_seen_at last_seen_at",
)
def streamed_sightings(t):
    stream, folder = event_stream(t)

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    running = (
        state.running_state(observed(stream), ("observed_at", "event_id")).writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    updates = t.spark.read.parquet(f"{folder}/out")
    latest = updates.groupBy("external_id").agg(
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.max("sightings").alias("sightings"), F.max_by("content_hash", "sightings").alias("content_hash"),
    )
    return latest


def streamed_counts(t, unit):
    stream, folder = event_stream(t)
    sightings = stream.select(F.col("user_id").cast("string").alias("external_id"), periods.utc_instant(F.col("ts")).alias("first_seen_at"))
    sink = periods.PeriodSink(f"{folder}/pairs", unit)
    periods.count_periods(sightings, sink, checkpoint=f"{folder}/progress").awaitTermination()
    return sink.counts(t.spark)


@query(
    "streamed_week_counts", "STM7",
    "SELECT CAST(date_trunc('week', ts) AS DATE) AS period_start, count(DISTINCT user_id) AS listing_count FROM events GROUP BY 1",
    dates="period_start",
)
def streamed_week_counts(t):
    return streamed_counts(t, "week")


@query(
    "streamed_month_counts", "STM7",
    "SELECT CAST(date_trunc('month', ts) AS DATE) AS period_start, count(DISTINCT user_id) AS listing_count FROM events GROUP BY 1",
    dates="period_start",
)
def streamed_month_counts(t):
    return streamed_counts(t, "month")


@query(
    "committed_versions", "SNK1 SNK4",
    """SELECT event_id, 'log' AS part FROM events UNION ALL SELECT event_id, 'kept' FROM events WHERE event_id % 3 = 0
      UNION ALL SELECT event_id, 'replaced' FROM events WHERE event_id % 3 = 2""",
)
def committed_versions(t):
    """Three commits: a table that only the first writes, a table that each replaces, and a log that grows."""
    tables = VersionedTables(t.spark, f"{shared_folder(t.spark)}/tables-{uuid.uuid4().hex}")
    for n in range(3):
        rows = t.table("events").where(F.col("event_id") % 3 == n).select("event_id")
        for _ in range(2):  # a repeated batch is not committed again
            if not tables.has_batch(f"batch-{n}"):
                tables.commit({"replaced": rows, **({"kept": rows} if n == 0 else {})}, logs={"log": rows}, batch_key=f"batch-{n}")
    parts = [tables.read_log("log"), tables.read("kept"), tables.read("replaced")]
    named = [rows.select("event_id", F.lit(name).alias("part")) for rows, name in zip(parts, ("log", "kept", "replaced"))]
    return named[0].union(named[1]).union(named[2])


@query(
    "exported_rows", "SNK2",
    "SELECT event_id, event_type, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events",
)
def exported_rows(t):
    """Rows written as CSV and read again."""
    folder = f"{shared_folder(t.spark)}/export-{uuid.uuid4().hex}"
    rows = t.table("events").select("event_id", "event_type", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))
    write_csv(rows, folder)
    kinds = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    return t.spark.read.schema(kinds).option("header", True).csv(folder)


@query(
    "streamed_runs", "STM3 STM4 SNK3 UPS4",
    """WITH u AS (SELECT DISTINCT user_id, CAST(date_trunc('week', ts) AS DATE) AS week FROM events),
      runs AS (SELECT week, row_number() OVER (ORDER BY week) AS run FROM (SELECT DISTINCT week FROM u)),
      seen AS (SELECT DISTINCT user_id, run FROM u JOIN runs USING (week)), last AS (SELECT user_id, min(run) AS first_run, max(run) AS last_run FROM seen GROUP BY user_id)
      SELECT CAST(user_id AS VARCHAR) AS external_id, CAST(first_run AS BIGINT) AS first_seen_run_id, CAST(last_run AS BIGINT) AS last_seen_run_id,
        CAST(least((SELECT max(run) FROM runs) - last_run, 2) AS INTEGER) AS missing_count FROM last""",
)
def streamed_runs(t):
    """Users as listings, weeks as runs: a stream of sightings with a control row that completes each week."""
    return run_stream(t).read("state").select("external_id", "first_seen_run_id", "last_seen_run_id", "missing_count")


@query(
    "streamed_alerts", "STM3 STM4 EVT3 EVT4 JN13 SNK4",
    """WITH RECURSIVE u AS (SELECT DISTINCT user_id, CAST(date_trunc('week', ts) AS DATE) AS week FROM events),
      runs AS (SELECT week, row_number() OVER (ORDER BY week) AS run FROM (SELECT DISTINCT week FROM u)),
      a AS (SELECT user_id, run, CASE WHEN user_id % 3 = 1 THEN run % 2 ELSE 1 END AS print, run - lag(run) OVER w > 2 AS back, row_number() OVER w AS n
        FROM u JOIN runs USING (week) WHERE user_id % 3 > 0 WINDOW w AS (PARTITION BY user_id ORDER BY run)),
      m AS (SELECT *, 1 + CAST(count(*) FILTER (WHERE back) OVER (PARTITION BY user_id ORDER BY run) AS INTEGER) AS appearance FROM a),
      r AS (SELECT user_id, run, n, print AS prior, [appearance * 2 + print] AS known, appearance, 'first_match' AS event_type FROM m WHERE n = 1
        UNION ALL SELECT user_id, run, n, CASE WHEN e THEN print ELSE prior END, CASE WHEN e THEN list_append(known, appearance * 2 + print) ELSE known END, appearance,
          CASE WHEN NOT e THEN NULL WHEN back THEN 'confirmed_reappearance' ELSE 'material_change' END FROM (
            SELECT m.*, r.prior, r.known, m.print <> r.prior AND NOT list_contains(r.known, m.appearance * 2 + m.print) AS e FROM r JOIN m ON m.user_id = r.user_id AND m.n = r.n + 1))
      SELECT CAST(user_id AS VARCHAR) AS external_id, CAST(run AS BIGINT) AS detected_run_id, appearance AS appearance_sequence, event_type FROM r WHERE event_type IS NOT NULL""",
)
def streamed_alerts(t):
    """The events of those runs under a live rule: listings of one kind change back and forth, others stay as they are.

    What was an event before in the same appearance is none again.
    """
    rule = {"rule_name": "live", "site_filter": {}, "dogs_allowed": True, "cats_allowed": True}
    tables = run_stream(t, rules=[rule], dogs=F.when(F.col("user_id") % 3 == 1, F.col("run_id") % 2).when(F.col("user_id") % 3 == 2, 1).cast("int"), fish=F.when(F.col("user_id") % 3 == 0, 1).cast("int"))
    return tables.read_log("events").select("external_id", "detected_run_id", "appearance_sequence", "event_type")


def run_stream(t, *, rules=None, dogs=None, fish=None):
    """The tables that a stream of weekly runs leaves."""
    week = F.to_date(F.date_trunc("week", "ts"))
    weeks = t.table("events").select(week.alias("week")).distinct()
    numbered = weeks.withColumn("run_id", F.row_number().over(Window.orderBy("week")).cast("bigint"))  # a row per week
    listing = {name: F.lit(None).cast(kind) for name, kind in fv.LISTING_SCHEMA.items()}
    listing |= {"external_id": F.col("user_id").cast("string"), "title": F.lit("t"), "region": F.lit("Auckland"), "island": F.lit("North Island")}
    if rules:
        listing |= {"dogs_count": dogs, "fish_count": fish, "total_animals": F.lit(1)}
    dated = t.table("events").withColumn("week", week).join(numbered, "week")
    seen = dated.select(*[c.alias(n) for n, c in listing.items()], F.col("ts").alias("observed_at"), F.lit("listing").alias("kind"), "run_id", F.lit(None).cast("timestamp_ntz").alias("completed_at"))
    blank = {n: F.lit(None).cast(k) for n, k in fv.LISTING_SCHEMA.items()}
    done = numbered.select(*[c.alias(n) for n, c in blank.items()], F.lit(None).cast("timestamp_ntz").alias("observed_at"), F.lit("complete").alias("kind"), "run_id",
                           F.date_add("week", 7).cast("timestamp_ntz").alias("completed_at"))
    rows = seen.union(done).withColumn("scope_name", F.lit("all"))
    folder = f"{shared_folder(t.spark)}/runs-{uuid.uuid4().hex}"
    rows.repartition(3, "run_id").write.parquet(f"{folder}/source")
    scope_types = "name string, enabled boolean, site_filter map<string,string>, interval_minutes int, missing_threshold_runs int, last_success_at timestamp_ntz"
    empty = {
        "state": t.spark.createDataFrame([], ", ".join(f"{n} {k}" for n, k in {**fv.LISTING_SCHEMA, **fv.LIFECYCLE_SCHEMA}.items())),
        "events": t.spark.createDataFrame([], EVENT_LOG_TYPES), "scopes": t.spark.createDataFrame([("all", True, {}, 5, 2, None)], scope_types),
    }
    tables = VersionedTables(t.spark, f"{folder}/tables")
    sink = runs.RunSink(
        tables, empty, rules=make_rules(t.spark, rules or [{"rule_name": "none", "enabled": False}]), locations=t.locations, listing_columns=list(fv.LISTING_SCHEMA),
        scope_of=lambda control: lifecycle.RunScope(control["scope_name"], missing_threshold=2),
    )
    stream = t.spark.readStream.schema(rows.schema).parquet(f"{folder}/source")
    runs.apply_runs(stream, sink, checkpoint=f"{folder}/progress").awaitTermination()
    return tables


PART_ROWS = 1_000_000  # sightings in a file


@query(
    "streamed_appearances", "STM1 STM2 UPS4",
    """WITH o AS (SELECT concat(event_type, '-', user_id) AS external_id, ts, ts - to_days(CAST(event_id % 5 AS INTEGER)) AS observed_at, event_id, value FROM events),
      g AS (SELECT *, CASE WHEN observed_at - lag(observed_at) OVER (PARTITION BY external_id ORDER BY observed_at) < INTERVAL 3 DAY THEN 0 ELSE 1 END AS opens FROM o)
      SELECT external_id, sha256(CAST(CAST(floor(arg_max(value, struct_pack(a := observed_at, b := event_id)) / 50) AS BIGINT) AS VARCHAR)) AS content_hash,
        min(observed_at) AS first_seen_at, max(observed_at) AS last_seen_at, CAST(sum(opens) AS INTEGER) AS appearance_sequence, count(*) AS sightings,
        CASE WHEN epoch_ms(max(ts)) + 4 * 86400000 <= (SELECT epoch_ms(max(ts)) FROM events) - 3600000 THEN 'missing_confirmed' ELSE 'active' END AS status
      FROM g GROUP BY external_id""",
    instants="first_seen_at last_seen_at",
)
def streamed_appearances(t):
    """Sightings that reach the stream up to four days late, in three parts one after the other, with state by listing.

    A part is one file, or several where there are many sightings, each written by a task of its own.
    """
    folder = f"{shared_folder(t.spark)}/keyed-{uuid.uuid4().hex}"
    late = F.col("ts") - F.make_dt_interval(days=(F.col("event_id") % 5).cast("int"))
    rows = t.table("events").select(
        F.concat_ws("-", "event_type", "user_id").alias("external_id"), F.sha2(F.floor(F.col("value") / 50).cast("bigint").cast("string"), 256).alias("content_hash"),
        late.alias("observed_at"), F.col("ts").alias("reported_at"), F.col("event_id").alias("tie"),
    )
    third = F.ntile(3).over(Window.orderBy("day"))
    days = rows.select(F.to_date("reported_at").alias("day")).distinct().withColumn("part", third)  # a row per day
    parts = rows.withColumn("day", F.to_date("reported_at")).join(days, "day").drop("day")
    files = 1 + rows.count() // (3 * PART_ROWS)
    for part in (1, 2, 3):
        parts.where(F.col("part") == part).drop("part").coalesce(files).write.mode("append").parquet(f"{folder}/source")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(provider, None)
    t.spark.conf.set(provider, keyed.ROCKSDB)
    try:
        stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/source")
        sink = keyed.LatestStates(f"{folder}/states")
        states = keyed.keyed_states(stream, gap=timedelta(days=3), silence=timedelta(days=4))
        keyed.keep_states(states, sink, checkpoint=f"{folder}/progress").awaitTermination()
    finally:
        t.spark.conf.unset(provider) if before is None else t.spark.conf.set(provider, before)
    return sink.read(t.spark).select("external_id", "content_hash", "first_seen_at", "last_seen_at", "appearance_sequence", "sightings", "status")


TICKS = [f"2024-01-10 {clock}:00" for clock in ("10:50", "12:00", "17:30", "18:00", "19:00")]


@query(
    "retried_deliveries", "STM5 EVT5 EVT6 EVT7 JN6",
    with_views("places", "order_card", body="""SELECT event_id, channel, len(tries) AS chances, CASE WHEN channel = 'email' THEN 0 ELSE least(len(tries), needed) END AS attempts,
        channel = 'telegram' AND needed <= len(tries) AS sent, CASE WHEN channel = 'telegram' THEN tries[least(len(tries), needed)] END AS last_attempt FROM (
      SELECT event_id, unnest(CASE WHEN event_type = 'click' THEN ['telegram', 'email'] ELSE ['telegram'] END) AS channel, 1 + event_id % 4 AS needed,
        CASE WHEN ts <= TIMESTAMP '2024-01-10 10:50:00' THEN ['10:50', '17:30', '19:00'] WHEN ts <= TIMESTAMP '2024-01-10 12:00:00' THEN ['12:00', '17:30', '19:00']
          WHEN ts <= TIMESTAMP '2024-01-10 17:30:00' THEN ['17:30', '18:00', '19:00'] WHEN ts <= TIMESTAMP '2024-01-10 18:00:00' THEN ['18:00', '19:00'] ELSE ['19:00'] END AS tries
      FROM events JOIN order_card ON external_id = CAST(user_id AS VARCHAR) WHERE ts <= TIMESTAMP '2024-01-10 19:00:00')"""),
)
def retried_deliveries(t):
    """Five ticks over the alerts so far; an alert needs up to four attempts, and quiet hours (in Auckland) put retries off."""
    folder = f"{shared_folder(t.spark)}/deliveries-{uuid.uuid4().hex}"
    tables = VersionedTables(t.spark, f"{folder}/tables")
    names = [{"rule_name": r.event_type} for r in t.table("events").select("event_type").distinct().collect()]  # a rule for each kind of event
    tables.commit({"state": order_cards(t)}, logs={"events": alert_events(t).drop("value")})

    def send(routed):
        return routed.select("event_id", "channel", (F.col("attempts") >= F.col("event_id") % 4).alias("sent"), F.lit("no answer").alias("error_message"))

    sink = deliveries.DeliverySink(tables, make_rules(t.spark, names), t.spark.createDataFrame([("telegram",)], "channel string"), send, retry_minutes=30)
    for tick in TICKS:
        t.spark.range(1).select(F.lit(tick).cast("timestamp_ntz").alias("now")).coalesce(1).write.mode("append").parquet(f"{folder}/ticks")
    ticks = t.spark.readStream.schema("now timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{folder}/ticks")
    deliveries.deliver_on_ticks(ticks, sink, checkpoint=f"{folder}/progress").awaitTermination()
    tried = tables.read_log("attempts").groupBy("event_id", "channel").agg(
        F.count(F.lit(1)).alias("attempts"), F.bool_or(F.col("status") == "sent").alias("sent"), F.date_format(F.max("attempted_at"), "HH:mm").alias("last_attempt"),
    )
    targets = alert_events(t).where(F.col("deliver_after") <= F.lit(TICKS[-1]).cast("timestamp_ntz")).join(order_cards(t).select("external_id"), "external_id")
    targets = targets.select("event_id", "deliver_after", F.explode("target_channels").alias("channel"))
    rows = targets.join(tried, ["event_id", "channel"], "left")
    chances = F.when(F.col("deliver_after") <= F.lit(TICKS[2]).cast("timestamp_ntz"), 3).when(F.col("deliver_after") <= F.lit(TICKS[3]).cast("timestamp_ntz"), 2).otherwise(1)
    return rows.select("event_id", "channel", chances.cast("bigint").alias("chances"), F.coalesce("attempts", F.lit(0).cast("bigint")).alias("attempts"), F.coalesce("sent", F.lit(False)).alias("sent"), "last_attempt")


@query(
    "version_differences", "SNK1 SNK3 STM8",
    """SELECT CAST(o_orderkey AS VARCHAR) AS external_id, CASE WHEN o_orderstatus = 'O' THEN 'inserted' WHEN o_orderkey % 13 = 0 THEN 'removed' ELSE 'changed' END AS change FROM orders
      WHERE (o_orderstatus = 'O' AND o_orderkey % 31 = 0) OR (o_orderstatus <> 'O' AND (o_orderkey % 13 = 0 OR o_orderkey % 50 = 0))""",
)
def version_differences(t):
    """Two versions of a table in buckets; only buckets that the second has written are compared."""
    tables = VersionedTables(t.spark, f"{shared_folder(t.spark)}/buckets-{uuid.uuid4().hex}")
    key = F.col("o_orderkey")
    rows = t.table("orders").select(key.cast("string").alias("external_id"), key, "o_orderstatus", "o_totalprice")
    old = rows.where("o_orderstatus <> 'O'")
    first = tables.commit(buckets={"orders": changed_buckets(cut_lineage(old), "external_id", F.lit(True), 64)})
    new = F.coalesce((F.col("o_orderstatus") == "O") & (key % 31 == 0), F.lit(False))
    gone, other = (F.col("o_orderstatus") != "O") & (key % 13 == 0), key % 50 == 0
    marked = rows.where((F.col("o_orderstatus") != "O") | new).withColumns({"gone": gone, "moved": new | gone | other, "o_totalprice": F.when(other, 0.0).otherwise(F.col("o_totalprice"))})
    changed = changed_buckets(cut_lineage(marked), "external_id", F.col("moved"), 64).where("NOT gone").drop("gone", "moved")
    second = tables.commit(buckets={"orders": changed})
    return tables.differences("orders", first, second, "external_id").select("external_id", "change")
