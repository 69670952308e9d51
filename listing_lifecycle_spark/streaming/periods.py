"""Calendar counts over a stream of first sightings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from listing_lifecycle_spark.session import cut_lineage
from listing_lifecycle_spark.sources.versions import BUCKETS, VersionedTables, bucket_of

# The epoch was a Thursday; windows of 7 days that start 4 days later start on Mondays.
MONDAY_OFFSET = "4 days"
_OFFSET_SECONDS, _WEEK_SECONDS = 4 * 86400, 7 * 86400


def utc_instant(wall_clock: Column) -> Column:
    """Zone-less UTC time as the timestamp that watermarks need, whatever the session zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), wall_clock).cast("timestamp")


def utc_day(moment: Column) -> Column:
    """Day of an instant in UTC."""
    return F.to_date(F.convert_timezone(F.current_timezone(), F.lit("UTC"), moment.cast("timestamp_ntz")))


def closed_week_counts(sightings: DataFrame, *, delay_days: int = 7) -> DataFrame:
    """Distinct listings per week (Monday start), each week emitted once, when it is closed (append mode).

    For consumers that want a week once and final.  Weeks still open are not
    emitted, and rows later than ``delay_days`` are not counted: :class:`PeriodSink`
    has every week and every row.  A listing is counted once per week, for which
    the delay must reach over a week.
    """
    if delay_days < 7:
        raise ValueError("a delay of less than 7 days would count a listing twice")
    timed = sightings.withWatermark("first_seen_at", f"{delay_days} days")
    week = F.floor((F.unix_seconds("first_seen_at") - _OFFSET_SECONDS) / _WEEK_SECONDS)
    once = timed.withColumn("week", week).dropDuplicatesWithinWatermark(["external_id", "week"])
    return (
        once.groupBy(F.window("first_seen_at", "7 days", startTime=MONDAY_OFFSET))
        .agg(F.count(F.lit(1)).alias("listing_count"))
        .select(utc_day(F.col("window.start")).alias("period_start"), "listing_count")
    )


class PeriodSink:
    """Micro-batch writer for exact counts of distinct listings per week or month.

    Listings get dense numbers as they first appear, and a period is a row of bits
    by listing number, cut into pieces of 32,768.  A batch sets bits, so a
    listing that is seen again adds nothing: the state grows with listings and
    periods, not with rows or batches, and a count is a count of bits.  Of both
    tables only the buckets are read and written that a batch touches; a batch
    that was committed before changes nothing.  No row is too late.
    """

    def __init__(self, folder: str, unit: str = "week", *, buckets: int = BUCKETS):
        if unit not in ("week", "month"):
            raise ValueError(f"unknown period: {unit}")
        self.folder, self.unit, self.buckets = folder.rstrip("/"), unit, buckets

    def _known(self, tables: VersionedTables, table: str, rows: DataFrame, types: str) -> DataFrame:
        """What a table holds in the buckets of ``rows``."""
        own = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
        found = tables.read_buckets(table, own)
        return tables.spark.createDataFrame([], types) if found is None else found

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        tables = VersionedTables(batch.sparkSession, self.folder)
        key = f"batch-{batch_id}"
        if tables.has_batch(key):
            return
        start = F.to_date(F.date_trunc(self.unit, utc_day(F.col("first_seen_at"))))
        place = bucket_of(F.col("external_id"), self.buckets)
        pairs = batch.where("external_id IS NOT NULL").select("external_id", start.alias("period_start"), place.alias("bucket"))
        pairs = cut_lineage(pairs.distinct())
        if pairs.isEmpty():
            return
        last = tables.read("last_number")
        known = self._known(tables, "numbers", pairs, "external_id string, number bigint")
        fresh = pairs.select("external_id", "bucket").distinct().join(known, "external_id", "left_anti")
        fresh, highest = numbered(fresh, 0 if last is None else last.first()["number"])
        numbers = cut_lineage(known.withColumn("bucket", place).unionByName(fresh))
        number = F.col("number")
        bits = pairs.join(numbers.select("external_id", "number"), "external_id").groupBy(
            "period_start", F.bitmap_bucket_number(number).alias("piece")
        ).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
        bits = cut_lineage(bits.withColumn("bucket", bucket_of(F.col("period_start"), self.buckets)))
        before = self._known(tables, "bits", bits, "period_start date, piece bigint, bits binary")
        merged = before.union(bits.drop("bucket")).groupBy("period_start", "piece").agg(F.bitmap_or_agg("bits").alias("bits"))
        placed = merged.withColumn("bucket", bucket_of(F.col("period_start"), self.buckets))
        now = tables.spark.createDataFrame([(highest,)], "number bigint")
        tables.commit({"last_number": now}, buckets={"numbers": numbers, "bits": placed}, batch_key=key)

    def counts(self, spark: SparkSession) -> DataFrame:
        """Distinct listings of each period so far, open ones included."""
        bits = VersionedTables(spark, self.folder).read("bits")
        if bits is None:
            return spark.createDataFrame([], "period_start date, listing_count bigint")
        return bits.groupBy("period_start").agg(F.sum(F.bitmap_count("bits")).alias("listing_count"))


def numbered(rows: DataFrame, after: int) -> tuple[DataFrame, int]:
    """``rows`` with dense numbers from ``after`` + 1 on, and the highest; each partition counts on from the ones before it."""
    parted = cut_lineage(rows.withColumn("part", F.spark_partition_id()))
    sizes = {r["part"]: r["count"] for r in parted.groupBy("part").count().collect()}  # one entry for each partition
    begin, offsets = after, []
    for part in sorted(sizes):
        offsets.append((part, begin))
        begin += sizes[part]
    first = rows.sparkSession.createDataFrame(offsets, "part int, before bigint")
    place = F.row_number().over(Window.partitionBy("part").orderBy(rows.columns[0]))
    return parted.withColumn("place", place).join(first, "part").withColumn("number", F.col("before") + F.col("place")).drop("part", "place", "before"), begin


def count_periods(sightings: DataFrame, sink: PeriodSink, *, checkpoint: str) -> StreamingQuery:
    """Start counting the sightings that are available; resumes from ``checkpoint`` after a stop."""
    return sightings.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
