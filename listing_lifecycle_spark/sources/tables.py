"""Reading and writing listing tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listing_lifecycle_spark import fixed_values as fv

PERSISTED_COLUMNS = ["id", *fv.LISTING_SCHEMA, *fv.LIFECYCLE_SCHEMA]


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Listing snapshot; only the columns a query uses are read."""
    return spark.read.parquet(path)


def read_source_of_truth(
    spark: SparkSession,
    *,
    path: str | None = None,
    jdbc_options: dict[str, str] | None = None,
    id_bounds: tuple[int, int] | None = None,
    partitions: int = 64,
) -> DataFrame:
    """The persisted listing columns, from parquet or in parallel id ranges over JDBC."""
    if path is not None:
        rows = spark.read.parquet(path)
    else:
        reader = spark.read.format("jdbc").options(**(jdbc_options or {}))
        if id_bounds is not None:
            low, high = id_bounds
            reader = reader.options(
                partitionColumn="id", lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions)
            )
        rows = reader.load()
    return rows.select(*PERSISTED_COLUMNS)


def complete_columns(df: DataFrame) -> DataFrame:
    """All persisted columns in order; those not given become typed nulls."""
    types = {"id": "bigint", **fv.LISTING_SCHEMA, **fv.LIFECYCLE_SCHEMA}
    return df.select(
        *[
            (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in types.items()
        ]
    )


def snapshot_metadata(snapshot: DataFrame, *, source: str, refreshed_at: str) -> DataFrame:
    """Key/value description of a snapshot."""
    counted = snapshot.agg(F.count(F.lit(1)).cast("string").alias("n"))
    return counted.select(
        F.inline(
            F.array(
                F.struct(F.lit("source").alias("key"), F.lit(source).alias("value")),
                F.struct(F.lit("listing_count").alias("key"), F.col("n").alias("value")),
                F.struct(F.lit("refreshed_at").alias("key"), F.lit(refreshed_at).alias("value")),
            )
        )
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Rows as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append_log(df: DataFrame, path: str, *, date_column: str) -> None:
    """Append to a log that is partitioned by the day of ``date_column``."""
    daily = df.withColumn("log_date", F.to_date(date_column))
    daily.write.mode("append").partitionBy("log_date").parquet(path)


def absent_from_log(new_rows: DataFrame, log: DataFrame, key: list[str]) -> DataFrame:
    """New rows whose key the log does not hold yet, one per key."""
    return new_rows.dropDuplicates(key).join(log.select(*key), key, "left_anti")


def as_json(df: DataFrame, *, keep: list[str] | None = None) -> DataFrame:
    """Rows as one JSON column, null fields included."""
    columns = [c for c in df.columns if c not in (keep or [])]
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json")
    return df.select(*(keep or []), text)


def from_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Listing rows from their JSON form; dates are ISO text."""
    schema = ", ".join(f"{name} {kind}" for name, kind in fv.LISTING_SCHEMA.items())
    keep = [c for c in df.columns if c != column]
    return df.withColumn("_row", F.from_json(column, schema)).select(*keep, "_row.*")


def all_of(conditions: list[Column]) -> Column:
    """Conjunction; true when there is no condition."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
