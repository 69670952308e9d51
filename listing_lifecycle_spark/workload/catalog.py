"""Registry of bound queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listing_lifecycle_spark.workload.bindings import Bound


@dataclass(frozen=True)
class BoundQuery:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


CATALOG: dict[str, BoundQuery] = {}


def plain(df: DataFrame) -> DataFrame:
    """Values that compare equal across engines: days and instants as text, doubles to six places."""

    def column(name: str, kind: str):
        if kind == "date":
            return F.col(name).cast("string").alias(name)
        if kind in ("timestamp", "timestamp_ntz"):
            return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)
        if kind in ("double", "float"):
            return F.round(name, 6).alias(name)
        return F.col(name)

    return df.select(*[column(name, kind) for name, kind in df.dtypes])


def query(name: str, covers: str, sql: str | None = None, *, dates: str = "", instants: str = ""):
    """Register ``fn(bound) -> DataFrame`` with the inventory entries it covers and its SQL twin.

    ``dates`` and ``instants`` name the columns that the SQL side turns into text.
    """
    casts = [f"CAST({c} AS VARCHAR) AS {c}" for c in dates.split()]
    casts += [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in instants.split()]
    if sql and casts:
        sql = f"SELECT * REPLACE ({', '.join(casts)}) FROM (\n{sql}\n)"

    def register(fn: Callable[[Bound], DataFrame]):
        if name in CATALOG:
            raise ValueError(f"query registered twice: {name}")
        CATALOG[name] = BoundQuery(lambda spark, sf_dir: plain(fn(Bound(spark, sf_dir))), sql, tuple(covers.split()))
        return fn

    return register


def load() -> dict[str, BoundQuery]:
    """All queries."""
    from listing_lifecycle_spark.workload import alerts, analytics, extraction, lifecycle, quality, streams  # noqa: F401

    return CATALOG
