"""Joins with a dimension, and the latest row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_dimension(large: DataFrame, small: DataFrame, on: list[str], *, spread_by: str, slices: int = 1) -> DataFrame:
    """Inner equality join of a large side with one that is expected, but not known, to be small.

    No job is run and no hint is given: sizes at run time decide between a
    broadcast and a shuffle, and adaptive execution splits hot keys of a shuffle.
    Where that is off, ``slices`` cuts the large side by a hash of ``spread_by``
    and repeats the other side, so that a hot key is handled by so many tasks.
    """
    if slices <= 1:
        return large.join(small, on, "inner")
    cut = large.withColumn("_slice", F.pmod(F.xxhash64(spread_by), F.lit(slices)).cast("int"))
    repeated = small.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return cut.join(repeated, [*on, "_slice"], "inner").drop("_slice")


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the greatest by ``order``.

    An aggregation with partial results on the map side, so a key that holds a
    large share of the rows is reduced before anything is shuffled (a ranking
    window would send all its rows to one task).
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*order, *rest)
    return (
        df.groupBy(*keys)
        .agg(F.max_by(row, F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col("_row")[c].alias(c) for c in [*order, *rest]])
        .select(*df.columns)
    )
