"""Maps used as filters: containment, overlays, keys for joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_contains(whole: Column, part: Column) -> Column:
    """Every pair of ``part`` is in ``whole``; an empty map is in every map."""
    return F.forall(
        F.map_entries(part), lambda pair: F.try_element_at(whole, pair["key"]).eqNullSafe(pair["value"])
    )


def canonical(filter_map: Column) -> Column:
    """Map as text with sorted keys: equal text means equal map, which makes maps joinable."""
    return F.to_json(F.array_sort(F.map_entries(filter_map)))


def pair_texts(filter_map: Column) -> Column:
    """The pairs of a map as texts, which makes single pairs joinable."""
    return F.transform(F.map_entries(filter_map), lambda pair: F.to_json(pair))


def containing(parts: DataFrame, wholes: DataFrame, *, part: str, whole: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``wholes`` with each row of ``parts`` whose map is contained in theirs, among equal values of ``by``.

    A part is looked up by its rarest pair only, among the pairs that the wholes have, and the other pairs are tested on
    the rows found; so the work follows the rarest pairs, whatever the number of keys.  An empty part is in every whole.
    Other columns of the two sides must have different names.
    """
    pairs = wholes.withColumn("_pair", F.explode(pair_texts(F.col(whole))))
    counts = pairs.groupBy(*by, "_pair").agg(F.count(F.lit(1)).alias("_times"))
    own = parts.withColumn("_part_pairs", pair_texts(F.col(part)))
    names = [c for c in parts.columns if c not in by]
    each = own.select(*by, F.struct(*names, "_part_pairs").alias("_row"), F.explode("_part_pairs").alias("_pair"))
    # A pair that no whole has rules its part out; of the others the rarest is taken.
    known = each.join(counts, [*by, "_pair"], "left")
    key = F.xxhash64(*by, F.to_json("_row")) if by else F.xxhash64(F.to_json("_row"))
    rarest = known.groupBy(*by, key.alias("_key"), F.to_json("_row").alias("_text")).agg(
        F.min_by(F.struct("_row", "_pair"), F.struct(F.coalesce("_times", F.lit(0)), "_pair")).alias("_best")
    )
    looked_up = rarest.select(*by, F.col("_best._pair").alias("_pair"), *[F.col(f"_best._row.{c}").alias(c) for c in [*names, "_part_pairs"]])
    found = pairs.join(looked_up, [*by, "_pair"])
    found = found.where(F.size(F.array_except("_part_pairs", pair_texts(F.col(whole)))) == 0).drop("_pair", "_part_pairs")
    empty = parts.where(F.size(part) == 0)
    everywhere = wholes.join(empty, list(by)) if by else wholes.join(F.broadcast(empty))
    columns = [*wholes.columns, *names]
    return found.select(*columns).union(everywhere.select(*columns))


def overlay(defaults: Column, overrides: Column) -> Column:
    """Defaults with overrides on top; a key that is present wins even when its value is null."""
    kept = F.map_filter(defaults, lambda key, _: ~F.map_contains_key(overrides, key))
    return F.map_concat(kept, overrides)


def with_pair(filter_map: Column, key: str, value: Column) -> Column:
    """Filter map with one more (or replaced) pair."""
    return overlay(filter_map, F.create_map(F.lit(key), value))


def valid_channels(channels: Column) -> Column:
    """A channel list is non-empty, has no blank entry and no entry twice."""
    return F.coalesce(
        (F.size(channels) > 0)
        & F.forall(channels, lambda c: F.coalesce(F.trim(c) != "", F.lit(False)))
        & (F.size(F.array_distinct(channels)) == F.size(channels)),
        F.lit(False),
    )
