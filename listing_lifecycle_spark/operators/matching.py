"""Matching listings with alert rules.

Every predicate is two-valued: a missing value fails a limit that is set and
never makes a row disappear by itself.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from listing_lifecycle_spark import fixed_values as fv
from listing_lifecycle_spark.functions.joins import join_dimension
from listing_lifecycle_spark.functions.text import fold_case
from listing_lifecycle_spark.operators.lifecycle import covered_by
from listing_lifecycle_spark.operators.rule_index import matched
from listing_lifecycle_spark.sources.rules import resolved_rules
from listing_lifecycle_spark.sources.tables import all_of


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def at_least(value: Column, bound: Column) -> Column:
    """Lower limit, if set."""
    return bound.isNull() | _sure(value >= bound)


def at_most(value: Column, bound: Column) -> Column:
    """Upper limit, if set."""
    return bound.isNull() | _sure(value <= bound)


def allowed(value: Column, values: Column) -> Column:
    """Allow-list: null allows all, an empty list nothing."""
    return values.isNull() | _sure(F.array_contains(values, value))


def not_excluded(value: Column, values: Column) -> Column:
    """Deny-list."""
    return ~_sure(F.array_contains(values, value))


def sit_length_in(days: Column, code: Column) -> Column:
    """Whether the days lie in the range of a search code, if one is set."""
    ranges = F.lit(False)
    for name, (low, high) in fv.SIT_LENGTH_CODES.items():
        inside = (days >= low) if high is None else days.between(low, high)
        ranges = F.when(code == name, _sure(inside)).otherwise(ranges)
    return code.isNull() | ranges


def in_date_window(start: Column, end: Column, mode: Column, not_before: Column, not_after: Column) -> Column:
    """A stay lies within the window (``contained``, the default) or touches it (``overlaps``)."""
    overlaps = F.coalesce(mode, F.lit("contained")) == "overlaps"
    first, last = F.when(overlaps, end).otherwise(start), F.when(overlaps, start).otherwise(end)
    return at_least(first, not_before) & at_most(last, not_after)


def animals_permitted() -> Column:
    """Each animal that occurs must be permitted; so must a listing without pets."""
    permitted = [
        (F.coalesce(F.col(count), F.lit(0)) <= 0) | _sure(F.col(count.replace("_count", "_allowed")))
        for count in fv.PET_COUNT_COLUMNS
    ]
    permitted.append(~_sure(F.col("no_pets")) | _sure(F.col("no_pets_allowed")))
    return all_of(permitted)


def searched_text() -> Column:
    """What the keywords of a rule are looked up in: title, intro and tag, whatever the case."""
    return fold_case(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("title", "intro", "listing_tag")]))


def keywords_fit(words: Column) -> Column:
    """All wanted words and no unwanted word.  Rules without words are settled by the size of their lists."""
    wanted, unwanted = F.col("_wanted"), F.col("_unwanted")  # folded once for each rule
    has_all = (F.coalesce(F.size(wanted), F.lit(0)) <= 0) | _sure(F.forall(wanted, lambda k: F.contains(words, k)))
    has_any = (F.coalesce(F.size(unwanted), F.lit(0)) > 0) & _sure(F.exists(unwanted, lambda k: F.contains(words, k)))
    return has_all & ~has_any


def site_rule_holds() -> Column:
    """Place and sit-length part of a rule."""
    return covered_by(F.col("want_island"), F.col("want_region"), F.col("want_subregion")) & sit_length_in(
        F.col("duration_days"), F.col("want_sit_length")
    )


def local_rule_holds(words: Column) -> Column:
    """Everything else in a rule, cheap conditions first."""
    return all_of(
        [
            in_date_window(
                F.col("start_date"), F.col("end_date"), F.col("date_window_match"),
                F.col("start_date_on_or_after"), F.col("end_date_on_or_before"),
            ),
            at_least(F.col("duration_days"), F.col("min_duration_days")),
            at_most(F.col("duration_days"), F.col("max_duration_days")),
            at_most(F.col("total_animals"), F.col("max_total_animals")),
            at_most(F.col("dogs_count"), F.col("max_dogs")),
            at_least(F.col("reply_rating_score"), F.col("min_reply_rating_score")),
            animals_permitted(),
            allowed(F.col("island"), F.col("allowed_islands")),
            allowed(F.col("region"), F.col("allowed_regions")),
            allowed(F.col("subregion"), F.col("allowed_subregions")),
            allowed(F.col("house_type"), F.col("allowed_house_types")),
            not_excluded(F.col("house_type"), F.col("excluded_house_types")),
            keywords_fit(words),
        ]
    )


def _place_key(level: str, *labels: Column) -> Column:
    """Key of a place; null when a label is missing."""
    parts = [F.lit(level)]
    for label in labels:
        parts += [F.lit("\x1f"), label]
    return F.concat(*parts)


INDEXED = 50_000  # rules that are indexed on the spot
GATHERED = 1_000  # rules that are sent to all tasks


def match_rules(listings: DataFrame, rules: DataFrame, locations: DataFrame, *, slices: int = 1, indexed: bool = False, gathered: bool = False) -> DataFrame:
    """Every listing with every enabled rule it satisfies.

    Rules meet the listings in a join (``match_rules_by_join``).  With ``indexed``, for thousands of rules, up to
    ``INDEXED`` of them are gathered (a job) and indexed in the tasks, so that listings are read once, as they are
    (:mod:`rule_index`); for a handful of rules that costs more than the join.  With ``gathered``, for a handful, up to
    ``GATHERED`` are gathered (a job) and the join sends them to all tasks, so that listings are not shuffled, four times each.
    A rule with an error matches nothing (see ``rule_errors``).
    """
    usable = resolved_rules(rules, locations).where(F.col("enabled") & F.col("rule_error").isNull())
    shown = usable.drop("site_filter", "filter_error", "rule_error", "want_region_id", "want_subregion_id", "enabled")
    if indexed:
        known = shown.limit(INDEXED + 1).toArrow()
        if known.num_rows <= INDEXED:
            schema = StructType([*listings.schema, *shown.schema])
            return listings.mapInArrow(partial(matched, rules=known), schema) if known.num_rows else listings.limit(0).mapInArrow(partial(matched, rules=known), schema)
    if gathered:
        known = shown.limit(GATHERED + 1).toArrow()
        if known.num_rows <= GATHERED:
            shown = F.broadcast(listings.sparkSession.createDataFrame(known, shown.schema))
    return match_rules_by_join(listings, shown, slices=slices)


def match_rules_by_join(listings: DataFrame, usable: DataFrame, *, slices: int = 1) -> DataFrame:
    """:func:`match_rules` for any number of rules (resolved, enabled and without an error), as a join.

    A rule names a subregion, a region, a state or no place, so it has one place
    key.  A listing offers its four keys.  Rule and listing
    meet on that key instead of comparing all listings with all rules, and the
    remaining conditions are checked on the few that meet.
    """
    keyed_rules = usable.withColumn(
        "_place",
        F.when(F.col("want_subregion").isNotNull(), _place_key("s", F.col("want_region"), F.col("want_subregion")))
        .when(F.col("want_region").isNotNull(), _place_key("r", F.col("want_region")))
        .when(F.col("want_island").isNotNull(), _place_key("i", F.col("want_island")))
        .otherwise(_place_key("*")),
    ).withColumns({"_wanted": F.transform("include_keywords", fold_case), "_unwanted": F.transform("exclude_keywords", fold_case)})
    places = F.array_compact(
        F.array(
            _place_key("*"),
            _place_key("i", F.col("island")),
            _place_key("r", F.col("region")),
            _place_key("s", F.col("region"), F.col("subregion")),
        )
    )
    # The text is put together once per listing, below the explode.
    keyed = listings.withColumn("_words", searched_text()).withColumn("_place", F.explode(places))
    met = join_dimension(keyed, keyed_rules, ["_place"], spread_by="external_id", slices=slices)
    return met.where(site_rule_holds() & local_rule_holds(F.col("_words"))).drop("_place", "_words", "_wanted", "_unwanted")


def rule_errors(rules: DataFrame, locations: DataFrame) -> DataFrame:
    """Rules that cannot be applied, and why."""
    return resolved_rules(rules, locations).where("rule_error is not null").select("rule_name", "rule_error")
