"""Alert rules: read from JSON, filled from defaults, resolved to labels, kept in step with a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listing_lifecycle_spark import fixed_values as fv
from listing_lifecycle_spark.functions import maps
from listing_lifecycle_spark.sources.locations import resolve_site_filter

_DELIVERY = "struct<channels: array<string>, quiet_hours: struct<timezone: string, start: string, end: string>>"
_RULE_FILE = (
    "filters array<struct<name: string, enabled: boolean, site_filter: map<string,string>, "
    f"local_filter: map<string,string>, delivery: {_DELIVERY}>>"
)
_DEFAULTS_FILE = f"enabled boolean, local_filter map<string,string>, delivery {_DELIVERY}"

RULE_COLUMNS = [
    "rule_name", "enabled", "site_filter", *fv.RULE_SCHEMA, "channels", "quiet_timezone", "quiet_start", "quiet_end",
]
DATE_MODES = ["contained", "overlaps"]


def _typed(value: Column, kind: str) -> Column:
    return F.from_json(value, kind) if kind.startswith("array") else value.cast(kind)


def read_rules(spark: SparkSession, path: str, defaults_path: str) -> DataFrame:
    """Rules with typed limits.  A key that a rule states wins over the default even when it is null."""
    rules = (
        spark.read.schema(_RULE_FILE).option("multiLine", True).json(path)
        .select(F.explode("filters").alias("r")).select("r.*")
    )
    defaults = (
        spark.read.schema(_DEFAULTS_FILE).option("multiLine", True).json(defaults_path)
        .select(F.struct("enabled", "local_filter", "delivery").alias("d"))
    )
    one = defaults.agg(F.count(F.lit(1)).alias("n"), F.first("d").alias("d")).select(
        F.when(F.col("n") == 1, F.col("d")).otherwise(F.raise_error(F.concat(F.lit("one set of defaults is needed, found "), F.col("n")))).alias("d")
    )
    joined = rules.join(F.broadcast(one))  # one row
    local = maps.overlay(
        F.col("d.local_filter"), F.coalesce("local_filter", F.create_map().cast("map<string,string>"))
    )
    merged = joined.withColumn("_local", local)
    quiet = {
        f"quiet_{name}": F.coalesce(F.col(f"delivery.quiet_hours.{key}"), F.col(f"d.delivery.quiet_hours.{key}"))
        for name, key in (("timezone", "timezone"), ("start", "start"), ("end", "end"))
    }
    return merged.select(
        F.col("name").alias("rule_name"),
        F.coalesce("enabled", "d.enabled").alias("enabled"),
        "site_filter",
        *[_typed(F.try_element_at("_local", F.lit(k)), kind).alias(k) for k, kind in fv.RULE_SCHEMA.items()],
        F.coalesce("delivery.channels", "d.delivery.channels").alias("channels"),
        *[column.alias(name) for name, column in quiet.items()],
    )


def make_rules(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """Rules from dictionaries; what a rule leaves out gets the neutral default."""
    defaults: dict = {name: None for name in fv.RULE_SCHEMA}
    defaults.update(date_window_match="contained", excluded_house_types=[], include_keywords=[], exclude_keywords=[])
    defaults.update({name: False for name, kind in fv.RULE_SCHEMA.items() if kind == "boolean"})
    defaults.update(
        enabled=True, site_filter={}, channels=["telegram"], quiet_timezone=fv.LOCAL_TIME_ZONE,
        quiet_start=fv.QUIET_HOURS[0], quiet_end=fv.QUIET_HOURS[1],
    )
    types = {
        "rule_name": "string", "enabled": "boolean", "site_filter": "map<string,string>", **fv.RULE_SCHEMA,
        "channels": "array<string>", "quiet_timezone": "string", "quiet_start": "string", "quiet_end": "string",
    }
    text_types = {k: "string" if kind == "date" else kind for k, kind in types.items()}
    rows = [tuple({**defaults, **rule}[name] for name in types) for rule in rules]
    df = spark.createDataFrame(rows, ", ".join(f"{k} {kind}" for k, kind in text_types.items()))
    return df.withColumns({k: F.col(k).cast("date") for k, kind in types.items() if kind == "date"})


def resolved_rules(rules: DataFrame, locations: DataFrame) -> DataFrame:
    """Rules with the labels of their place and ``rule_error`` where one cannot be applied."""
    resolved = resolve_site_filter(rules, locations)
    error = (
        F.when(F.col("filter_error").isNotNull(), F.col("filter_error"))
        .when(~F.coalesce(F.col("date_window_match"), F.lit("contained")).isin(*DATE_MODES), "unknown date window mode")
        .when(~maps.valid_channels(F.col("channels")), "invalid channels")
    )
    return resolved.withColumn("rule_error", error)


def synchronize(stored: DataFrame, defined: DataFrame) -> DataFrame:
    """Bring stored rules in step with the defined ones.

    A rule no longer defined is disabled, a new one inserted, a differing one
    replaced.  ``change`` tells which; names are unique on both sides.
    """
    body = [c for c in defined.columns if c not in ("rule_name", "enabled")]

    def as_text(prefix: str) -> Column:
        fields = [
            maps.canonical(F.col(f"{prefix}{c}")) if dict(defined.dtypes)[c].startswith("map") else F.col(f"{prefix}{c}")
            for c in body
        ]
        named = [column.alias(c) for column, c in zip(fields, body)]
        return F.to_json(F.struct(F.col(f"{prefix}enabled").alias("enabled"), *named), {"ignoreNullFields": "false"})

    old = stored.withColumnsRenamed({c: f"old_{c}" for c in stored.columns if c != "rule_name"}).withColumn("_old", F.lit(1))
    new = defined.withColumnsRenamed({c: f"new_{c}" for c in defined.columns if c != "rule_name"}).withColumn("_new", F.lit(1))
    both = old.join(new, "rule_name", "full_outer")
    gone = F.col("_new").isNull()
    change = (
        F.when(F.col("_old").isNull(), "inserted")
        .when(gone & F.col("old_enabled"), "disabled")
        .when(gone, "unchanged")
        .when(~as_text("old_").eqNullSafe(as_text("new_")), "updated")
        .otherwise("unchanged")
    )
    return both.select(
        "rule_name",
        F.when(gone, F.lit(False)).otherwise(F.col("new_enabled")).alias("enabled"),
        *[F.when(gone, F.col(f"old_{c}")).otherwise(F.col(f"new_{c}")).alias(c) for c in body],
        change.alias("change"),
    )


def duplicate_names(rules: DataFrame) -> DataFrame:
    """Rule names that occur more than once (must be empty before synchronizing)."""
    return rules.groupBy("rule_name").agg(F.count(F.lit(1)).alias("rules")).where("rules > 1")
