"""Constraints as queries: each returns the rows (or keys) that break a rule."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from listing_lifecycle_spark import fixed_values as fv

NOT_NEGATIVE = ["total_animals", *fv.PET_COUNT_COLUMNS, "missing_count"]


def listing_rules(columns: Sequence[str]) -> dict[str, Column]:
    """Rules that a stored listing must satisfy, for the columns at hand.  A null result passes."""
    rules = {f"{c}_not_negative": F.col(c) >= 0 for c in ["duration_days", *NOT_NEGATIVE] if c in columns}
    rules.update(
        {
            "reply_rating_range": F.col("reply_rating_score").between(0, 10),
            "appearance_positive": F.col("appearance_sequence") > 0,
            "date_order": F.col("end_date") >= F.col("start_date"),
            "island_known": F.col("island").isin(*fv.ISLANDS),
            "context_known": F.col("first_seen_context").isin(*fv.FIRST_SEEN_CONTEXTS),
            "status_known": F.col("status").isin(*fv.LISTING_STATUSES),
            "external_id_present": F.col("external_id").isNotNull(),
            "content_hash_present": F.col("content_hash").isNotNull(),
            "url_present": F.col("url").isNotNull(),
        }
    )
    needs = {
        "reply_rating_range": ["reply_rating_score"], "appearance_positive": ["appearance_sequence"],
        "date_order": ["start_date", "end_date"], "island_known": ["island"], "context_known": ["first_seen_context"],
        "status_known": ["status"], "external_id_present": ["external_id"], "content_hash_present": ["content_hash"],
        "url_present": ["url"],
    }
    return {name: rule for name, rule in rules.items() if all(c in columns for c in needs.get(name, []))}


def run_rules() -> dict[str, Column]:
    """Rules of the run log."""
    return {
        "status_known": F.col("status").isin(*fv.RUN_STATUSES),
        "new_listings_not_negative": F.col("new_listings") >= 0,
        "changed_listings_not_negative": F.col("changed_listings") >= 0,
    }


def scope_rules() -> dict[str, Column]:
    """Rules of the scopes."""
    return {"interval_positive": F.col("interval_minutes") > 0, "threshold_positive": F.col("missing_threshold_runs") > 0}


def violations(df: DataFrame, rules: dict[str, Column], key: Sequence[str]) -> DataFrame:
    """One row per broken rule; all rules are looked at in one pass."""
    broken = F.array(*[F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()])
    return df.select(*key, F.explode(F.filter(broken, lambda name: name.isNotNull())).alias("rule"))


def violation_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each rule, rules without any included."""
    counted = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(True))).alias(name) for name, rule in rules.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in rules])
    return counted.select(F.inline(rows))


def duplicate_keys(df: DataFrame, key: Sequence[str], where: Column | None = None) -> DataFrame:
    """Keys that occur more than once, among the rows a partial rule speaks of."""
    rows = df if where is None else df.where(where)
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose reference leads nowhere; a null reference passes."""
    keys = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.where(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def schema_differences(df: DataFrame, expected: dict[str, str]) -> list[str]:
    """How the columns of a table differ from a contract."""
    actual = dict(df.dtypes)
    missing = [f"missing: {c}" for c in expected if c not in actual]
    unknown = [f"not in contract: {c}" for c in actual if c not in expected]
    other = [f"type of {c}: {actual[c]}, expected {k}" for c, k in expected.items() if c in actual and actual[c] != k]
    return missing + unknown + other


@dataclass(frozen=True)
class Checked:
    """Where a checked write lies, and what was counted on the way: rows, and violations by rule."""

    path: str
    rows: int
    violations: dict[str, int]

    def kept(self, spark: SparkSession) -> DataFrame:
        """Rows that break no rule."""
        return spark.read.option("basePath", self.path).parquet(f"{self.path}/valid=true").drop("valid", "broken_rules")

    def broken(self, spark: SparkSession) -> DataFrame:
        """Rows that break a rule, with the names of all that they break."""
        return spark.read.option("basePath", self.path).parquet(f"{self.path}/valid=false").drop("valid")


def check_and_write(rows: DataFrame, rules: dict[str, Column], path: str, *, contract: dict[str, str] | None = None) -> Checked:
    """Write ``rows`` in one pass that looks at every rule: sound rows apart from broken ones, counts as observed metrics.

    ``contract`` (column to type) is compared first; a table that differs is refused before anything is written.  Both
    parts of the result are there even if empty.
    """
    if contract is not None and (wrong := schema_differences(rows, contract)):
        raise ValueError("; ".join(wrong))
    broken = F.filter(F.array(*[F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()]), lambda name: name.isNotNull())
    marked = rows.withColumn("broken_rules", broken).withColumn("valid", F.size("broken_rules") == 0)
    seen = Observation("rules")
    counts = [F.count_if(F.array_contains("broken_rules", name)).alias(name) for name in rules]
    observed = marked.observe(seen, F.count(F.lit(1)).alias("_rows"), *counts)
    observed.write.mode("overwrite").partitionBy("valid").parquet(path)
    for valid in (True, False):
        marked.limit(0).drop("valid").write.mode("append").parquet(f"{path}/valid={str(valid).lower()}")
    found = seen.get
    return Checked(path, found["_rows"], {name: found[name] for name in rules})
