"""The location dimension: state, region and subregion with slugs and site ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listing_lifecycle_spark import fixed_values as fv
from listing_lifecycle_spark.functions.text import slugify

COLUMNS = [
    "state_slug",
    "island",
    "region_slug",
    "region",
    "region_id",
    "subregion_slug",
    "subregion",
    "subregion_id",
]


def location_dim(spark: SparkSession) -> DataFrame:
    """One row per subregion.  The row count is fixed, so joins may broadcast it."""
    labels = spark.createDataFrame(
        fv.LOCATIONS, "island string, region string, region_id string, subregion string, subregion_id string"
    )
    return with_slugs(labels)


def with_slugs(labels: DataFrame) -> DataFrame:
    """Add the three slugs to a table of labels (site ids are null when not given)."""
    for name in ("region_id", "subregion_id"):
        if name not in labels.columns:
            labels = labels.withColumn(name, F.lit(None).cast("string"))
    return labels.withColumns(
        {
            "state_slug": slugify(F.col("island")),
            "region_slug": slugify(F.col("region")),
            "subregion_slug": slugify(F.col("subregion")),
        }
    ).select(*COLUMNS)


def region_islands(locations: DataFrame) -> DataFrame:
    """Region -> island; at most one row per region."""
    return locations.groupBy("region").agg(F.min("island").alias("island"))


def site_filters(locations: DataFrame) -> DataFrame:
    """Every place filter that exists: per filter its map and the labels it stands for.

    The root (empty map), each state, each region and each subregion.
    """
    names = {"state": "island", "region": "region", "subregion": "subregion"}

    def place(depth: int):
        used = list(names)[:depth]
        pairs = [c for key in used for c in (F.lit(key), F.col(f"{key}_slug"))]
        labels = [
            (F.col(label) if key in used else F.lit(None).cast("string")).alias(label) for key, label in names.items()
        ]
        return F.struct(F.create_map(*pairs).cast("map<string,string>").alias("site_filter"), *labels)

    levels = locations.select(F.inline(F.array(*[place(depth) for depth in range(4)])))
    return levels.dropDuplicates(["island", "region", "subregion"])


def resolve_site_filter(filters: DataFrame, locations: DataFrame, column: str = "site_filter") -> DataFrame:
    """Add the labels a filter map stands for, and what is wrong with the map.

    ``want_island``, ``want_region`` and ``want_subregion`` are null where the
    map does not restrict that level.  ``filter_error`` names an unknown slug, a
    region outside its state, a subregion without region or an unknown sit
    length; rows with an error are kept, so that callers can report them.
    """
    states = locations.groupBy(F.col("state_slug").alias("_state")).agg(F.min("island").alias("want_island"))
    regions = locations.groupBy(F.col("region_slug").alias("_region")).agg(
        F.min("region").alias("want_region"),
        F.min("state_slug").alias("_region_state"),
        F.min("region_id").alias("want_region_id"),
    )
    subregions = locations.select(
        F.col("region_slug").alias("_region"),
        F.col("subregion_slug").alias("_subregion"),
        F.col("subregion").alias("want_subregion"),
        F.col("subregion_id").alias("want_subregion_id"),
    )

    def value(key):
        return F.nullif(F.try_element_at(F.col(column), F.lit(key)), F.lit(""))

    resolved = (
        filters.withColumns(
            {
                "_state": value("state"),
                "_region": value("region"),
                "_subregion": value("subregion"),
                "_sitlengths": value("sitlengths"),
            }
        )
        .join(states, "_state", "left")
        .join(regions, "_region", "left")
        .join(subregions, ["_region", "_subregion"], "left")
    )
    error = (
        F.when(F.col("_state").isNotNull() & F.col("want_island").isNull(), "unknown state")
        .when(F.col("_region").isNotNull() & F.col("want_region").isNull(), "unknown region")
        .when(F.col("_state") != F.col("_region_state"), "region outside state")
        .when(F.col("_subregion").isNotNull() & F.col("_region").isNull(), "subregion without region")
        .when(F.col("_subregion").isNotNull() & F.col("want_subregion").isNull(), "unknown subregion")
        .when(~F.col("_sitlengths").isin(*fv.SIT_LENGTH_CODES), "unknown sit length")
    )
    return resolved.withColumns({"filter_error": error, "want_sit_length": F.col("_sitlengths")}).drop(
        "_state", "_region", "_subregion", "_sitlengths", "_region_state"
    )
