"""Views that read the generated order tables as listings, observations, runs and leaves.

Each view exists twice, as a DataFrame here and as SQL text in ``SQL``, so that
a query and its SQL twin start from the same rows.  No join carries a hint: the
sizes of the sides decide.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listing_lifecycle_spark import fixed_values as fv
from listing_lifecycle_spark.functions import hashing
from listing_lifecycle_spark.functions.joins import latest_by
from listing_lifecycle_spark.sources.locations import with_slugs

BASELINE_UNTIL = "1995-02-15"

SQL: dict[str, str] = {}


def with_views(*names: str, body: str) -> str:
    """SQL text: the named views (in order) and the query."""
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({SQL[name]})" for name in names) + "\n" + body


def island_of(region_key: Column) -> Column:
    return F.when(region_key < 2, "South Island").otherwise("North Island")


SQL["places"] = """
SELECT c_custkey, c_mktsegment AS city, n_name AS subregion, r_name AS region,
  CASE WHEN r_regionkey < 2 THEN 'South Island' ELSE 'North Island' END AS island
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

SQL["listings"] = f"""
SELECT concat(l_orderkey, '-', l_linenumber) AS external_id, p.island, p.region, p.subregion, p.city,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity * 2 AS INTEGER) END AS duration_days,
  CAST(l_shipdate AS DATE) AS start_date,
  CAST(l_shipdate AS DATE) + CAST(l_quantity * 2 AS INTEGER) - 1 AS end_date,
  o_orderpriority AS house_type,
  l_linenumber % 3 AS dogs_count,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS cats_count,
  CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS fish_count,
  l_linenumber % 3 + CASE WHEN l_returnflag IN ('R', 'A') THEN 1 ELSE 0 END AS total_animals,
  (l_returnflag = 'N' AND l_linestatus = 'F') AS no_pets,
  l_linestatus = 'O' AS starts_soon,
  CAST(round(l_discount * 100) AS INTEGER) AS reply_rating_score,
  concat('Tag ', l_returnflag) AS listing_tag,
  concat(p.city, ' ', p.subregion) AS title,
  concat('Priority ', o_orderpriority) AS intro,
  concat('https://listings.example/', l_orderkey, '-', l_linenumber) AS url,
  o_orderdate AS first_seen_at,
  CASE WHEN o_orderdate < DATE '{BASELINE_UNTIL}' THEN 'baseline' ELSE 'observed' END AS first_seen_context,
  CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'missing_once' ELSE 'expired_by_date' END AS status
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN places p ON o_custkey = p.c_custkey"""

SQL["facts"] = """
SELECT * EXCLUDE (duration_days),
  CAST(coalesce(duration_days, end_date - start_date + 1) AS INTEGER) AS duration_days,
  CAST(start_date - CAST(first_seen_at AS DATE) AS INTEGER) AS lead_time_days,
  CASE WHEN no_pets THEN 'No pets'
       WHEN dogs_count <> 0 AND cats_count <> 0 THEN 'Dogs and cats'
       WHEN (dogs_count <> 0 OR cats_count <> 0) AND fish_count <> 0 THEN 'Mixed pets'
       WHEN dogs_count <> 0 THEN 'Dogs' WHEN cats_count <> 0 THEN 'Cats' ELSE 'Other' END AS pet_label,
  dogs_count > 0 AS has_dogs, cats_count > 0 AS has_cats,
  coalesce(duration_days, end_date - start_date + 1) >= 31 AS has_long_sit,
  CASE WHEN coalesce(duration_days, end_date - start_date + 1) <= 7 THEN '0-7 days'
       WHEN coalesce(duration_days, end_date - start_date + 1) <= 14 THEN '8-14 days'
       WHEN coalesce(duration_days, end_date - start_date + 1) <= 30 THEN '15-30 days'
       WHEN coalesce(duration_days, end_date - start_date + 1) <= 60 THEN '31-60 days'
       ELSE '61+ days' END AS duration_bucket
FROM listings"""

# One row per order: the stored state of a listing.  Open orders have not been stored yet.
SQL["state"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS external_id, p.island, p.region, p.subregion, p.city,
  sha256(CAST(CAST(floor(o_totalprice / 100000) AS BIGINT) AS VARCHAR)) AS content_hash,
  o_orderdate AS first_seen_at, o_orderdate + INTERVAL 20 DAY AS last_seen_at,
  CAST(o_orderdate AS DATE) + CAST(floor(o_totalprice / 2000) AS INTEGER) AS end_date,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'active' WHEN o_orderpriority = '2-HIGH' THEN 'missing_once'
       WHEN o_orderpriority = '5-LOW' THEN 'expired_by_date' ELSE 'missing_confirmed' END AS status,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderpriority = '2-HIGH' THEN 2
       WHEN o_orderpriority = '5-LOW' THEN 0 ELSE 3 END AS missing_count,
  CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN NULL ELSE o_orderdate + INTERVAL 25 DAY END AS missing_since,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN NULL ELSE o_orderdate + INTERVAL 30 DAY END AS closed_at,
  1 AS appearance_sequence
FROM orders JOIN places p ON o_custkey = p.c_custkey
WHERE o_orderstatus <> 'O'"""

# One row per order that has lines: the latest line is the new observation.
SQL["batch"] = """
SELECT external_id, island, region, subregion, city, content_hash, observed_at, end_date FROM (
  SELECT CAST(l_orderkey AS VARCHAR) AS external_id, p.island, p.region, p.subregion, p.city,
    sha256(CAST(CAST(floor(o_totalprice / 100000) AS BIGINT) + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS VARCHAR)) AS content_hash,
    l_shipdate AS observed_at,
    CAST(l_shipdate AS DATE) + CAST(l_quantity * 2 AS INTEGER) - 1 AS end_date,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC,
      l_suppkey DESC, l_extendedprice DESC, l_returnflag DESC, l_quantity DESC) AS rn
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN places p ON o_custkey = p.c_custkey) WHERE rn = 1"""

# One row per key and day: the latest event of the day.
SQL["observations"] = """
SELECT scope_name, external_id, run_day, observed_at, content_hash FROM (
  SELECT event_type AS scope_name, concat(event_type, '-', user_id) AS external_id, CAST(ts AS DATE) AS run_day,
    ts AS observed_at, sha256(CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR)) AS content_hash,
    row_number() OVER (PARTITION BY event_type, user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1"""

# Places of the tables as a location dimension.
SQL["locations"] = """
SELECT DISTINCT replace(lower(island), ' ', '-') AS state_slug, island,
  replace(lower(region), ' ', '-') AS region_slug, region,
  replace(lower(subregion), '_', '-') AS subregion_slug, subregion
FROM places"""

# Search scopes: everything, each state, region and subregion with orders; success is the last order seen there.
SQL["scopes"] = """
SELECT concat_ws('/', 'all', state_slug, region_slug, subregion_slug) AS name,
  state_slug, region_slug, subregion_slug,
  CASE WHEN level = 3 THEN 10 WHEN level = 2 THEN 60 WHEN level = 1 THEN 720 ELSE 1440 END AS interval_minutes,
  3 AS missing_threshold_runs, failed * 4 < orders AS enabled, last_attempt_at,
  CASE WHEN subregion_slug LIKE '%-7' THEN NULL ELSE last_success_at END AS last_success_at
FROM (
  SELECT state_slug, region_slug, subregion_slug,
    3 - CAST(GROUPING(state_slug) + GROUPING(region_slug) + GROUPING(subregion_slug) AS INTEGER) AS level,
    count(*) AS orders, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS failed,
    max(o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS BIGINT))) AS last_attempt_at,
    max(o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS BIGINT))) FILTER (WHERE o_orderstatus = 'F') AS last_success_at
  FROM orders JOIN places ON o_custkey = c_custkey JOIN locations USING (island, region, subregion)
  GROUP BY ROLLUP (state_slug, region_slug, subregion_slug))"""

# One run per order: its scope is the subregion (or the region for low priorities) of the customer.
SQL["runs"] = """
SELECT o_orderkey AS id,
  CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN concat_ws('/', 'all', state_slug, region_slug)
       ELSE concat_ws('/', 'all', state_slug, region_slug, subregion_slug) END AS scope_name,
  o_orderdate AS started_at,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate + to_minutes(CAST(1 + o_orderkey % 600 AS BIGINT)) END AS finished_at,
  CASE WHEN o_orderkey % 11 = 0 THEN 'running' WHEN o_orderstatus = 'F' THEN 'success'
       WHEN o_orderpriority = '1-URGENT' THEN 'failed' WHEN o_orderpriority = '2-HIGH' THEN 'suspicious'
       WHEN o_orderstatus = 'P' THEN 'partial_failure' ELSE 'success' END AS status,
  CAST(o_orderkey % 5 AS INTEGER) AS new_listings, CAST(o_orderkey % 3 AS INTEGER) AS changed_listings,
  CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0 THEN concat('access_challenge; run ', o_orderkey)
       WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 5 = 0
         THEN 'Unexpected status code: 202; body_snippet=awsWafCookieDomainList'
       WHEN o_orderpriority = '1-URGENT' THEN 'timeout' END AS error_message
FROM orders JOIN places ON o_custkey = c_custkey JOIN locations USING (island, region, subregion)"""

# One campaign leaf per event; each carries a short array of staged listings.
SQL["leaves"] = """
SELECT strftime(ts, '%Y-%m-%d') AS campaign_id, event_type AS scope_name, CAST(event_id AS VARCHAR) AS leaf_key, event_id AS ordinal,
  CASE event_id % 10 WHEN 0 THEN 'pending' WHEN 1 THEN 'split' ELSE 'success' END AS status,
  CAST(1 + user_id % 3 AS INTEGER) AS pages_fetched,
  CASE WHEN event_id % 10 > 1 THEN list_transform(range(0, event_id % 4), lambda i: {
    'external_id': concat(event_type, '-', user_id + i),
    'content_hash': sha256(CAST(CAST(floor(value / 50) AS BIGINT) + i AS VARCHAR))}) ELSE [] END AS listings,
  ts AS last_attempt_at, CASE WHEN event_id % 10 > 1 THEN ts END AS completed_at,
  CASE WHEN event_type = 'error' THEN 'access_challenge' END AS error_message
FROM events"""


class Bound:
    """The generated tables of one folder and the views on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def places(self) -> DataFrame:
        return (
            self.table("customer")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                "c_custkey",
                F.col("c_mktsegment").alias("city"),
                F.col("n_name").alias("subregion"),
                F.col("r_name").alias("region"),
                island_of(F.col("r_regionkey")).alias("island"),
            )
        )

    @cached_property
    def placed_orders(self) -> DataFrame:
        return self.table("orders").join(self.places, F.col("o_custkey") == F.col("c_custkey"))

    @cached_property
    def placed_lines(self) -> DataFrame:
        return self.table("lineitem").join(self.placed_orders, F.col("l_orderkey") == F.col("o_orderkey"))

    @cached_property
    def listings(self) -> DataFrame:
        """One listing per order line; an external id may occur more than once."""
        return self.listings_with()

    def listings_with(self, *more: str) -> DataFrame:
        """The listings, with ``more`` columns of their order lines."""
        stay = (F.col("l_quantity") * 2).cast("int")
        start = F.col("l_shipdate").cast("date")
        dogs = F.col("l_linenumber") % 3
        cats = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
        fish = F.when(F.col("l_returnflag") == "A", 1).otherwise(0)
        external_id = F.concat_ws("-", "l_orderkey", "l_linenumber")
        columns = {
            "external_id": external_id,
            "island": F.col("island"),
            "region": F.col("region"),
            "subregion": F.col("subregion"),
            "city": F.col("city"),
            "duration_days": F.when(F.col("l_linenumber") != 7, stay),
            "start_date": start,
            "end_date": F.date_add(start, stay - 1),
            "house_type": F.col("o_orderpriority"),
            "dogs_count": dogs,
            "cats_count": cats,
            "fish_count": fish,
            **{name: F.lit(0) for name in fv.PET_COUNT_COLUMNS[3:]},
            "total_animals": dogs + cats + fish,
            "no_pets": (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"),
            "starts_soon": F.col("l_linestatus") == "O",
            "reply_rating_score": F.round(F.col("l_discount") * 100).cast("int"),
            "listing_tag": F.concat(F.lit("Tag "), "l_returnflag"),
            "title": F.concat_ws(" ", "city", "subregion"),
            "intro": F.concat(F.lit("Priority "), "o_orderpriority"),
            "url": F.concat(F.lit("https://listings.example/"), external_id),
            "first_seen_at": F.col("o_orderdate"),
            "first_seen_context": F.when(
                F.col("o_orderdate") < F.lit(BASELINE_UNTIL).cast("date"), "baseline"
            ).otherwise("observed"),
            "status": F.when(F.col("o_orderstatus") == "O", "active")
            .when(F.col("o_orderstatus") == "P", "missing_once")
            .otherwise("expired_by_date"),
        }
        return self.placed_lines.select(*[column.alias(name) for name, column in columns.items()], *more)

    @cached_property
    def facts(self) -> DataFrame:
        from listing_lifecycle_spark.operators.facts import listing_facts

        return listing_facts(self.listings)

    @cached_property
    def state(self) -> DataFrame:
        """Stored listings: one per order that is no longer open."""
        priority, placed = F.col("o_orderpriority"), F.col("o_orderdate")

        def days(n):
            return F.make_dt_interval(F.lit(n))

        price_class = F.floor(F.col("o_totalprice") / 100000).cast("bigint").cast("string")
        return self.placed_orders.where(F.col("o_orderstatus") != "O").select(
            F.col("o_orderkey").cast("string").alias("external_id"),
            "island", "region", "subregion", "city",
            F.sha2(price_class, 256).alias("content_hash"),
            placed.alias("first_seen_at"),
            (placed + days(20)).alias("last_seen_at"),
            F.date_add(placed.cast("date"), F.floor(F.col("o_totalprice") / 2000).cast("int")).alias("end_date"),
            F.when(priority == "1-URGENT", "active").when(priority == "2-HIGH", "missing_once")
            .when(priority == "5-LOW", "expired_by_date").otherwise("missing_confirmed").alias("status"),
            F.when(priority.isin("1-URGENT", "5-LOW"), 0).when(priority == "2-HIGH", 2).otherwise(3)
            .alias("missing_count"),
            F.when(~priority.isin("1-URGENT", "5-LOW"), placed + days(25)).alias("missing_since"),
            F.when(~priority.isin("1-URGENT", "2-HIGH"), placed + days(30)).alias("closed_at"),
            F.lit(1).alias("appearance_sequence"),
        )

    @cached_property
    def batch(self) -> DataFrame:
        """New observations: the latest line of each order, reduced before the order is joined."""
        order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_quantity"]
        latest = latest_by(self.table("lineitem").select("l_orderkey", *order), ["l_orderkey"], order)
        stay = (F.col("l_quantity") * 2).cast("int")
        price_class = F.floor(F.col("o_totalprice") / 100000).cast("bigint") + F.when(
            F.col("l_returnflag") == "R", 1
        ).otherwise(0)
        return latest.join(self.placed_orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("l_orderkey").cast("string").alias("external_id"),
            "island", "region", "subregion", "city",
            F.sha2(price_class.cast("string"), 256).alias("content_hash"),
            F.col("l_shipdate").alias("observed_at"),
            F.date_add(F.col("l_shipdate").cast("date"), stay - 1).alias("end_date"),
        )

    @cached_property
    def observations(self) -> DataFrame:
        """One row per key and day, the latest event of the day."""
        rows = self.table("events").select(
            F.col("event_type").alias("scope_name"),
            F.concat_ws("-", "event_type", "user_id").alias("external_id"),
            F.to_date("ts").alias("run_day"),
            F.col("ts").alias("observed_at"),
            "event_id",
            F.floor(F.col("value") / 50).cast("bigint").cast("string").alias("value_class"),
        )
        latest = latest_by(rows, ["scope_name", "external_id", "run_day"], ["observed_at", "event_id"])
        return latest.select(
            "scope_name", "external_id", "run_day", "observed_at", F.sha2("value_class", 256).alias("content_hash")
        )

    @cached_property
    def locations(self) -> DataFrame:
        return with_slugs(self.places.select("island", "region", "subregion").distinct())

    @cached_property
    def slugged_orders(self) -> DataFrame:
        slugs = self.locations.select("island", "region", "subregion", "state_slug", "region_slug", "subregion_slug")
        return self.placed_orders.join(slugs, ["island", "region", "subregion"])

    @cached_property
    def scopes(self) -> DataFrame:
        minute = F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
        slugs = ["state_slug", "region_slug", "subregion_slug"]
        leaf = self.slugged_orders.groupBy(*slugs).agg(
            F.count(F.lit(1)).alias("orders"),
            F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("failed"),
            F.max(minute).alias("last_attempt_at"),
            F.max(F.when(F.col("o_orderstatus") == "F", minute)).alias("last_success_at"),
        )
        rolled = leaf.rollup(*slugs).agg(
            F.grouping_id().alias("gid"),
            F.sum("orders").alias("orders"),
            F.sum("failed").alias("failed"),
            F.max("last_attempt_at").alias("last_attempt_at"),
            F.max("last_success_at").alias("last_success_at"),
        )
        level = F.when(F.col("gid") == 0, 3).when(F.col("gid") == 1, 2).when(F.col("gid") == 3, 1).otherwise(0)
        pairs = F.array(
            *[F.struct(F.lit(key).alias("key"), F.col(f"{key}_slug").alias("value")) for key in ("state", "region", "subregion")]
        )
        return rolled.select(
            F.concat_ws("/", F.lit("all"), *slugs).alias("name"),
            *slugs,
            F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("site_filter"),
            F.when(level == 3, 10).when(level == 2, 60).when(level == 1, 720).otherwise(1440).alias("interval_minutes"),
            F.lit(3).alias("missing_threshold_runs"),
            (F.col("failed") * 4 < F.col("orders")).alias("enabled"),
            "last_attempt_at",
            F.when(~F.coalesce(F.col("subregion_slug").endswith("-7"), F.lit(False)), F.col("last_success_at")).alias("last_success_at"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
        region_only = priority.isin("4-NOT SPECIFIED", "5-LOW")
        return self.slugged_orders.select(
            key.alias("id"),
            F.concat_ws("/", F.lit("all"), "state_slug", "region_slug", F.when(~region_only, F.col("subregion_slug")))
            .alias("scope_name"),
            F.col("o_orderdate").alias("started_at"),
            F.when(key % 11 != 0, F.col("o_orderdate") + F.make_dt_interval(mins=(1 + key % 600).cast("int")))
            .alias("finished_at"),
            F.when(key % 11 == 0, "running").when(F.col("o_orderstatus") == "F", "success")
            .when(priority == "1-URGENT", "failed").when(priority == "2-HIGH", "suspicious")
            .when(F.col("o_orderstatus") == "P", "partial_failure").otherwise("success").alias("status"),
            (key % 5).cast("int").alias("new_listings"),
            (key % 3).cast("int").alias("changed_listings"),
            F.when((priority == "1-URGENT") & (key % 2 == 0), F.concat(F.lit("access_challenge; run "), key))
            .when(
                (priority == "1-URGENT") & (key % 5 == 0),
                "Unexpected status code: 202; body_snippet=awsWafCookieDomainList",
            )
            .when(priority == "1-URGENT", "timeout").alias("error_message"),
        )

    @cached_property
    def leaves(self) -> DataFrame:
        event = F.col("event_id")
        done = event % 10 > 1
        staged = F.transform(
            F.sequence(F.lit(0).cast("bigint"), event % 4),
            lambda i: F.struct(
                F.concat(F.col("event_type"), F.lit("-"), (F.col("user_id") + i).cast("string")).alias("external_id"),
                F.sha2((F.floor(F.col("value") / 50).cast("bigint") + i).cast("string"), 256).alias("content_hash"),
            ),
        )
        none = F.slice(staged, 1, 0)
        return self.table("events").select(
            F.date_format("ts", "yyyy-MM-dd").alias("campaign_id"),
            F.col("event_type").alias("scope_name"),
            event.cast("string").alias("leaf_key"),
            event.alias("ordinal"),
            F.when(event % 10 == 0, "pending").when(event % 10 == 1, "split").otherwise("success").alias("status"),
            (1 + F.col("user_id") % 3).cast("int").alias("pages_fetched"),
            F.when(done, F.slice(staged, F.lit(1), (event % 4).cast("int"))).otherwise(none).alias("listings"),
            F.col("ts").alias("last_attempt_at"),
            F.when(done, F.col("ts")).alias("completed_at"),
            F.when(F.col("event_type") == "error", "access_challenge").alias("error_message"),
        )


def content_hash_sql(columns: list[str]) -> str:
    """SQL text of the stable hash over columns of these names."""
    pairs = ", ".join(f"'{c}': {c}" for c in sorted(columns))
    return f"sha256(CAST(to_json({{{pairs}}}) AS VARCHAR))"


CONTENT_FIELDS = hashing.CONTENT_FIELDS
