"""Lifecycle and coverage over the bound state, batch, observations, scopes, runs and leaves."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from listing_lifecycle_spark import fixed_values as fv
from listing_lifecycle_spark.functions import maps, text
from listing_lifecycle_spark.operators import campaigns as ca
from listing_lifecycle_spark.operators import coverage as co
from listing_lifecycle_spark.operators import facts as fa
from listing_lifecycle_spark.operators import lifecycle as lc
from listing_lifecycle_spark.plans import persist
from listing_lifecycle_spark.session import shared_folder
from listing_lifecycle_spark.sources.locations import location_dim, resolve_site_filter
from listing_lifecycle_spark.sources.rules import make_rules, read_rules
from listing_lifecycle_spark.sources.versions import VersionedTables
from listing_lifecycle_spark.workload.bindings import SQL, with_views
from listing_lifecycle_spark.workload.catalog import query

NOW = "1999-07-01 00:00:00"
THRESHOLD = 3

SQL["merged"] = """
SELECT coalesce(s.external_id, b.external_id) AS external_id,
  b.external_id IS NOT NULL AS observed, s.external_id IS NULL AS created,
  b.external_id IS NOT NULL AND NOT coalesce(s.last_seen_at > b.observed_at, false) AS applied,
  s.status AS old_status, s.content_hash AS old_hash, s.appearance_sequence AS old_sequence, s.missing_count AS old_count,
  s.missing_since AS old_since, s.closed_at AS old_closed, s.first_seen_at AS old_first, s.last_seen_at AS old_last,
  s.island AS old_island, s.region AS old_region, s.subregion AS old_subregion, s.city AS old_city, s.end_date AS old_end,
  b.content_hash AS new_hash, b.observed_at, b.island AS new_island, b.region AS new_region, b.subregion AS new_subregion,
  b.city AS new_city, b.end_date AS new_end
FROM state s FULL OUTER JOIN batch b ON s.external_id = b.external_id"""

SQL["upserted"] = """
SELECT external_id, observed, created, applied,
  CASE WHEN applied THEN new_island ELSE old_island END AS island,
  CASE WHEN applied THEN new_region ELSE old_region END AS region,
  CASE WHEN applied THEN new_subregion ELSE old_subregion END AS subregion,
  CASE WHEN applied THEN new_end ELSE old_end END AS end_date,
  CASE WHEN applied THEN new_hash ELSE old_hash END AS content_hash,
  CASE WHEN created THEN observed_at ELSE old_first END AS first_seen_at,
  CASE WHEN applied THEN observed_at ELSE old_last END AS last_seen_at,
  CASE WHEN applied THEN 'active' ELSE old_status END AS status,
  CASE WHEN applied THEN 0 ELSE old_count END AS missing_count,
  CASE WHEN applied THEN NULL ELSE old_since END AS missing_since,
  CASE WHEN applied THEN NULL ELSE old_closed END AS closed_at,
  CASE WHEN created THEN 1 WHEN applied AND old_status = 'missing_confirmed' THEN old_sequence + 1 ELSE old_sequence END AS appearance_sequence
FROM merged"""

MERGED = ("places", "state", "batch", "merged")
UPSERTED = (*MERGED, "upserted")
STATE_COLUMNS = ("external_id content_hash first_seen_at last_seen_at status missing_count missing_since closed_at "
                 "appearance_sequence").split()
INSTANTS = "first_seen_at last_seen_at missing_since closed_at"


def merged(t):
    return lc.merge_batch(t.state, t.batch, run_id=7)


@query(
    "upsert_state", "UPS1 JN5 SNK3",
    with_views(*UPSERTED, body=f"SELECT {', '.join(STATE_COLUMNS)} FROM upserted"), instants=INSTANTS,
)
def upsert_state(t):
    return merged(t).select(*STATE_COLUMNS)


@query(
    "upsert_outcomes", "UPS1 UPS2",
    with_views(*MERGED, body="""SELECT external_id, created,
      coalesce(applied AND NOT created AND old_hash <> new_hash, false) AS changed, old_status AS previous_status,
      old_hash AS previous_content_hash,
      CASE WHEN created THEN 1 WHEN applied AND old_status = 'missing_confirmed' THEN old_sequence + 1 ELSE old_sequence END AS appearance_sequence,
      applied AS observation_applied FROM merged WHERE observed"""),
)
def upsert_outcomes(t):
    return lc.outcomes(merged(t))


@query(
    "upsert_counters", "AGG13",
    with_views(*MERGED, body="""SELECT count(*) FILTER (WHERE observed) AS listings_seen,
      count(*) FILTER (WHERE observed AND created) AS new_listings,
      count(*) FILTER (WHERE applied AND NOT created AND old_hash <> new_hash) AS changed_listings,
      CAST(0 AS BIGINT) AS missing_marked FROM merged"""),
)
def upsert_counters(t):
    return lc.counters(merged(t))


@query(
    "first_seen_context", "UPS3",
    with_views(
        *MERGED, "locations", "scopes",
        body="""SELECT m.external_id, CASE WHEN sc.last_success_at IS NULL THEN 'baseline' ELSE 'observed' END AS first_seen_context
      FROM merged m JOIN locations l ON m.new_island = l.island AND m.new_region = l.region AND m.new_subregion = l.subregion
      JOIN scopes sc ON sc.state_slug = l.state_slug AND sc.region_slug = l.region_slug AND sc.subregion_slug = l.subregion_slug
      WHERE m.created""",
    ),
)
def first_seen_context(t):
    successes = t.scopes.where("subregion_slug is not null").select(
        "state_slug", "region_slug", "subregion_slug", "last_success_at"
    )
    places = t.locations.join(successes, ["state_slug", "region_slug", "subregion_slug"]).select(
        "island", "region", "subregion", F.when(F.col("last_success_at").isNull(), "baseline").otherwise("observed").alias("context")
    )
    batch = t.batch.join(places, ["island", "region", "subregion"])
    merged_rows = lc.merge_batch(t.state, batch.drop("context"), context=F.lit("observed"))
    created = merged_rows.where("created").select("external_id", "island", "region", "subregion")
    return created.join(places, ["island", "region", "subregion"]).select("external_id", F.col("context").alias("first_seen_context"))


def missing_sql(status: str = "status") -> str:
    hit = "(NOT observed AND region = 'ASIA' AND status IN ('active', 'missing_once'))"
    full = f"{hit} AND missing_count + 1 >= {THRESHOLD}"
    return f"""SELECT external_id, end_date, observed, created, CASE WHEN {full} THEN 'missing_confirmed' WHEN {hit} THEN 'missing_once' ELSE status END AS status,
      CASE WHEN {hit} THEN missing_count + 1 ELSE missing_count END AS missing_count,
      CASE WHEN {hit} THEN coalesce(missing_since, TIMESTAMP '{NOW}') ELSE missing_since END AS missing_since,
      CASE WHEN {full} THEN coalesce(closed_at, TIMESTAMP '{NOW}') ELSE closed_at END AS closed_at,
      appearance_sequence, {hit} AS marked FROM upserted"""


# In the run queries the batch holds what a run over one region has seen.
SQL["region_batch"] = "SELECT * FROM batch WHERE region = 'ASIA'"
SQL["region_merged"] = SQL["merged"].replace("JOIN batch b", "JOIN region_batch b")
REGION = ("places", "state", "batch", "region_batch", "region_merged")
SQL["region_upserted"] = SQL["upserted"].replace("FROM merged", "FROM region_merged")
SQL["region_marked"] = missing_sql().replace("FROM upserted", "FROM region_upserted")
SQL["region_expired"] = f"""SELECT * REPLACE (CASE WHEN hit THEN 'expired_by_date' ELSE status END AS status,
  CASE WHEN hit THEN coalesce(closed_at, TIMESTAMP '{NOW}') ELSE closed_at END AS closed_at)
  FROM (SELECT *, coalesce(end_date < DATE '{NOW[:10]}' AND status <> 'expired_by_date', false) AS hit FROM region_marked)"""

SCOPE = lc.RunScope("all/asia", region="ASIA", missing_threshold=THRESHOLD)


def region_batch(t):
    return t.batch.where(F.col("region") == "ASIA")


MARK_COLUMNS = "external_id status missing_count missing_since closed_at appearance_sequence".split()


@query(
    "mark_missing", "UPS4 JN4 SET3 FLT11",
    with_views(*REGION, "region_upserted", "region_marked", body=f"SELECT {', '.join(MARK_COLUMNS)} FROM region_marked"),
    instants="missing_since closed_at",
)
def mark_missing(t):
    rows = lc.merge_batch(t.state, region_batch(t), now=NOW)
    return lc.mark_missing(rows, SCOPE.covers(), threshold=THRESHOLD, now=NOW).select(*MARK_COLUMNS)


@query(
    "mark_expired", "UPS5",
    with_views("places", "state", body=f"""SELECT external_id,
      CASE WHEN hit THEN 'expired_by_date' ELSE status END AS status,
      CASE WHEN hit THEN coalesce(closed_at, TIMESTAMP '{NOW}') ELSE closed_at END AS closed_at
      FROM (SELECT *, coalesce(end_date < DATE '{NOW[:10]}' AND status <> 'expired_by_date', false) AS hit FROM state)"""),
    instants="closed_at",
)
def mark_expired(t):
    return lc.mark_expired(t.state, today=NOW[:10], now=NOW).select("external_id", "status", "closed_at")


@query(
    "apply_run", "UPS6 FLT11",
    with_views(*REGION, "region_upserted", "region_marked", "region_expired", body=f"SELECT {', '.join(MARK_COLUMNS)} FROM region_expired"),
    instants="missing_since closed_at",
)
def apply_run(t):
    rows = lc.apply_run(t.state, region_batch(t), SCOPE, run_id=9, now=NOW, today=NOW[:10])
    return rows.select(*MARK_COLUMNS)


@query(
    "run_counters", "UPS6 AGG13 SNK5",
    with_views(*REGION, "region_upserted", "region_marked", body="""SELECT count(*) FILTER (WHERE m.observed) AS listings_seen,
      count(*) FILTER (WHERE m.observed AND m.created) AS new_listings,
      (SELECT count(*) FROM region_merged WHERE applied AND NOT created AND old_hash <> new_hash) AS changed_listings,
      count(*) FILTER (WHERE m.marked) AS missing_marked FROM region_marked m"""),
)
def run_counters(t):
    rows = lc.apply_run(t.state, region_batch(t), SCOPE, run_id=9, now=NOW, today=NOW[:10])
    return lc.counters(rows)


@query(
    "persistable_rows", "PRJ9",
    with_views("places", "listings", body="""SELECT external_id, url, content_hash FROM (SELECT external_id,
      CASE WHEN house_type = '1-URGENT' THEN '' WHEN house_type = '2-HIGH' THEN NULL ELSE url END AS url,
      CASE WHEN cats_count = 1 AND no_pets THEN '' ELSE sha256(title) END AS content_hash FROM listings)
      WHERE url <> '' AND content_hash <> ''"""),
)
def persistable_rows(t):
    rows = t.listings.withColumns(
        {
            "url": F.when(F.col("house_type") == "1-URGENT", "").when(F.col("house_type") != "2-HIGH", F.col("url")),
            "content_hash": F.when((F.col("cats_count") == 1) & F.col("no_pets"), "").otherwise(F.sha2("title", 256)),
        }
    )
    return fa.persistable(rows)[0].select("external_id", "url", "content_hash")


@query(
    "rejected_rows", "PRJ9",
    with_views("places", "listings", body="""SELECT external_id, 'missing url' AS reject_reason FROM listings
      WHERE house_type IN ('1-URGENT', '2-HIGH')"""),
)
def rejected_rows(t):
    rows = t.listings.withColumns(
        {
            "url": F.when(F.col("house_type") == "1-URGENT", "").when(F.col("house_type") != "2-HIGH", F.col("url")),
            "content_hash": F.sha2("title", 256),
        }
    )
    return fa.persistable(rows)[1].select("external_id", "reject_reason")


@query(
    "last_row_per_listing", "SET2",
    """SELECT external_id, shipped, line FROM (SELECT CAST(l_orderkey AS VARCHAR) AS external_id,
      CAST(l_shipdate AS DATE) AS shipped, l_linenumber AS line,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC) AS rn FROM lineitem) WHERE rn = 1""",
    dates="shipped",
)
def last_row_per_listing(t):
    rows = t.table("lineitem").select(
        F.col("l_orderkey").cast("string").alias("external_id"),
        F.to_date("l_shipdate").alias("shipped"), F.col("l_linenumber").alias("line"),
    )
    return lc.last_per_key(rows, ["shipped", "line"])


@query(
    "lifecycle_replay", "WIN6",
    with_views("observations", body=f"""SELECT scope_name, external_id, min(run_day) AS first_run, max(run_day) AS last_run_seen,
      count(*) AS sightings, CAST(1 + count(*) FILTER (WHERE gap >= {THRESHOLD}) AS INTEGER) AS appearance_sequence,
      CAST(least(max(last_run) - max(n), {THRESHOLD}) AS INTEGER) AS missing_count,
      CASE WHEN max(last_run) = max(n) THEN 'active' WHEN max(last_run) - max(n) >= {THRESHOLD} THEN 'missing_confirmed' ELSE 'missing_once' END AS status
      FROM (SELECT *, n - lag(n) OVER (PARTITION BY scope_name, external_id ORDER BY n) - 1 AS gap
        FROM (SELECT *, max(n) OVER (PARTITION BY scope_name) AS last_run
          FROM (SELECT *, dense_rank() OVER (PARTITION BY scope_name ORDER BY run_day) AS n FROM observations)))
      GROUP BY scope_name, external_id"""),
    dates="first_run last_run_seen",
)
def lifecycle_replay(t):
    return lc.replay(t.observations, threshold=THRESHOLD)


SCOPES = ("places", "locations", "scopes")


@query(
    "enabled_scopes", "FLT9 SRT5",
    with_views(*SCOPES, body="SELECT name, interval_minutes FROM scopes WHERE enabled ORDER BY name"),
)
def enabled_scopes(t):
    return co.enabled_scopes(t.scopes).select("name", "interval_minutes")


@query(
    "due_scopes", "FLT10 SRT5",
    with_views(*SCOPES, body=f"""SELECT name, interval_minutes, last_success_at FROM scopes WHERE enabled AND (last_success_at IS NULL
      OR last_success_at <= TIMESTAMP '2001-07-31 19:30:00' - to_minutes(CAST(interval_minutes AS BIGINT)) + INTERVAL 60 SECOND) ORDER BY 2, 1"""),
    instants="last_success_at",
)
def due_scopes(t):
    return co.due_scopes(t.scopes, now="2001-07-31 19:30:00").select("name", "interval_minutes", "last_success_at")


COVERS = """(p.state_slug IS NULL OR p.state_slug IS NOT DISTINCT FROM c.state_slug)
  AND (p.region_slug IS NULL OR p.region_slug IS NOT DISTINCT FROM c.region_slug)
  AND (p.subregion_slug IS NULL OR p.subregion_slug IS NOT DISTINCT FROM c.subregion_slug)"""


@query(
    "broadest_scopes", "JN8 MAP1",
    with_views(*SCOPES, body=f"""SELECT c.name FROM scopes c WHERE coalesce(c.last_success_at < TIMESTAMP '2001-07-31 00:00:00', true)
      AND NOT EXISTS (SELECT 1 FROM scopes p WHERE p.name <> c.name
        AND coalesce(p.last_success_at < TIMESTAMP '2001-07-31 00:00:00', true) AND {COVERS})"""),
)
def broadest_scopes(t):
    moment = F.lit("2001-07-31 00:00:00").cast("timestamp_ntz")
    stale = t.scopes.where(F.coalesce(F.col("last_success_at") < moment, F.lit(True)))
    return co.broadest_scopes(stale).select("name")


@query(
    "advance_scopes", "JN7 UPS8 SET4 MAP1",
    with_views(*SCOPES, "runs", body=f"""SELECT c.name, greatest(c.last_success_at, CASE WHEN c.enabled THEN
        (SELECT max(r.finished_at) FROM runs r JOIN scopes p ON p.name = r.scope_name WHERE r.status = 'success' AND {COVERS}) END) AS last_success_at
      FROM scopes c"""),
    instants="last_success_at",
)
def advance_scopes(t):
    return co.advance_scopes(t.scopes, t.runs).select("name", "last_success_at")


@query(
    "advance_own_scope", "UPS8",
    with_views(*SCOPES, "runs", body="""SELECT c.name, greatest(c.last_success_at,
        (SELECT max(r.finished_at) FROM runs r WHERE r.scope_name = c.name AND r.status = 'success')) AS last_success_at FROM scopes c"""),
    instants="last_success_at",
)
def advance_own_scope(t):
    return co.advance_scopes(t.scopes, t.runs, covered_too=False).select("name", "last_success_at")


CHALLENGE_SQL = """status = 'failed' AND (contains(error_message, 'access_challenge')
  OR (contains(error_message, 'Unexpected status code: 202;') AND contains(error_message, 'awsWafCookieDomainList')))"""


@query(
    "latest_challenge", "FLT12",
    with_views("places", "locations", "runs", body=f"SELECT max(coalesce(finished_at, started_at)) AS challenged_at FROM runs WHERE {CHALLENGE_SQL}"),
    instants="challenged_at",
)
def latest_challenge(t):
    return co.latest_challenge(t.runs)


@query(
    "latest_challenge_by_scope", "FLT12",
    with_views("places", "locations", "runs", body=f"""SELECT scope_name, max(coalesce(finished_at, started_at)) AS challenged_at
      FROM runs WHERE {CHALLENGE_SQL} GROUP BY scope_name"""),
    instants="challenged_at",
)
def latest_challenge_by_scope(t):
    return co.latest_challenge(t.runs, by_scope=True)


@query(
    "safe_errors", "S19",
    with_views("places", "locations", "runs", body="""SELECT id, CASE WHEN contains(error_message, 'access_challenge') THEN 'access_challenge'
      ELSE error_message END AS error_message FROM runs"""),
)
def safe_errors(t):
    return t.runs.select("id", text.safe_error(F.col("error_message")).alias("error_message"))


@query(
    "body_snippets", "S19 S1",
    """SELECT doc_id, CASE WHEN length(c) <= 300 THEN c ELSE concat(c[:300], '...') END AS snippet
      FROM (SELECT doc_id, trim(regexp_replace(text, '[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85]+', ' ', 'g')) AS c FROM documents)""",
)
def body_snippets(t):
    return t.table("documents").select("doc_id", text.body_snippet(F.col("text")).alias("snippet"))


@query(
    "location_labels", "SRC5 JN12 S17",
    with_views("places", "locations", body="""SELECT c_custkey, state_slug, region_slug, subregion_slug FROM places
      JOIN locations USING (island, region, subregion)"""),
)
def location_labels(t):
    return t.places.join(t.locations, ["island", "region", "subregion"]).select(
        "c_custkey", "state_slug", "region_slug", "subregion_slug"
    )


@query(
    "site_filter_labels", "S16 JN12 FLT11",
    with_views("places", "locations", "listings", body="""SELECT external_id, l.region AS want_region, s.subregion AS want_subregion,
      CASE WHEN l.region IS NULL THEN 'unknown region' WHEN f.state <> l.state_slug THEN 'region outside state'
           WHEN f.subregion IS NOT NULL AND s.subregion IS NULL THEN 'unknown subregion'
           WHEN f.sitlengths NOT IN ('60', '61', '62', '63', '64') THEN 'unknown sit length' END AS filter_error
      FROM (SELECT external_id, CASE WHEN cats_count = 1 THEN 'north-island' ELSE 'south-island' END AS state,
          CASE WHEN dogs_count = 2 THEN 'nowhere' ELSE replace(lower(region), ' ', '-') END AS region,
          CASE WHEN fish_count = 1 THEN replace(lower(subregion), '_', '-') END AS subregion,
          CAST(60 + reply_rating_score AS VARCHAR) AS sitlengths FROM listings) f
      LEFT JOIN (SELECT DISTINCT region_slug, region, state_slug FROM locations) l ON l.region_slug = f.region
      LEFT JOIN locations s ON s.region_slug = f.region AND s.subregion_slug = f.subregion"""),
)
def site_filter_labels(t):
    pairs = {
        "state": F.when(F.col("cats_count") == 1, "north-island").otherwise("south-island"),
        "region": F.when(F.col("dogs_count") == 2, "nowhere").otherwise(text.slugify(F.col("region"))),
        "subregion": F.when(F.col("fish_count") == 1, text.slugify(F.col("subregion"))),
        "sitlengths": (F.lit(60) + F.col("reply_rating_score")).cast("string"),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()])
    filters = t.listings.select(
        "external_id", F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("site_filter")
    )
    return resolve_site_filter(filters, t.locations).select("external_id", "want_region", "want_subregion", "filter_error")


# Leaves with an area: one per subregion, read when its last line was shipped; it has shown the orders with a returned line.
SQL["areas"] = """
SELECT l.subregion_slug AS leaf_key, p.island AS want_island, p.region AS want_region, p.subregion AS want_subregion,
  l.state_slug, l.region_slug, max(o_orderdate) - INTERVAL 200 DAY AS completed_at
FROM orders JOIN places p ON o_custkey = c_custkey JOIN locations l USING (island, region, subregion) GROUP BY ALL"""
SQL["shown"] = """
SELECT DISTINCT l.subregion_slug AS leaf_key, CAST(o_orderkey AS VARCHAR) AS external_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN places p ON o_custkey = c_custkey
JOIN locations l USING (island, region, subregion) WHERE l_returnflag = 'R'"""
SQL["evidence"] = """
SELECT s.external_id, count(*) AS absences FROM state s JOIN areas a ON s.region = a.want_region AND s.island = a.want_island
  AND s.subregion = a.want_subregion AND s.last_seen_at <= a.completed_at AND a.region_slug <> 'asia' AND a.state_slug IN ('north-island')
WHERE s.status IN ('active', 'missing_once')
  AND NOT EXISTS (SELECT 1 FROM shown x WHERE x.leaf_key = a.leaf_key AND x.external_id = s.external_id) GROUP BY 1"""


def areas(t):
    slugs = ["state_slug", "region_slug", "subregion_slug"]
    grouped = t.slugged_orders.groupBy("island", "region", "subregion", *slugs).agg(F.max("o_orderdate").alias("at"))
    return grouped.select(
        F.lit("c1").alias("campaign_id"),
        F.col("subregion_slug").alias("leaf_key"),
        F.create_map(
            F.lit("state"), "state_slug", F.lit("region"), "region_slug", F.lit("subregion"), "subregion_slug"
        ).alias("site_filter"),
        F.col("island").alias("want_island"), F.col("region").alias("want_region"), F.col("subregion").alias("want_subregion"),
        (F.col("at") - F.make_dt_interval(F.lit(200))).alias("completed_at"),
    )


def shown(t):
    returned = t.table("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return t.slugged_orders.join(returned, "o_orderkey").select(
        F.col("subregion_slug").alias("leaf_key"), F.col("o_orderkey").cast("string").alias("external_id")
    )


def evidence(t):
    leaves = co.eligible_leaves(areas(t), excluded_regions=["asia"], allowed_states=["north-island"])
    return co.missing_evidence(t.state, leaves, shown(t))


EVIDENCE = ("places", "locations", "state", "areas", "shown", "evidence")


@query("leaf_missing_evidence", "JN10 FLT23", with_views(*EVIDENCE, body="SELECT * FROM evidence"))
def leaf_missing_evidence(t):
    return evidence(t)


@query(
    "mark_missing_by_leaf", "UPS7 JN10 FLT23",
    with_views(*EVIDENCE, body=f"""SELECT external_id,
      CASE WHEN absences IS NULL THEN status WHEN missing_count + 1 >= {THRESHOLD} THEN 'missing_confirmed' ELSE 'missing_once' END AS status,
      CASE WHEN absences IS NULL THEN missing_count ELSE missing_count + 1 END AS missing_count
      FROM state LEFT JOIN evidence USING (external_id)"""),
)
def mark_missing_by_leaf(t):
    rows = t.state.join(evidence(t), "external_id", "left").withColumns(
        {"observed": F.lit(False), "missing_marked": F.lit(0), "updated_at": F.lit(None).cast("timestamp_ntz")}
    )
    marked = lc.mark_missing(rows, F.lit(True), threshold=THRESHOLD, now=NOW, evidence=F.col("absences"))
    return marked.select("external_id", "status", "missing_count")


@query(
    "overlapping_leaves", "UPS7 DQ5",
    with_views("places", body="SELECT DISTINCT city AS campaign_id, concat(region, '/', subregion) AS inner_key, region AS outer_key FROM places"),
)
def overlapping_leaves(t):
    """A campaign per market with a leaf for each region and one for each of its subregions."""
    region = F.create_map(F.lit("region"), "region")
    narrow = t.places.select(F.col("city").alias("campaign_id"), F.concat_ws("/", "region", "subregion").alias("leaf_key"),
                             F.map_concat(region, F.create_map(F.lit("subregion"), "subregion")).alias("site_filter"))
    wide = t.places.select(F.col("city").alias("campaign_id"), F.col("region").alias("leaf_key"), region.alias("site_filter"))
    return co.overlapping_leaves(narrow.union(wide).dropDuplicates(["campaign_id", "leaf_key"]))


@query(
    "campaign_progress", "AGG14",
    with_views("leaves", body="""SELECT campaign_id, count(*) FILTER (WHERE status = 'success') AS completed,
      count(*) FILTER (WHERE status IN ('pending', 'success')) AS total FROM leaves GROUP BY campaign_id"""),
)
def campaign_progress(t):
    return ca.progress(t.leaves)


@query(
    "campaign_challenge", "AGG15",
    with_views("leaves", body="SELECT max(last_attempt_at) AS challenged_at FROM leaves WHERE error_message = 'access_challenge'"),
    instants="challenged_at",
)
def campaign_challenge(t):
    return ca.latest_challenge(t.leaves)


@query(
    "campaign_challenge_by_scope", "AGG15 JN9",
    with_views("leaves", body="""SELECT c.scope_name, max(l.last_attempt_at) AS challenged_at FROM leaves l
      JOIN (SELECT campaign_id, max(scope_name) AS scope_name FROM leaves GROUP BY 1) c USING (campaign_id)
      WHERE l.error_message = 'access_challenge' GROUP BY 1"""),
    instants="challenged_at",
)
def campaign_challenge_by_scope(t):
    campaigns = t.leaves.groupBy("campaign_id").agg(F.max("scope_name").alias("scope_name"))
    return ca.challenge_by_scope(t.leaves, campaigns)


SQL["staged"] = """
SELECT campaign_id, leaf_key, ordinal, completed_at, position, item.external_id AS external_id, item.content_hash AS content_hash
FROM (SELECT *, unnest(listings) AS item, unnest(range(len(listings))) AS position FROM leaves WHERE status = 'success')"""


@query(
    "staged_listings", "ARR3",
    with_views("leaves", "staged", body="SELECT campaign_id, leaf_key, CAST(position AS INTEGER) AS position, external_id, content_hash FROM staged"),
)
def staged_listings(t):
    return ca.staged_listings(t.leaves).select("campaign_id", "leaf_key", "position", "external_id", "content_hash")


@query(
    "campaign_payload", "AGG19 WIN2 ARR3 SET2",
    with_views("leaves", "staged", body="""SELECT campaign_id, external_id, observed_at, content_hash FROM (SELECT campaign_id, external_id,
      completed_at AS observed_at, content_hash,
      row_number() OVER (PARTITION BY campaign_id, external_id ORDER BY completed_at DESC, ordinal DESC, position DESC) AS rn FROM staged) WHERE rn = 1"""),
    instants="observed_at",
)
def campaign_payload(t):
    return ca.merged_payload(ca.staged_listings(t.leaves)).select("campaign_id", "external_id", "observed_at", "content_hash")


@query(
    "campaign_totals", "AGG19",
    with_views("leaves", "staged", body="""SELECT t.campaign_id, pages_fetched, leaves, seen FROM
      (SELECT campaign_id, CAST(sum(pages_fetched) AS BIGINT) AS pages_fetched, count(*) AS leaves FROM leaves WHERE status = 'success' GROUP BY 1) t
      JOIN (SELECT campaign_id, count(*) AS seen FROM (SELECT DISTINCT campaign_id, leaf_key, external_id FROM staged) GROUP BY 1) s USING (campaign_id)"""),
)
def campaign_totals(t):
    seen = ca.seen_by_leaf(ca.staged_listings(t.leaves)).groupBy("campaign_id").agg(F.count(F.lit(1)).alias("seen"))
    return ca.leaf_totals(t.leaves).join(seen, "campaign_id")


@query(
    "capped_split_plan", "AGG23",
    with_views("places", body="""SELECT depth, region, nation, segment, priority, results, results > 200 AS over_cap FROM (
      SELECT 1 AS depth, region, NULL AS nation, NULL AS segment, NULL AS priority, n1 AS results FROM counted WHERE n1 <= 200 GROUP BY ALL
      UNION ALL SELECT 2, region, nation, NULL, NULL, n2 FROM counted WHERE n1 > 200 AND n2 <= 200 GROUP BY ALL
      UNION ALL SELECT 3, region, nation, segment, NULL, n3 FROM counted WHERE n2 > 200 AND n3 <= 200 GROUP BY ALL
      UNION ALL SELECT 4, region, nation, segment, priority, n4 FROM counted WHERE n3 > 200)""").replace(
        "\nSELECT depth", """, counted AS (SELECT region, nation, segment, priority, CAST(n AS BIGINT) AS n4,
      CAST(sum(n) OVER (PARTITION BY region) AS BIGINT) AS n1, CAST(sum(n) OVER (PARTITION BY region, nation) AS BIGINT) AS n2,
      CAST(sum(n) OVER (PARTITION BY region, nation, segment) AS BIGINT) AS n3 FROM (SELECT p.region, p.subregion AS nation, p.city AS segment,
      o_orderpriority AS priority, count(*) AS n FROM orders JOIN places p ON o_custkey = c_custkey GROUP BY ALL))\nSELECT depth"""),
)
def capped_split_plan(t):
    rows = t.placed_orders.select(
        "region", F.col("subregion").alias("nation"), F.col("city").alias("segment"), F.col("o_orderpriority").alias("priority")
    )
    return ca.split_plan(rows, ["region", "nation", "segment", "priority"])


@query(
    "child_site_filters", "MAP3 MAP1",
    with_views(*SCOPES, body="""SELECT concat_ws('/', c.state_slug, c.region_slug, c.subregion_slug) AS path FROM scopes p
      JOIN scopes c ON c.state_slug = p.state_slug AND c.region_slug = p.region_slug
      WHERE p.region_slug IS NOT NULL AND p.subregion_slug IS NULL AND c.subregion_slug IS NOT NULL"""),
)
def child_site_filters(t):
    parents = t.scopes.where("region_slug is not null and subregion_slug is null").select("site_filter")
    children = t.locations.select(
        maps.canonical(F.create_map(F.lit("state"), "state_slug", F.lit("region"), "region_slug")).alias("parent"),
        F.col("subregion_slug").alias("slug"),
    )
    found = ca.child_filters(parents, children, level="subregion")
    return found.select(
        F.concat_ws("/", *[F.try_element_at("site_filter", F.lit(k)) for k in ("state", "region", "subregion")]).alias("path")
    )


@query(
    "merged_phase_rows", "SET1",
    with_views("places", "locations", "runs", body="""SELECT scope_name, status, 'priority' AS phase FROM runs WHERE scope_name LIKE '%/%/%/%'
      UNION ALL SELECT scope_name, status, 'broad' FROM runs WHERE scope_name NOT LIKE '%/%/%/%'"""),
)
def merged_phase_rows(t):
    narrow = F.col("scope_name").like("%/%/%/%")
    phases = [t.runs.where(c).select("scope_name", "status", F.lit(p).alias("phase")) for c, p in ((narrow, "priority"), (~narrow, "broad"))]
    return phases[0].unionByName(phases[1])


@query(
    "latest_instants", "SET4",
    with_views("places", "locations", "runs", body="SELECT id, greatest(started_at, finished_at) AS latest FROM runs"),
    instants="latest",
)
def latest_instants(t):
    return t.runs.select("id", F.greatest("started_at", "finished_at").alias("latest"))


@query(
    "sit_length_codes", "FLT14",
    with_views("places", "listings", body="""SELECT external_id, CASE WHEN duration_days <= 7 THEN '60' WHEN duration_days <= 14 THEN '61'
      WHEN duration_days <= 28 THEN '62' WHEN duration_days <= 60 THEN '63' WHEN duration_days > 60 THEN '64' END AS code FROM listings"""),
)
def sit_length_codes(t):
    return t.listings.select("external_id", ca.sit_length_code(F.col("duration_days")).alias("code"))


@query(
    "updated_instants", "DQ9 UPS1 UPS4 UPS5",
    with_views("places", "state", "batch", body=f"""SELECT external_id, CASE
        WHEN hit OR NOT observed AND coalesce(region = 'ASIA', false) AND status IN ('active', 'missing_once') THEN TIMESTAMP '{NOW}' WHEN applied THEN observed_at END AS updated_at
      FROM (SELECT *, coalesce(end_date < DATE '{NOW[:10]}' AND status <> 'expired_by_date', false) AS hit FROM (
        SELECT s.external_id, s.region, b.observed_at, b.external_id IS NOT NULL AS observed, a.applied, CASE WHEN a.applied THEN b.end_date ELSE s.end_date END AS end_date,
          CASE WHEN a.applied THEN 'active' ELSE s.status END AS status
        FROM state s LEFT JOIN (SELECT * FROM batch WHERE region = 'ASIA') b ON b.external_id = s.external_id,
          LATERAL (SELECT b.external_id IS NOT NULL AND NOT coalesce(s.last_seen_at > b.observed_at, false) AS applied) a
        UNION ALL SELECT external_id, region, observed_at, true, true, end_date, 'active' FROM batch WHERE region = 'ASIA' AND external_id NOT IN (SELECT external_id FROM state)))"""),
    instants="updated_at",
)
def updated_instants(t):
    return lc.apply_run(t.state, region_batch(t), SCOPE, run_id=9, now=NOW, today=NOW[:10]).select("external_id", "updated_at")


# A campaign: a leaf for each subregion, and further leaves that show the orders with a returned line an hour later.
SQL["campaign_shown"] = """
SELECT x.external_id, p.region, a.completed_at + INTERVAL 1 HOUR AS observed_at, CAST(o_orderdate AS DATE) + 400 AS end_date,
  sha256(CAST(CAST(floor(o_totalprice / 100000) AS BIGINT) + o_orderkey % 2 AS VARCHAR)) AS content_hash
FROM shown x JOIN orders ON CAST(o_orderkey AS VARCHAR) = x.external_id JOIN places p ON o_custkey = c_custkey JOIN areas a USING (leaf_key)"""
SQL["campaign_merged"] = """
SELECT coalesce(s.external_id, b.external_id) AS external_id, b.external_id IS NOT NULL AS observed, s.external_id IS NULL AS created, a.applied,
  CASE WHEN a.applied THEN b.region ELSE s.region END AS region, CASE WHEN a.applied THEN b.end_date ELSE s.end_date END AS end_date,
  coalesce(a.applied AND s.content_hash <> b.content_hash, false) AS changed, CASE WHEN a.applied THEN 'active' ELSE s.status END AS status,
  CASE WHEN a.applied THEN 0 ELSE s.missing_count END AS missing_count, e.absences
FROM state s FULL JOIN campaign_shown b ON b.external_id = s.external_id LEFT JOIN campaign_evidence e ON e.external_id = s.external_id,
  LATERAL (SELECT b.external_id IS NOT NULL AND NOT coalesce(s.last_seen_at > b.observed_at, false) AS applied) a"""
SQL["campaign_evidence"] = """
SELECT s.external_id, count(*) AS absences FROM state s JOIN areas a ON s.region = a.want_region AND s.island = a.want_island AND s.subregion = a.want_subregion
  AND s.last_seen_at <= a.completed_at AND a.region_slug <> 'asia' AND a.state_slug = 'north-island'
WHERE s.status IN ('active', 'missing_once') AND s.external_id NOT IN (SELECT external_id FROM campaign_shown) GROUP BY 1"""


def campaign_leaves(t):
    """The leaves of a campaign with what they have staged, a few hundred listings each at most."""
    area = areas(t).withColumns({"ordinal": F.lit(0).cast("bigint"), "moment": F.col("completed_at")})
    kinds = fv.LISTING_SCHEMA
    listing = {name: F.lit(None).cast(kind) for name, kind in kinds.items()} | {c: F.lit(0) for c in ("total_animals", *fv.PET_COUNT_COLUMNS)}
    price = F.floor(F.col("o_totalprice") / 100000).cast("bigint") + F.col("o_orderkey") % 2
    listing |= {
        "external_id": F.col("o_orderkey").cast("string"), "island": F.col("island"), "region": F.col("region"), "subregion": F.col("subregion"), "city": F.col("city"),
        "content_hash": F.sha2(price.cast("string"), 256), "end_date": F.date_add(F.to_date("o_orderdate"), 400), "dogs_count": (F.col("o_orderkey") % 3).cast("int"), "no_pets": F.lit(False),
    }
    row = F.struct(*[listing[n].cast(k).alias(n) for n, k in kinds.items()])
    returned = t.table("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    pages = t.slugged_orders.join(returned, "o_orderkey").groupBy("subregion_slug", F.floor(F.col("o_orderkey") / 2000).alias("page")).agg(F.collect_list(row).alias("listings"))
    shown_leaves = pages.join(areas(t).select(F.col("leaf_key").alias("subregion_slug"), "completed_at"), "subregion_slug").select(
        F.lit("c1").alias("campaign_id"), F.concat_ws("/", "subregion_slug", "page").alias("leaf_key"), F.create_map().cast("map<string,string>").alias("site_filter"),
        (F.col("page") + 1).alias("ordinal"), "listings", (F.col("completed_at") + F.make_dt_interval(hours=F.lit(1))).alias("completed_at"),
    )
    none = F.array().cast(shown_leaves.schema["listings"].dataType)
    both = area.select("campaign_id", "leaf_key", "site_filter", "ordinal", none.alias("listings"), "completed_at").unionByName(shown_leaves)
    return both.withColumn("status", F.lit("success"))


@query(
    "finished_campaign", "UPS7 UPS8 AGG13 EVT2 EVT3 JN10 SNK3 SNK4",
    with_views(*SCOPES, "state", "areas", "shown", "campaign_shown", "campaign_evidence", "campaign_merged", body=f"""
      SELECT 'event' AS part, external_id AS name, CASE WHEN created THEN 'first_match' ELSE 'became_match' END AS value FROM campaign_merged WHERE applied AND region = 'EUROPE'
      UNION ALL SELECT 'run', 'success', concat_ws('/', count(*) FILTER (WHERE observed), count(*) FILTER (WHERE created), count(*) FILTER (WHERE changed), count(absences)) FROM campaign_merged
      UNION ALL SELECT 'scope', name, strftime(CASE WHEN enabled THEN greatest(last_success_at, TIMESTAMP '{NOW}') ELSE last_success_at END, '%Y-%m-%d %H:%M:%S') FROM scopes
      UNION ALL SELECT 'state', external_id, CASE WHEN coalesce(end_date < DATE '{NOW[:10]}' AND now_status <> 'expired_by_date', false) THEN 'expired_by_date' ELSE now_status END FROM (
        SELECT *, CASE WHEN absences IS NULL THEN status WHEN missing_count + 1 >= {THRESHOLD} THEN 'missing_confirmed' ELSE 'missing_once' END AS now_status FROM campaign_merged)"""),
)
def finished_campaign(t):
    """A campaign from its staged leaves to the published state, events, run row and scopes."""
    tables = VersionedTables(t.spark, f"{shared_folder(t.spark)}/campaign-{uuid.uuid4().hex}")
    log = t.spark.createDataFrame([], persist.EVENT_LOG_TYPES)
    rules = make_rules(t.spark, [dict(rule_name="europe", site_filter={"region": "europe"}, dogs_allowed=True)])
    result = persist.complete_campaign(
        t.state, campaign_leaves(t), "all", campaign_id="c1", rules=rules, event_log=log, locations=t.locations, run_id=5, started_at=NOW, now=NOW, today=NOW[:10],
        threshold=THRESHOLD, excluded_regions=["asia"], allowed_states=["north-island"], succeeded_before=True,
    )
    persist.commit_run(tables, result, scopes=t.scopes, batch_key="campaign-c1", buckets=16)
    numbers = F.concat_ws("/", "listings_seen", "new_listings", "changed_listings", "missing_marked")
    parts = [
        tables.read_log("events").select(F.lit("event").alias("part"), F.col("external_id").alias("name"), F.col("event_type").alias("value")),
        tables.read_log("runs").select(F.lit("run").alias("part"), F.col("status").alias("name"), numbers.alias("value")),
        tables.read("scopes").select(F.lit("scope").alias("part"), "name", F.date_format("last_success_at", "yyyy-MM-dd HH:mm:ss").alias("value")),
        tables.read("state").select(F.lit("state").alias("part"), F.col("external_id").alias("name"), F.col("status").alias("value")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "rules_from_files", "SRC4 MAP2 MAP4",
    with_views("places", "locations", body="""SELECT subregion_slug AS rule_name, region <> 'ASIA' AS enabled, CAST(CASE region WHEN 'AFRICA' THEN NULL WHEN 'EUROPE' THEN 9 ELSE 3 END AS INTEGER) AS min_duration_days,
      2 AS max_dogs, region = 'EUROPE' AS dogs_allowed, CASE WHEN region = 'EUROPE' THEN 'email' ELSE 'telegram' END AS channel, region_slug AS region, '06:30' AS quiet_end FROM locations"""),
)
def rules_from_files(t):
    """A rule file made from the places of the tables and a file of defaults, read and overlaid."""
    folder = f"{shared_folder(t.spark)}/rules-{uuid.uuid4().hex}"
    kind = F.col("region")
    own = F.when(kind == "AFRICA", F.create_map(F.lit("min_duration_days"), F.lit(None).cast("string"))).when(kind == "EUROPE", F.create_map(*[F.lit(x) for x in ("min_duration_days", "9", "dogs_allowed", "true")]))
    rule = F.struct(
        F.col("subregion_slug").alias("name"), F.when(kind == "ASIA", F.lit(False)).alias("enabled"), F.create_map(F.lit("region"), "region_slug").alias("site_filter"), own.alias("local_filter"),
        F.when(kind == "EUROPE", F.struct(F.array(F.lit("email")).alias("channels"))).alias("delivery"),
    )
    document = t.locations.agg(F.collect_list(rule).alias("filters")).select(F.to_json(F.struct("filters"), {"ignoreNullFields": "false"}).alias("value"))
    document.write.text(f"{folder}/rules")
    defaults = '{"enabled": true, "local_filter": {"min_duration_days": 3, "max_dogs": 2, "dogs_allowed": false}, "delivery": {"channels": ["telegram"], "quiet_hours": {"timezone": "Pacific/Auckland", "start": "00:00", "end": "06:30"}}}'
    t.spark.createDataFrame([(defaults,)], "value string").coalesce(1).write.text(f"{folder}/defaults")
    rules = read_rules(t.spark, f"{folder}/rules", f"{folder}/defaults")
    return rules.select("rule_name", "enabled", "min_duration_days", "max_dogs", "dogs_allowed", F.col("channels")[0].alias("channel"), F.try_element_at("site_filter", F.lit("region")).alias("region"), "quiet_end")


LOCATION_ROWS = ", ".join(f"({i}, " + ", ".join("'" + v.replace("'", "''") + "'" for v in row) + ")" for i, row in enumerate(sorted(fv.LOCATIONS, key=lambda r: (r[1], r[3]))))
SLUG_SQL = "regexp_replace(regexp_replace(replace(replace(lower(strip_accents({0})), '''', ''), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(
    "located_customers", "SRC5 JN12 S16 S17",
    f"""SELECT c_custkey, island, region, region_id, subregion, subregion_id, {SLUG_SQL.format("island")} AS state_slug, {SLUG_SQL.format("region")} AS region_slug, {SLUG_SQL.format("subregion")} AS subregion_slug
      FROM customer JOIN (VALUES {LOCATION_ROWS}) l(n, island, region, region_id, subregion, subregion_id) ON n = c_custkey % {len(fv.LOCATIONS)}""",
)
def located_customers(t):
    """Customers dealt over the location dimension, with labels, site ids and slugs."""
    places = location_dim(t.spark).withColumn("n", F.row_number().over(Window.orderBy("region", "subregion")) - 1)  # a row for each subregion of the site
    rows = t.table("customer").select("c_custkey", (F.col("c_custkey") % len(fv.LOCATIONS)).alias("n"))
    return rows.join(places, "n").drop("n")


@query(
    "typed_leaves", "ARR4 ARR3",
    with_views("leaves", body="""SELECT leaf_key, ordinal, status, CAST(len(listings) AS INTEGER) AS staged, listings[1].external_id AS first_id, listings[len(listings)].content_hash AS last_hash,
      list_aggregate(list_transform(listings, lambda x: x.external_id), 'string_agg', ',') AS ids FROM leaves"""),
)
def typed_leaves(t):
    """Leaves written and read again with their typed array of staged listings."""
    folder = f"{shared_folder(t.spark)}/leaves-{uuid.uuid4().hex}"
    t.leaves.write.parquet(folder)
    back = t.spark.read.schema(t.leaves.schema).parquet(folder)
    ids = F.transform("listings", lambda x: x["external_id"])
    return back.select("leaf_key", "ordinal", "status", F.size("listings").alias("staged"), F.try_element_at(ids, F.lit(1)).alias("first_id"),
                       F.try_element_at(F.transform("listings", lambda x: x["content_hash"]), F.lit(-1)).alias("last_hash"), F.when(F.size(ids) > 0, F.array_join(ids, ",")).alias("ids"))
