"""Extraction from the page table; search cards and option counts, which its pages don't have, from pages made of the order lines."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from listing_lifecycle_spark.functions import markup, text
from listing_lifecycle_spark.operators import cards as ca
from listing_lifecycle_spark.operators import extract as ex
from listing_lifecycle_spark.operators.facts import with_island
from listing_lifecycle_spark.workload.bindings import SQL, with_views
from listing_lifecycle_spark.workload.catalog import query


def option_pages(t):
    """Each order line as the option links of a search page."""
    number, key = F.col("l_linenumber"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    options = F.concat(
        F.lit('<a href="/search?housetype=1"><span class="label">House ('), F.format_number((F.col("l_orderkey") + 1000).cast("int"), 0),
        F.lit(')</span></a><a href="/search?region=33&amp;housetype=2">Flat (7)</a><a href="/search?sitlengths=60&region=1">Short ('), number, F.lit(")</a><a href='/x'>Other (5)</a>"),
    )
    return t.placed_lines.select(key.alias("page_id"), options.alias("html"))


def rendered_pages(t):
    """Each order line as a search page with two cards and a show-more link; a null leaves its place on the page empty.

    The table is one small file, hence one task; parsing is heavy on the
    processor, so the (narrow) lines are dealt out before pages are made of them.
    """
    text_of = partial(F.concat_ws, "")
    lines = t.placed_lines.repartition(t.spark.sparkContext.defaultParallelism)
    number, key = F.col("l_linenumber"), text_of("l_orderkey", "l_linenumber")
    day = F.col("l_shipdate").cast("date")
    stay = (F.col("l_quantity") * 2).cast("int")
    link = text_of(F.lit("/house-sitting-pet-sitting-job/"), key, F.lit("/home?a=1&amp;b=2"))
    place = (
        F.when(number % 4 == 0, F.col("region"))
        .when(number % 4 == 1, text_of(F.lit(" - "), "region", F.lit(" - "), "subregion"))
        .when(number % 4 == 2, text_of("city", F.lit(" - "), "region", F.lit(" - "), "subregion"))
        .otherwise(text_of("city", F.lit(" - "), "region", F.lit(" - "), "subregion", F.lit(" - East")))
    )
    dates = text_of(
        F.date_format(day, "d MMM yyyy"), F.lit(" - "),
        F.when(number == 6, F.lit("31 Nonsense")).otherwise(F.date_format(F.date_add(day, stay), "dd MMM yyyy")),
        F.when(number == 5, F.lit(" (approx)")).otherwise(F.lit("")),
    )
    length = (
        F.when(number == 1, text_of(stay, F.lit(" nights")))
        .when(number == 2, text_of(F.floor(stay / 7), F.lit(" weeks "), stay % 7, F.lit(" nights")))
        .when(number == 3, text_of(stay, F.lit(" weeks")))
        .otherwise(F.lit("ask the owner"))
    )
    pets = text_of(
        F.lit('<ul class="listing-pets"><li><img alt="Dogs" src="d.svg"/><span>'), number % 3, F.lit("</span></li>"),
        F.when(F.col("l_returnflag") == "R", '<li><img alt="Cats"/><span>2</span></li><li><img alt="Llamas &amp; Co"/><span>3</span></li>')
        .when(F.col("l_returnflag") == "A", '<li><img alt="None"/><span>x</span></li><li><img alt="Fish"/></li>')
        .otherwise('<li><img alt="Hedgehogs"/><span>many</span></li><li><img alt="Dogs"/><span> 4 </span></li>'),
        F.lit("</ul>"),
    )
    card = text_of(
        F.lit('<div class="card primary search-listing"><div class="card-header">'),
        F.when(F.col("l_linestatus") == "O", '<div class="urgent tooltip" title="Starts soon"></div>').otherwise('<div class="urgently"></div>'),
        F.lit('<div class="reply-rating"><img alt="Reply Rating '), F.round(F.col("l_discount") * 100).cast("int"), F.lit('"/></div></div>'),
        F.lit("<h3><a href='"), link, F.lit("'>\n  "), "city", F.lit(" &amp; Co <span>"), place, F.lit("</span></a></h3>"),
        F.lit('<div class="listing-tag"><!-- note --> Tag&nbsp;'), "l_returnflag", F.lit("</div>"),
        F.lit('<p class="listing-intro">Looking <b>after</b> pets. <a href="#">View</a></p>'),
        F.lit('<div class="listing-footer"><ul><li><span class="icon">date_range</span>'), dates, F.lit("</li></ul>"),
        F.lit('<ul class="x"><li><span class="icon">schedule</span>'), length,
        F.lit('</li><li><span class="icon">cottage</span>'), "o_orderpriority", F.lit("</li></ul>"),
        pets, F.lit("</div></div>"),
    )
    plain = text_of(
        F.lit('<div class="search-listing"><h3><a href="/house-sitting-pet-sitting-job/9'), key, F.lit('/b">'), "city", F.lit("</a></h3></div>")
    )
    options = text_of(
        F.lit('<a href="/search?housetype=1"><span class="label">House ('), F.format_number((F.col("l_orderkey") + 1000).cast("int"), 0),
        F.lit(')</span></a><a href="/search?region=33&amp;housetype=2">Flat (7)</a><a href="/search?sitlengths=60&region=1">Short ('), number, F.lit(")</a><a href='/x'>Other (5)</a>"),
    )
    notice = F.when(number == 7, "<h2>And there&#39;s <b>more</b></h2>").otherwise("")
    more = text_of(F.lit('<div id="showmore1"><a class="b" href="/search?id=7&amp;page='), number, F.lit('">Show more</a></div>'))
    page = text_of(
        F.lit("<html><body>"), options, F.lit('<div id="results">'), card, plain,
        F.lit('<div class="search-listing"><p>advert</p></div></div>'), notice, F.when(number > 1, more).otherwise(""), F.lit("</body></html>"),
    )
    row_key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return lines.select(row_key.alias("page_id"), page.alias("html"))


SQL["card_rows"] = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS page_id, concat(l_orderkey, l_linenumber) AS external_id,
  p.island, concat(p.city, ' & Co') AS city, p.region, l_linenumber AS n,
  CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 3 THEN concat(p.subregion, ' - East') ELSE p.subregion END AS subregion,
  concat(p.city, ' & Co ', CASE l_linenumber % 4 WHEN 0 THEN p.region WHEN 1 THEN concat('- ', p.region, ' - ', p.subregion)
    WHEN 2 THEN concat(p.city, ' - ', p.region, ' - ', p.subregion) ELSE concat(p.city, ' - ', p.region, ' - ', p.subregion, ' - East') END) AS title,
  CAST(l_shipdate AS DATE) AS start_date,
  CASE WHEN l_linenumber = 6 THEN NULL ELSE CAST(l_shipdate AS DATE) + CAST(l_quantity * 2 AS INTEGER) END AS end_date,
  CASE WHEN l_linenumber = 3 THEN CAST(l_quantity * 2 AS INTEGER) * 7 WHEN l_linenumber = 6 THEN NULL
    ELSE CAST(l_quantity * 2 AS INTEGER) END AS duration_days,
  o_orderpriority AS house_type,
  CASE WHEN l_returnflag IN ('R', 'A') THEN l_linenumber % 3 ELSE 4 END AS dogs_count,
  CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END AS cats_count, CASE WHEN l_returnflag = 'R' THEN 3 ELSE 0 END AS other_pets_count,
  l_returnflag = 'A' AS no_pets, l_linestatus = 'O' AS starts_soon, CAST(round(l_discount * 100) AS INTEGER) AS reply_rating_score,
  concat('Tag ', l_returnflag) AS listing_tag, 'Looking after pets.' AS intro,
  concat('https://listings.example/house-sitting-pet-sitting-job/', l_orderkey, l_linenumber, '/home?a=1&b=2') AS url, p.city AS plain_city, l_orderkey
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN places p ON o_custkey = p.c_custkey"""
CARD_COLUMNS = """page_id external_id island region subregion city title start_date end_date duration_days house_type dogs_count cats_count
  other_pets_count no_pets starts_soon reply_rating_score listing_tag intro url""".split()


@query(
    "listing_cards", "EXT1 EXT2 EXT3 EXT4 EXT6 EXT7 EXT8 EXT9 EXT10 EXT11 EXT12 PRJ10 PRJ11 PRJ12 S1",
    with_views("places", "card_rows", body=f"""SELECT {', '.join(CARD_COLUMNS)}, dogs_count + cats_count + other_pets_count AS total_animals FROM card_rows
      UNION ALL SELECT page_id, concat('9', external_id), NULL, NULL, NULL, plain_city, plain_city, NULL, NULL, NULL, NULL, 0, 0, 0, false, false, NULL, NULL, NULL,
      concat('https://listings.example/house-sitting-pet-sitting-job/9', external_id, '/b'), 0 FROM card_rows"""),
    dates="start_date end_date",
)
def listing_cards(t):
    listings, _ = ca.listing_cards(rendered_pages(t), t.locations)
    return listings.select(*CARD_COLUMNS, "total_animals")


@query(
    "menu_cards", "SRC3 EXT1 EXT2 EXT3 EXT4 PRJ10 PRJ12 S1",
    """SELECT page_id, CAST(generate_subscripts(m, 1) - 1 AS INTEGER) AS position, replace(regexp_extract(unnest(m), 'href="/([^"]*)"', 1), '&amp;', '&') AS external_id,
      replace(trim(regexp_extract(unnest(m), '>([^<]*)</a>', 1)), '&amp;', '&') AS title, replace(trim(regexp_extract(unnest(m), '>([^<]*)</a>', 1)), '&amp;', '&') AS city,
      'https://listings.example/' || replace(regexp_extract(unnest(m), 'href="/([^"]*)"', 1), '&amp;', '&') AS url, CAST(NULL AS VARCHAR) AS region, 0 AS total_animals, false AS starts_soon
      FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="/[^"]+">[^<]*</a></li>') AS m FROM pages)""",
)
def menu_cards(t):
    listings, _ = ca.listing_cards(t.table("pages").select("page_id", "html"), t.locations, MENU_CARD)
    return listings.select("page_id", "position", "external_id", "title", "city", "url", "region", "total_animals", "starts_soon")


#: A menu entry of a page as a card.
MENU_CARD = ca.with_layout(card=("nav", "li"), link=("a[href]",), id_pattern="^/(.+)$", title=("a",), tail=("a", "span"))
#: A whole page as a card: the first menu link names it, its advertisement and its footer are tag and introduction.
PAGE_CARD = ca.with_layout(
    card=("body",), link=("nav", "a[href]"), id_pattern="^/(.+)$", title=("article", "h1"), tail=("h1", "span"), tag=("div.ad",), intro=("footer",),
    footer=("nav", "li"), icon=("nav", "li", "a"), pets=("nav", "li"), rating=("article", "img[alt]"), urgent=("article", "b[title]"),
)


@query(
    "page_listings", "SRC3 EXT1 EXT2 EXT3 EXT6 EXT7 EXT8 EXT9 EXT12 PRJ10 S1",
    """SELECT page_id, replace(regexp_extract(html, '<nav>.*?<a href="/([^"]+)"', 1, 's'), '&amp;', '&') AS external_id,
      trim(regexp_replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '&amp;', '&'), '\\s+', ' ', 'g')) AS title,
      trim(regexp_replace(replace(regexp_extract(html, '<div class="ad">(.*?)</div>', 1, 's'), '&amp;', '&'), '\\s+', ' ', 'g')) AS listing_tag,
      trim(regexp_replace(replace(replace(replace(regexp_extract(html, '<footer>(.*?)</footer>', 1, 's'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\\s+', ' ', 'g')) AS intro,
      false AS no_pets, 0 AS total_animals, CAST(NULL AS INTEGER) AS reply_rating_score FROM pages""",
)
def page_listings(t):
    listings, _ = ca.listing_cards(t.table("pages").select("page_id", "html"), t.locations, PAGE_CARD)
    return listings.select("page_id", "external_id", "title", "listing_tag", "intro", "no_pets", "total_animals", "reply_rating_score")


@query(
    "rejected_cards", "EXT3",
    """SELECT page_id, CAST(i - 1 AS INTEGER) AS position, 'no id in link' AS reject_reason
      FROM (SELECT page_id, generate_subscripts(m, 1) AS i, unnest(m) AS c FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="/[^"]+">[^<]*</a></li>') AS m FROM pages))
      WHERE NOT regexp_matches(c, 'href="/[a-z]+"') UNION ALL SELECT page_id, 0, 'no listing link' FROM pages""",
)
def rejected_cards(t):
    pages = t.table("pages").select("page_id", "html")
    unlinked = ca.with_layout(card=("article",), link=("a[href]",))
    plain = ca.with_layout(card=("nav", "li"), link=("a[href]",), id_pattern="^/([a-z]+)$")
    both = [ca.listing_cards(pages, t.locations, layout)[1].select("page_id", "position", "reject_reason") for layout in (plain, unlinked)]
    return both[0].unionByName(both[1])


SQL["option_rows"] = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS page_id, l_linenumber AS n, l_orderkey
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN places p ON o_custkey = p.c_custkey"""


@query(
    "option_counts", "EXT13",
    with_views("places", "option_rows", body="""SELECT page_id, 'housetype' AS field, '1' AS value, 'House' AS label, CAST(l_orderkey + 1000 AS INTEGER) AS count FROM option_rows
      UNION ALL SELECT page_id, 'housetype', '2', 'Flat', 7 FROM option_rows UNION ALL SELECT page_id, 'sitlengths', '60', 'Short', n FROM option_rows"""),
)
def option_counts(t):
    return ca.option_counts(option_pages(t)).select("page_id", "field", "value", "label", "count")


@query("estimated_totals", "AGG20",
       with_views("places", "option_rows", body="SELECT page_id, CAST(sum(l_orderkey + 1007) AS BIGINT) AS estimated_results FROM option_rows GROUP BY page_id"))
def estimated_totals(t):
    return ex.estimated_totals(ca.option_counts(option_pages(t)))


@query(
    "page_marks", "EXT14 EXT15",
    """SELECT page_id, contains(upper(replace(trim(regexp_replace(regexp_replace(regexp_replace(html,
        '<!--.*?-->|<script\\b[^>]*>.*?</script>|<style\\b[^>]*>.*?</style>', ' ', 'gs'), '<[/!a-zA-Z][^>]*>', ' ', 'gs'), '\\s+', ' ', 'g')), '&amp;', '&')), 'OF THE') AS capped,
      'https://listings.example/' || replace(regexp_extract(html, '<nav>.*?<a href="/([^"]+)"', 1, 's'), '&amp;', '&') AS next_url FROM pages""",
)
def page_marks(t):
    return ca.page_marks(t.table("pages").select("page_id", "html"), notice="OF THE", next_link=("nav", "a[href]"))


@query(
    "challenge_pages", "EXT16",
    """SELECT event_id, (event_type = 'click' AND value < 20) OR (event_type IN ('view', 'purchase') AND value < 50)
       OR event_type = 'error' AS challenge FROM events""",
)
def challenge_pages(t):
    kind, low = F.col("event_type"), F.col("value") < 50
    status = F.when(kind == "click", 202).when(kind.isin("view", "purchase"), 403).otherwise(200)
    headers = F.create_map(
        F.lit("server"), F.when(kind == "error", "nginx").otherwise("Cloudflare"),
        F.lit("cf-mitigated"), F.when(kind == "error", "Challenge").otherwise(""),
        F.lit("x-amzn-waf-action"), F.when(F.col("value") < 20, "challenge").otherwise("none"),
    )
    body = F.when(low, "<html><title>Just a moment...</title>").otherwise("<html><title>Homes</title>")
    return t.table("events").select("event_id", ex.is_challenge_page(status, headers, body).alias("challenge"))


@query(
    "refine_options", "EXT17 S17",
    """SELECT o_orderkey, 'region' AS field, CAST(o_custkey AS VARCHAR) AS value, concat('Manawatū & ', o_orderpriority) AS label,
      concat('manawatu-and-', lower(replace(o_orderpriority, ' ', '-'))) AS slug FROM orders""",
)
def refine_options(t):
    html = F.concat(
        F.lit('<a onclick="refineSearchAction(this,\'region\',\'0\')">outside</a><div id="location-options"><a onclick="refineSearchAction(this,\'region\',\''),
        "o_custkey", F.lit("')\">Manawatū &amp; "), "o_orderpriority", F.lit('</a><a onclick="other()">x</a></div>'),
    )
    pages = t.table("orders").select("o_orderkey", html.alias("html"))
    return ex.refine_options(pages).select("o_orderkey", "field", "value", "label", "slug")


@query(
    "page_links", "SRC3 EXT13",
    """SELECT page_id, replace(m[1], '&amp;', '&') AS href, replace(m[2], '&amp;', '&') AS label_text
      FROM (SELECT page_id, unnest(list_transform(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'),
        lambda a: [regexp_extract(a, 'href="([^"]*)"', 1), trim(regexp_extract(a, '>([^<]*)<', 1))])) AS m FROM pages)""",
)
def page_links(t):
    return ex.anchors(t.table("pages").select("page_id", "html")).select("page_id", "href", "label_text")


@query(
    "page_titles", "SRC3 S1",
    """SELECT page_id, trim(regexp_replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM pages""",
)
def page_titles(t):
    return ex.normalized_titles(t.table("pages").select("page_id", "html"))


@query(
    "page_headline_words", "EXT14",
    """SELECT page_id, contains(upper(replace(trim(regexp_replace(regexp_replace(regexp_replace(html,
        '<!--.*?-->|<script\\b[^>]*>.*?</script>|<style\\b[^>]*>.*?</style>', ' ', 'gs'), '<[/!a-zA-Z][^>]*>', ' ', 'gs'), '\\s+', ' ', 'g')), '&amp;', '&')), 'OF THE') AS found FROM pages""",
)
def page_headline_words(t):
    return t.table("pages").select("page_id", ex.has_cap_notice(F.col("html"), "OF THE").alias("found"))


@query(
    "intro_without_links", "EXT6",
    """SELECT page_id, nullif(trim(regexp_replace(replace(regexp_replace(regexp_replace(
        regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<a\\b[^>]*>.*?</a>', '', 'gs'), '<[/!a-zA-Z][^>]*>', ' ', 'gs'), '&amp;', '&'), '\\s+', ' ', 'g')), '') AS nav_text,
      trim(regexp_replace(replace(regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '<[/!a-zA-Z][^>]*>', ' ', 'gs'), '&amp;', '&'), '\\s+', ' ', 'g')) AS heading FROM pages""",
)
def intro_without_links(t):
    nav = F.regexp_extract("html", r"(?s)<nav>(.*?)</nav>", 1)
    return t.table("pages").select(
        "page_id",
        markup.text_of(F.regexp_replace(nav, r"(?is)<a\b[^>]*>.*?</a>", "")).alias("nav_text"),
        markup.text_of(F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1)).alias("heading"),
    )


@query(
    "url_parameters", "EXT13",
    """SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]+)', 1), '') AS page, nullif(regexp_extract(url, '[?&]utm_source=([^&#]+)', 1), '') AS source
      FROM pages""",
)
def url_parameters(t):
    url = F.col("url")
    return t.table("pages").select(
        "page_id", markup.query_value(url, "page").alias("page"), markup.query_value(url, "utm_source").alias("source")
    )


@query(
    "parsed_ranges", "EXT10 EXT11 PRJ12",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS start_date,
      CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN NULL ELSE CAST(o_orderdate AS DATE) + 40 END AS end_date,
      CASE WHEN o_orderpriority = '1-URGENT' THEN 9 WHEN o_orderpriority = '2-HIGH' THEN NULL WHEN o_orderpriority = '3-MEDIUM' THEN 40 ELSE 16 END AS days FROM orders""",
    dates="start_date end_date",
)
def parsed_ranges(t):
    kind, day = F.col("o_orderpriority"), F.to_date("o_orderdate")
    start = F.date_format(day, "d MMM yyyy")
    text_of_range = (
        F.when(kind == "1-URGENT", start)
        .when(kind == "2-HIGH", F.concat(start, F.lit(" - soon")))
        .otherwise(F.concat(start, F.lit(" - "), F.date_format(F.date_add(day, 40), "dd MMM yyyy"), F.lit(" (approx)")))
    )
    length = F.when(kind == "1-URGENT", "1 week 2 nights").when(kind == "2-HIGH", "long").when(kind == "3-MEDIUM", "0 nights").otherwise("2 weeks 2 nights")
    rows = t.table("orders").select("o_orderkey", length.alias("length"), ex.date_range(text_of_range).alias("dates")).select("*", "dates.*")
    days = ex.nights(ex.duration_days(F.col("length")), F.col("start_date"), F.col("end_date"))
    return rows.select("o_orderkey", "start_date", "end_date", days.alias("days"))


@query(
    "island_of_region", "PRJ11",
    with_views("places", body="""SELECT c_custkey, CASE WHEN city = 'BUILDING' THEN 'elsewhere' ELSE region END AS region,
      CASE WHEN city = 'BUILDING' THEN NULL ELSE island END AS island FROM places"""),
)
def island_of_region(t):
    rows = t.places.select("c_custkey", F.when(F.col("city") == "BUILDING", "elsewhere").otherwise(F.col("region")).alias("region"), "island")
    return with_island(rows, t.locations).select("c_custkey", "region", "island")


@query(
    "slugs", "S17 S1",
    """SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^\\x00-\\x7F]', '', 'g').replace('''', '').replace('&', ' and '),
      '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents""",
)
def slugs(t):
    return t.table("documents").select("doc_id", text.slugify(F.col("text")).alias("slug"))


@query(
    "aliased_subregions", "EXT4 EXT5",
    with_views("places", body="""SELECT c_custkey, CASE WHEN region = 'ASIA' THEN 'Auckland' ELSE region END AS region,
      CASE WHEN region = 'ASIA' AND city = 'BUILDING' THEN 'Auckland - Central' WHEN city = 'BUILDING' THEN 'Central' ELSE subregion END AS subregion FROM places"""),
)
def aliased_subregions(t):
    region = F.when(F.col("region") == "ASIA", "Auckland").otherwise(F.col("region"))
    subregion = F.when(F.col("city") == "BUILDING", "Central").otherwise(F.col("subregion"))
    link = F.concat("city", F.lit(" <span> - "), region, F.lit(" - "), subregion, F.lit("</span>"))
    return t.places.select("c_custkey", ex.place_of(link).alias("place")).select("c_custkey", "place.region", "place.subregion")
