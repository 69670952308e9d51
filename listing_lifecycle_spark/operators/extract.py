"""Listing cards, option counts and page marks out of search result pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listing_lifecycle_spark import fixed_values as fv
from listing_lifecycle_spark.functions import hashing, markup
from listing_lifecycle_spark.functions.text import bind, decode_entities, normalize_space, present, slugify, whole_number
from listing_lifecycle_spark.operators.facts import nights, total_animals, with_island

BASE_URL = "https://listings.example"


def cards_of(pages: DataFrame) -> DataFrame:
    """One row per listing card with its place on the page."""
    pieces = markup.split_at(markup.visible(F.col("html")), markup.class_tag("div", "search-listing"))
    keep = [c for c in pages.columns if c != "html"]
    return pages.select(*keep, F.posexplode(pieces).alias("position", "piece")).select(
        *keep, "position", markup.close_element(F.col("piece"), "div").alias("card")
    )


def listing_link(card: Column) -> Column:
    """First link of a card that leads to a listing."""
    stem = fv.EXTERNAL_ID_PATTERN.split("(")[0]
    tags = markup.all_matches(card, rf"(?is)<a\b{markup.INSIDE}*>", 0)
    # The quick test on the tag spares decoding the links that cannot qualify.
    likely = F.filter(tags, lambda tag: F.contains(tag, F.lit(stem)))
    hrefs = F.transform(likely, lambda tag: markup.attribute(tag, "href"))
    return F.try_element_at(F.filter(hrefs, lambda href: F.contains(href, F.lit(stem))), F.lit(1))


def title_link(card: Column) -> Column:
    """Inner markup of the first link in a heading."""
    headings = markup.all_matches(card, r"(?is)<h3\b[^>]*>(.*?)</h3>", 1)
    with_link = F.filter(headings, lambda h: F.regexp_like(h, F.lit(r"(?i)<a\b")))
    return markup.first_match(F.try_element_at(with_link, F.lit(1)), rf"(?is)<a\b{markup.INSIDE}*>(.*?)</a>")


def place_of(link: Column) -> Column:
    """Title, city, region and subregion of a title link."""
    title = markup.text_of(link)
    tail = markup.text_of(F.regexp_extract(link, r"(?is)<span\b[^>]*>(.*?)</span>", 1))
    direct = markup.text_of(F.regexp_replace(link, r"(?is)<(\w+)\b[^>]*>.*?</\1\s*>", " "))
    return place_from(title, direct, tail)


def place_from(title: Column, direct: Column, tail: Column) -> Column:
    """Title, city, region and subregion from a link's text, its text outside inner elements, and the text of its tail."""
    split_tail = F.split(F.regexp_replace(tail, r"^- ", ""), fv.RANGE_SEPARATOR)
    parts = F.filter(F.transform(split_tail, lambda p: F.trim(p)), lambda p: p != "")

    def region_of(found: Column) -> Column:
        region = F.when(F.size(found) <= 2, F.try_element_at(found, F.lit(1))).otherwise(F.try_element_at(found, F.lit(2)))
        rest = F.slice(found, F.lit(3), F.greatest(F.size(found) - 2, F.lit(1)))
        subregion = F.when(F.size(found) == 2, F.try_element_at(found, F.lit(2))).when(
            F.size(found) >= 3, F.array_join(rest, fv.RANGE_SEPARATOR)
        )
        return F.struct(region.alias("region"), subregion.alias("subregion"))

    def full_name(place: Column) -> Column:
        subregion = place["subregion"]
        for name, aliases in fv.SUBREGION_ALIASES.items():
            known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
            alias = F.when(place["region"] == name, F.try_element_at(known, place["subregion"]))
            subregion = F.coalesce(alias, subregion)
        return subregion

    return bind(
        F.struct(title.alias("title"), direct.alias("direct"), bind(parts, region_of).alias("place")),
        lambda t: F.struct(
            t["title"].alias("title"),
            F.coalesce(t["direct"], t["title"]).alias("city"),
            t["place"]["region"].alias("region"),
            full_name(t["place"]).alias("subregion"),
        ),
    )


def intro_text(card: Column) -> Column:
    """Introduction without the text of its links."""
    intro = markup.section(card, "listing-intro")
    return markup.text_of(F.regexp_replace(intro, rf"(?is)<a\b{markup.INSIDE}*>.*?</a>", ""))


def footer_of(card: Column) -> Column:
    """Footer texts by the icon in front of them; the last one of a kind counts."""
    footer = F.array_join(markup.sections(card, "listing-footer"), " ")
    items = markup.all_matches(footer, r"(?is)<li\b[^>]*>(.*?)</li>", 1)
    icon = rf"(?is){markup.class_tag('(span|i|div|em)', 'icon')}(.*?)</\1>"
    with_icon = F.filter(items, lambda item: F.contains(item, F.lit("icon")))
    read = F.transform(
        with_icon,
        lambda item: F.struct(
            markup.text_of(F.regexp_extract(item, icon, 2)).alias("icon"),
            # Only the first icon is taken out, as text may hold another one.
            markup.text_of(F.regexp_replace(item, rf"{icon}(.*)$", "$3")).alias("text"),
        ),
    )

    def value(rows: Column, kind: str) -> Column:
        return F.try_element_at(F.filter(rows, lambda r: r["icon"] == kind), F.lit(-1))["text"]

    return bind(
        read,
        lambda rows: F.struct(
            value(rows, fv.ICON_DATES).alias("dates_text"),
            value(rows, fv.ICON_DURATION).alias("duration_text"),
            value(rows, fv.ICON_HOUSE_TYPE).alias("house_type"),
        ),
    )


def pet_entries(card: Column) -> Column:
    """(name, count) of the animals on a card; entries without picture or number are left out."""
    pets = F.array_join(markup.sections(card, "listing-pets"), " ")
    items = markup.all_matches(pets, r"(?is)<li\b[^>]*>(.*?)</li>", 1)

    def entry(item: Column) -> Column:
        images = markup.all_matches(item, rf"(?is)<img\b{markup.INSIDE}*?\salt\s*={markup.INSIDE}*>", 0)
        number = markup.text_of(F.regexp_extract(item, r"(?is)<span\b[^>]*>(.*?)</span>", 1))
        return F.struct(markup.attribute(F.try_element_at(images, F.lit(1)), "alt").alias("name"), number.alias("text"))

    complete = F.filter(F.transform(items, entry), lambda e: e["name"].isNotNull() & e["text"].isNotNull())
    return F.transform(
        complete, lambda e: F.struct(e["name"].alias("name"), F.coalesce(whole_number(e["text"]), F.lit(0)).alias("count"))
    )


def pets_of(card: Column) -> Column:
    """Counters of the animals on a card."""
    return pet_counters(pet_entries(card))


def pet_counters(pets: Column) -> Column:
    """Counters: the last entry of a known animal counts, unknown animals add up, ``none`` means no pets."""

    def counters(entries: Column) -> Column:
        def last(name: str) -> Column:
            return F.coalesce(F.try_element_at(F.filter(entries, lambda e: e["name"] == name), F.lit(-1))["count"], F.lit(0))

        def is_none(e: Column) -> Column:
            return F.lower(e["name"]) == "none"

        unknown = F.filter(entries, lambda e: ~e["name"].isin(*fv.PET_ALT_TEXT) & ~is_none(e))
        return F.struct(
            *[last(name).alias(column) for name, column in fv.PET_ALT_TEXT.items()],
            F.aggregate(unknown, F.lit(0), lambda total, e: total + e["count"]).alias("other_pets_count"),
            F.exists(entries, is_none).alias("no_pets"),
        )

    return bind(pets, counters)


def reply_rating(card: Column) -> Column:
    """Rating in the alternative text of the rating picture."""
    block = markup.section(card, "reply-rating")
    image = F.regexp_extract(block, rf"(?is)<img\b{markup.INSIDE}*?\salt\s*={markup.INSIDE}*>", 0)
    return whole_number(F.regexp_extract(markup.attribute(image, "alt"), fv.REPLY_RATING_PATTERN, 1))


def starts_soon(card: Column) -> Column:
    """Whether the card carries the urgent mark."""
    marks = markup.all_matches(card, rf"(?i){markup.class_tag('[a-z]+', 'urgent')}", 0)
    return F.exists(
        marks,
        lambda m: markup.attribute(m, "title").eqNullSafe("Starts soon")
        | F.array_contains(F.split(markup.attribute(m, "class"), r"\s+"), "tooltip"),
    )


def date_range(text: Column) -> Column:
    """Both days of ``12 Jun 2026 - 28 Jun 2026 (approx)``; a side that is no date is null."""
    cleaned = F.trim(F.replace(text, F.lit(fv.APPROXIMATE_SUFFIX), F.lit("")))

    def day(sides: Column, n: int) -> Column:
        value = F.try_to_timestamp(F.trim(F.try_element_at(sides, F.lit(n))), F.lit("d MMM yyyy")).cast("date")
        return F.when(F.size(sides) == 2, value)

    return bind(
        F.split(cleaned, fv.RANGE_SEPARATOR, 2),
        lambda sides: F.struct(day(sides, 1).alias("start_date"), day(sides, 2).alias("end_date")),
    )


def duration_days(text: Column) -> Column:
    """Days in ``2 weeks 2 nights``; other text and zero give null."""

    def days(trimmed: Column) -> Column:
        def number(group: int) -> Column:
            return F.coalesce(whole_number(F.regexp_extract(trimmed, fv.DURATION_PATTERN, group)), F.lit(0))

        return F.nullif(number(1) * 7 + number(2), F.lit(0))

    # Text that does not fit has no groups, so its numbers are 0.
    return bind(F.trim(text), days)


def parse_cards(cards: DataFrame, locations: DataFrame, *, base_url: str = BASE_URL) -> tuple[DataFrame, DataFrame]:
    """Listings out of cards, and the cards that lack a listing link or an id in it.

    Each stage is a projection, so that a text found once is not searched again
    for every field that depends on it.
    """
    card = F.col("card")
    keep = [c for c in cards.columns if c != "card"]
    found = bind(
        listing_link(card),
        lambda link: F.struct(link.alias("link"), present(F.regexp_extract(link, fv.EXTERNAL_ID_PATTERN, 1)).alias("external_id")),
    )
    # A generator works its columns out once; the filters below do not repeat the search for the link.
    linked = cards.select(*keep, "card", F.inline(F.array(found)))
    rejected = linked.where("external_id is null").withColumn(
        "reject_reason", F.when(F.col("link").isNull(), "no listing link").otherwise("no id in link")
    )
    pieces = linked.where("external_id is not null").select(
        *keep,
        "external_id",
        "link",
        place_of(title_link(card)).alias("place"),
        footer_of(card).alias("footer"),
        pets_of(card).alias("pets"),
        markup.text_of(markup.section(card, "listing-tag")).alias("listing_tag"),
        intro_text(card).alias("intro"),
        reply_rating(card).alias("reply_rating_score"),
        starts_soon(card).alias("starts_soon"),
    )
    dated = pieces.select(
        "*", "place.*", "pets.*", "footer.house_type", date_range(F.col("footer.dates_text")).alias("dates"),
        duration_days(F.col("footer.duration_text")).alias("parsed_days"),
    )
    counted = dated.select("*", "dates.*").withColumns(
        {
            "duration_days": nights(F.col("parsed_days"), F.col("start_date"), F.col("end_date")),
            "total_animals": total_animals(),
            "url": markup.absolute_url(F.col("link"), base_url),
        }
    )
    listings = with_island(counted, locations).withColumn("content_hash", hashing.content_hash())
    return listings.select(*keep, *fv.LISTING_SCHEMA), rejected


def anchors(pages: DataFrame, *, containing: str | None = None) -> DataFrame:
    """Links of a page: place, address and label (the text of a ``label`` element, else of the link).

    ``containing`` keeps the links whose markup has a match of this pattern.
    """
    links = markup.all_matches(markup.visible(F.col("html")), r"(?is)<a\b[^>]*\bhref\s*=[^>]*>.*?</a>", 0)
    if containing is not None:
        links = F.filter(links, lambda link: F.regexp_like(link, F.lit(containing)))
    keep = [c for c in pages.columns if c != "html"]
    exploded = pages.select(*keep, F.posexplode(links).alias("position", "anchor"))
    label = markup.section(F.col("anchor"), "label")
    return exploded.select(
        *keep,
        "position",
        markup.attribute(F.col("anchor"), "href").alias("href"),
        F.coalesce(markup.text_of(label), markup.text_of(F.col("anchor"))).alias("label_text"),
        "anchor",
    )


def option_counts(pages: DataFrame) -> DataFrame:
    """Result counts beside search options, such as ``House (1,234)``."""
    keep = [c for c in pages.columns if c != "html"]
    # Links without a bracketed number are left out before anything is decoded.
    found = anchors(pages, containing=r"\([\d,]+\)").drop("anchor")
    return counted_options(found.select(*keep, "position", "href", "label_text"))


def counted_options(found: DataFrame) -> DataFrame:
    """Options and counts of links (position, href, label_text)."""
    keep = [c for c in found.columns if c not in ("position", "href", "label_text")]

    def named(query: Column) -> Column:
        """The first field that has a value; the ones after it are not looked up."""
        def one(name: str) -> Column:
            return bind(markup.value_in(query, name), lambda v: F.when(v.isNotNull(), F.struct(F.lit(name).alias("field"), v.alias("value"))))

        return F.coalesce(*[one(name) for name in fv.OPTION_COUNT_FIELDS])

    def option(href: Column, text: Column) -> Column:
        count = whole_number(F.replace(F.regexp_extract(text, fv.OPTION_COUNT_PATTERN, 2), F.lit(","), F.lit("")))
        return bind(
            count,
            lambda n: F.when(
                n.isNotNull(),
                F.struct(
                    bind(markup.query_of(href), named).alias("option"),
                    F.trim(F.regexp_extract(text, fv.OPTION_COUNT_PATTERN, 1)).alias("label"),
                    n.alias("count"),
                ),
            ),
        )

    read = found.select(*keep, "position", F.inline(F.array(option(F.col("href"), F.col("label_text")))))
    return read.where(F.col("option").isNotNull() & F.col("count").isNotNull()).select(
        *keep, "position", "option.field", "option.value", "label", "count"
    )


def estimated_totals(counts: DataFrame, key: str = "page_id") -> DataFrame:
    """Estimated results per page: the house-type counts add up; pages without any have no estimate."""
    return counts.groupBy(key).agg(
        F.sum(F.when(F.col("field") == fv.OPTION_TOTAL_FIELD, F.col("count").cast("bigint"))).alias("estimated_results")
    )


def has_cap_notice(html: Column, notice: str = fv.CAP_NOTICE) -> Column:
    """Whether the page says that it hides further results."""
    return F.coalesce(F.contains(F.upper(markup.text_of(markup.visible(html))), F.lit(notice)), F.lit(False))


def next_page(html: Column, base_url: str = BASE_URL) -> Column:
    """Address behind the show-more link."""
    pieces = markup.split_at(markup.visible(html), r"<div\b[^>]*?\bid\s*=\s*[\"']showmore[^\"']*[\"'][^>]*>")
    inner = F.transform(pieces, lambda p: markup.close_element(p, "div"))
    links = F.filter(F.transform(inner, lambda p: F.regexp_extract(p, rf"(?is)<a\b{markup.INSIDE}*>", 0)), lambda a: a != "")
    href = present(markup.attribute(F.try_element_at(links, F.lit(1)), "href"))
    return markup.absolute_url(href, base_url)


def is_challenge_page(status: Column, headers: Column, body: Column) -> Column:
    """Whether a fetch met a browser check instead of a page.  Header names are lower case."""

    def header(name: str) -> Column:
        return F.lower(F.coalesce(F.try_element_at(headers, F.lit(name)), F.lit("")))

    lowered = F.lower(body)
    marked = F.lit(False)
    for marker in fv.CHALLENGE_BODY_MARKERS:
        marked = marked | F.contains(lowered, F.lit(marker))
    waiting = (status == 202) & ((header("x-amzn-waf-action") == "challenge") | marked)
    refused = (
        (status == 403) & F.contains(header("server"), F.lit("cloudflare")) & F.contains(lowered, F.lit("<title>just a moment"))
    )
    return F.coalesce((header("cf-mitigated") == "challenge") | waiting | refused, F.lit(False))


def refine_options(pages: DataFrame) -> DataFrame:
    """Search options that a location menu offers: field, value, label and slug."""
    menu = F.try_element_at(
        markup.split_at(markup.visible(F.col("html")), r"<(?:div|ul|nav|section)\b[^>]*?\bid\s*=\s*[\"']location-options[\"'][^>]*>"),
        F.lit(1),
    )
    links = markup.all_matches(menu, r"(?is)<a\b[^>]*\bonclick\s*=[^>]*>.*?</a>", 0)
    keep = [c for c in pages.columns if c != "html"]
    rows = pages.select(*keep, F.posexplode(links).alias("position", "link"))
    click = decode_entities(F.regexp_extract("link", r"(?is)\bonclick\s*=\s*\"([^\"]*)\"", 1))
    label = F.coalesce(markup.text_of(F.col("link")), F.lit(""))
    return (
        rows.withColumns({"click": click, "label": label})
        .where(F.regexp_like("click", F.lit(fv.REFINE_ACTION_PATTERN)))
        .select(
            *keep,
            "position",
            F.regexp_extract("click", fv.REFINE_ACTION_PATTERN, 1).alias("field"),
            F.regexp_extract("click", fv.REFINE_ACTION_PATTERN, 2).alias("value"),
            "label",
            slugify(F.col("label")).alias("slug"),
        )
    )


def normalized_titles(pages: DataFrame) -> DataFrame:
    """Text of the title element of each page."""
    return pages.select(
        *[c for c in pages.columns if c != "html"],
        normalize_space(decode_entities(F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title>", 1))).alias("title"),
    )
