import html as html_module
import html.entities
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from listing_lifecycle_spark.functions import markup, text
from listing_lifecycle_spark.operators import extract as ex

FULL = """
<p>Reply Rating 2</p><!-- <div class="search-listing"><h3><a href="/house-sitting-pet-sitting-job/1/no">x</a></h3></div> -->
<section><div class="search-listing odd" data-note="a > b">
  <h3><a title="see > all" href="/house-sitting-pet-sitting-job/90210/barn?from=list&amp;tab=2">Old Barn
     <span>Otago - Otago - Clutha</span></a></h3>
  <span class="reply-rating"><img alt="Reply Rating 7" src="r.png"></span>
  <em class="listing-tag">Two goats &amp; a &quot;cat&quot;</em>
  <div class="listing-intro">Quiet &ndash; <i>very</i> quiet. <a href="/more">More</a></div>
  <div class="listing-footer"><ul><li><em class="icon">date_range</em>3 Feb 2027 - 7 Mar 2027</li></ul></div>
  <ol class="listing-pets"><li><img alt="Fish"><span>4</span></li></ol>
  <ul class="listing-footer"><li><span class="icon">cottage</span>Lifestyle <u>block</u></li><li><span class="icon">schedule</span>4 weeks 4 nights</li></ul>
  <div class="listing-pets"><ul><li><img title=">" alt="Birds"><span>2</span></li></ul></div>
</div></section>
"""


def card(link="/house-sitting-pet-sitting-job/7/x", title="Town", span="", rest=""):
    place = f"<span>{span}</span>" if span else ""
    return f'<div class="search-listing"><h3><a href="{link}">{title} {place}</a></h3>{rest}</div>'


def parse(spark, locations, pages):
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    good, bad = ex.parse_cards(ex.cards_of(rows), locations)
    return [r.asDict() for r in good.orderBy("page_id", "position").collect()], bad


def test_full_card(spark, locations):
    rows, bad = parse(spark, locations, [FULL])
    assert len(rows) == 1 and bad.count() == 0
    row = rows[0]
    want = dict(
        external_id="90210", island="South Island", region="Otago", subregion="Clutha", city="Old Barn",
        title="Old Barn Otago - Otago - Clutha", duration_days=32, house_type="Lifestyle block", total_animals=6,
        fish_count=4, birds_count=2, dogs_count=0, no_pets=False, starts_soon=False, reply_rating_score=7, listing_tag='Two goats & a "cat"',
        intro="Quiet \u2013 very quiet.", url="https://listings.example/house-sitting-pet-sitting-job/90210/barn?from=list&tab=2",
    )
    assert {k: row[k] for k in want} == want
    assert (str(row["start_date"]), str(row["end_date"])) == ("2027-02-03", "2027-03-07") and len(row["content_hash"]) == 64


def test_urgent_marks(spark, locations):
    marks = ['<b class="urgent tooltip"></b>', '<i class="urgent" title="Starts soon"></i>', '<i class="urgent" title="Later"></i>', '<i class="urgently tooltip"></i>']
    rows, _ = parse(spark, locations, ["".join(card(rest=m) for m in marks)])
    assert [r["starts_soon"] for r in rows] == [True, True, False, False]


def test_places_pets_and_defaults(spark, locations):
    pets = '<ul class="listing-pets"><li><img alt="Dogs"><span>1</span></li><li><img alt="Dogs"><span>3</span></li><li><img alt="Alpacas"><span>2</span></li>' \
           '<li><img alt="Emus"><span>2</span></li><li><img alt="Cats"><span>many</span></li><li><img alt="NONE"><span>0</span></li><li><img alt="Fish"></li></ul>'
    dates = '<div class="listing-footer"><ul><li><span class="icon">date_range</span>3 Jun 2026 - 05 Jun 2026</li><li><span class="icon">schedule</span>0 nights</li></ul></div>'
    page = "".join([
        card(span=" - Taranaki - New Plymouth"), card(span="Auckland - Central"), card(span="Nowhere"), card(),
        card(span="A - Waikato - Hamilton - East"), card(rest=pets), card(rest=dates), card(title="", span="Otago"),
    ])
    rows, _ = parse(spark, locations, [page])
    assert [(r["region"], r["subregion"], r["island"]) for r in rows[:5]] == [
        ("Taranaki", "New Plymouth", "North Island"), ("Auckland", "Auckland - Central", "North Island"), ("Nowhere", None, None),
        (None, None, None), ("Waikato", "Hamilton - East", "North Island"),
    ]
    assert (rows[5]["dogs_count"], rows[5]["other_pets_count"], rows[5]["cats_count"], rows[5]["no_pets"], rows[5]["total_animals"]) == (3, 4, 0, True, 7)
    assert rows[6]["duration_days"] == 2 and rows[3]["duration_days"] is None
    assert rows[7]["city"] == "Otago" and rows[7]["starts_soon"] is False


def test_cards_without_id_are_set_aside(spark, locations):
    rows, bad = parse(spark, locations, [card(link="/house-sitting-pet-sitting-job/x/") + card(link="/about") + card()])
    assert len(rows) == 1
    assert sorted(r.reject_reason for r in bad.collect()) == ["no id in link", "no listing link"]


def test_text_after_a_card_is_not_part_of_it(spark, locations):
    rows, _ = parse(spark, locations, [card() + '<div class="urgent" title="Starts soon"></div><p class="listing-intro">other</p>'])
    assert rows[0]["starts_soon"] is False and rows[0]["intro"] is None


def test_option_counts_and_estimates(spark):
    pages = [
        '<a href="/s?sitlengths=60">Short (2,500)</a><a href="/s?housetype=1&amp;region=33"><span class="label">House (40)</span> x</a>'
        '<a href="/s?housetype=2">Flat ( 11)</a><a href="/s?state=&amp;housetype=3">Unit (9)</a><a href="/s?other=1">O (5)</a><a href="/s?region=1">None</a>',
        '<a href="?sitlengths=61">Mid (70)</a>',
    ]
    counts = ex.option_counts(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).cache()
    got = {tuple(r) for r in counts.select("page_id", "field", "value", "label", "count").collect()}
    assert got == {(0, "sitlengths", "60", "Short", 2500), (0, "housetype", "1", "House", 40), (0, "housetype", "3", "Unit", 9), (1, "sitlengths", "61", "Mid", 70)}
    assert {r.page_id: r.estimated_results for r in ex.estimated_totals(counts).collect()} == {0: 49, 1: None}


def test_page_marks(spark):
    pages = ["<h2>And   there&#39;s <b>more</b></h2>", "<script>AND THERE'S MORE</script>", '<div id="showmore2"><a href="/s?id=1&amp;page=2">More</a></div>',
             '<div id="more"><a href="/x">x</a></div>']
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").orderBy("page_id")
    got = [tuple(r) for r in rows.select(ex.has_cap_notice(F.col("html")), ex.next_page(F.col("html"))).collect()]
    assert got == [(True, None), (False, None), (False, "https://listings.example/s?id=1&page=2"), (False, None)]


def test_challenge_pages(spark):
    rows = [
        (200, {"cf-mitigated": "Challenge"}, "", True), (202, {"x-amzn-waf-action": "challenge"}, "", True), (202, {}, "window.gokuProps", True),
        (202, {}, "fine", False), (403, {"server": "Cloudflare"}, "<TITLE>Just a moment...", True), (403, {"server": "nginx"}, "<title>Just a moment", False),
        (200, {}, "window.gokuProps", False),
    ]
    df = spark.createDataFrame(rows, "status int, headers map<string,string>, body string, want boolean")
    assert [r[0] for r in df.select(ex.is_challenge_page(F.col("status"), F.col("headers"), F.col("body"))).collect()] == [r[3] for r in rows]


def test_refine_options(spark):
    page = '''<a onclick="refineSearchAction(this,'region','1')">outside</a><div id="location-options"><a onclick="refineSearchAction(this,'region','37')">Hawke&#39;s Bay</a>
      <a onclick="refineSearchAction(this,'state','n')"> North &amp; South </a><a onclick="go()">x</a></div>'''
    rows = ex.refine_options(spark.createDataFrame([(1, page)], "page_id long, html string")).orderBy("position").collect()
    assert [(r.field, r.value, r.label, r.slug) for r in rows] == [("region", "37", "Hawke's Bay", "hawkes-bay"), ("state", "n", "North & South", "north-and-south")]


def test_all_names_and_numbers_like_the_standard_library(spark):
    samples = [f"x &{n} y" for n in html_module.entities.html5] + [f"&{n}z" for n in html_module.entities.html5]
    samples += [f"&#{i};" for i in [*range(300), 0xD800, 0xFDD0, 0xFFFE, 0x10FFFF, 0x110000]]
    samples += ["&#00000065;", "&#x0000041", "&lbrace;", "&amp x", "&&amp;", "a&b=c", "&notit;", "&#;", "&#x;", "&#99999999999999999999999;", "&#xFFFFFFFFFFFFFFFFF;", ""]
    df = spark.createDataFrame([(t,) for t in samples], "t string").select("t", text.decode_entities(F.col("t")).alias("d"))
    assert [(r.t, r.d) for r in df.collect() if r.d != html_module.unescape(r.t)] == []
    links = spark.createDataFrame([("?a=1&region=2",), ("&amp;lt=1",), ("&lt;&copy",), ("&copy1",)], "t string")
    got = [r[0] for r in links.select(text.decode_entities(F.col("t"), in_attribute=True)).collect()]
    assert got == ["?a=1&region=2", "&lt=1", "<\u00a9", "&copy1"]


def test_slugs_of_all_letters(spark):
    def plain(t):
        t = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower().replace("'", "").replace("&", " and ")
        return re.sub(r"[^a-z0-9]+", "-", t).strip("-")

    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    rows = ["".join(f"a{x}b" for x in points[i : i + 50]) for i in range(0, len(points), 50)] + ["Ti\u1ebfng Vi\u1ec7t", "\ufb01ne", "\u2167 x"]
    df = spark.createDataFrame([(t,) for t in rows], "t string").select("t", text.slugify(F.col("t")).alias("s"))
    assert [(r.t, r.s) for r in df.collect() if r.s != plain(r.t)] == []


def test_full_case_folding_of_all_letters(spark):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    rows = ["".join(f"A{x}b" for x in points[i : i + 50]) for i in range(0, len(points), 50)] + ["Straße", "STRASSE", "ΟΔΟΣ", "ﬁne", "", "PLAIN"]
    df = spark.createDataFrame([(t,) for t in rows], "t string").select("t", text.fold_case(F.col("t")).alias("f"))
    assert [(r.t, r.f) for r in df.collect() if r.f != r.t.casefold()] == []
    assert spark.range(1).select(text.fold_case(F.lit(None).cast("string"))).first()[0] is None


def test_entities_like_the_standard_library(spark):
    samples = ["a &amp;amp; b", "&lt;b&gt; &quot;q&quot; &apos;", "&eacute;&Uuml;&euro;", "&#233;&#xE9;&#128054;", "&bogus; & &; &#;", "plain", "&nbsp;x"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    assert [r[0] for r in df.select(text.decode_entities(F.col("s"))).collect()] == [html_module.unescape(s) for s in samples]


@pytest.mark.parametrize("value,want", [("a   b\n", "a b"), ("  ", None), (None, None), ("\x1cx\x85y", "x y")])
def test_normalize_space(spark, value, want):
    df = spark.createDataFrame([(value,)], "s string")
    assert df.select(text.normalize_space(F.col("s"))).first()[0] == want


def test_slugs_and_small_texts(spark):
    labels = ["Manawatū-Whanganui", "Hawke's Bay", "Nelson / Marlborough", "A & B", "Ĳssel ½", "日本 x"]
    df = spark.createDataFrame([(s,) for s in labels], "s string")
    assert [r[0] for r in df.select(text.slugify(F.col("s"))).collect()] == [
        "manawatu-whanganui", "hawkes-bay", "nelson-marlborough", "a-and-b", "ijssel-12", "x"]
    got = spark.range(1).select(
        text.days_text(F.lit(2.5)), text.days_text(F.lit(None).cast("double")), text.body_snippet(F.lit("a  b" * 200)),
        text.safe_error(F.lit("x access_challenge y")), markup.absolute_url(F.lit("https://a.b/c"), "https://d"),
        markup.query_value(F.lit("/s?a=&a=b%20c+d#e"), "a"),
    ).first()
    assert got[0] == "2 days" and got[1] == "-" and len(got[2]) == 303 and got[3] == "access_challenge"
    assert got[4] == "https://a.b/c" and got[5] == "b c d"


def test_slugs_of_long_texts_cost_little(spark):
    """Letters beyond ASCII cost a look-up each, the rest of a text doesn't; letters of two code units stay whole."""
    rows = spark.createDataFrame([(i, "plain words and more of them " * 300 + "é½😀Ā") for i in range(200)], "i int, t string").cache()
    rows.count()

    def seconds(column):
        began = time.perf_counter()
        rows.agg(F.max(column)).collect()
        return time.perf_counter() - began

    assert rows.where("i = 7").select(text.slugify(F.col("t"))).first()[0].endswith("more-of-them-e12a")
    plain = F.regexp_replace(F.lower("t"), "[^a-z0-9]+", "-")
    seconds(plain), seconds(text.slugify(F.col("t")))  # so that code is compiled
    assert min(seconds(text.slugify(F.col("t"))) for _ in range(3)) < 10 * max(seconds(plain) for _ in range(3))
