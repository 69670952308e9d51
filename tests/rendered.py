"""Search pages made of the order lines, to compare the two forms of card extraction."""

from pyspark.sql import functions as F


def rendered_pages(t):
    """Each order line as a search page with two cards and a show-more link.

    The table is one small file, hence one task; parsing is heavy on the
    processor, so the (narrow) lines are dealt out before pages are made of them.
    """
    lines = t.placed_lines.repartition(t.spark.sparkContext.defaultParallelism)
    number, key = F.col("l_linenumber"), F.concat("l_orderkey", "l_linenumber")
    day = F.col("l_shipdate").cast("date")
    stay = (F.col("l_quantity") * 2).cast("int")
    link = F.concat(F.lit("/house-sitting-pet-sitting-job/"), key, F.lit("/home?a=1&amp;b=2"))
    place = (
        F.when(number % 4 == 0, F.col("region"))
        .when(number % 4 == 1, F.concat(F.lit(" - "), "region", F.lit(" - "), "subregion"))
        .when(number % 4 == 2, F.concat("city", F.lit(" - "), "region", F.lit(" - "), "subregion"))
        .otherwise(F.concat("city", F.lit(" - "), "region", F.lit(" - "), "subregion", F.lit(" - East")))
    )
    dates = F.concat(
        F.date_format(day, "d MMM yyyy"), F.lit(" - "),
        F.when(number == 6, F.lit("31 Nonsense")).otherwise(F.date_format(F.date_add(day, stay), "dd MMM yyyy")),
        F.when(number == 5, F.lit(" (approx)")).otherwise(F.lit("")),
    )
    length = (
        F.when(number == 1, F.concat(stay, F.lit(" nights")))
        .when(number == 2, F.concat(F.floor(stay / 7), F.lit(" weeks "), stay % 7, F.lit(" nights")))
        .when(number == 3, F.concat(stay, F.lit(" weeks")))
        .otherwise(F.lit("ask the owner"))
    )
    pets = F.concat(
        F.lit('<ul class="listing-pets"><li><img alt="Dogs" src="d.svg"/><span>'), number % 3, F.lit("</span></li>"),
        F.when(F.col("l_returnflag") == "R", '<li><img alt="Cats"/><span>2</span></li><li><img alt="Llamas &amp; Co"/><span>3</span></li>')
        .when(F.col("l_returnflag") == "A", '<li><img alt="None"/><span>x</span></li><li><img alt="Fish"/></li>')
        .otherwise('<li><img alt="Hedgehogs"/><span>many</span></li><li><img alt="Dogs"/><span> 4 </span></li>'),
        F.lit("</ul>"),
    )
    card = F.concat(
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
    plain = F.concat(
        F.lit('<div class="search-listing"><h3><a href="/house-sitting-pet-sitting-job/9'), key, F.lit('/b">'), "city", F.lit("</a></h3></div>")
    )
    options = F.concat(
        F.lit('<a href="/search?housetype=1"><span class="label">House ('), F.format_number((F.col("l_orderkey") + 1000).cast("int"), 0),
        F.lit(')</span></a><a href="/search?region=33&amp;housetype=2">Flat (7)</a><a href="/search?sitlengths=60&region=1">Short ('), number, F.lit(")</a><a href='/x'>Other (5)</a>"),
    )
    notice = F.when(number == 7, "<h2>And there&#39;s <b>more</b></h2>").otherwise("")
    more = F.concat(F.lit('<div id="showmore1"><a class="b" href="/search?id=7&amp;page='), number, F.lit('">Show more</a></div>'))
    page = F.concat(
        F.lit("<html><body>"), options, F.lit('<div id="results">'), card, plain,
        F.lit('<div class="search-listing"><p>advert</p></div></div>'), notice, F.when(number > 1, more).otherwise(""), F.lit("</body></html>"),
    )
    row_key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return lines.select(row_key.alias("page_id"), page.alias("html"))
