"""URL rules against a plain loop over all rules."""

import random
import re

from listing_lifecycle_spark.llm.queries import URL_RULES
from listing_lifecycle_spark.llm.urls import judge


def plain(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for own, prefix, verdict in rules:
        if own is None or verdict not in ("allow", "block"):
            continue
        own, prefix = re.sub("[A-Z]", lambda m: m[0].lower(), own), prefix or ""
        if (host == own or host.endswith("." + own)) and path.startswith(prefix):
            best = max(best or (-1,), (len(own) + len(prefix), len(own), own + prefix, verdict))
    return host, path, best and best[2], best[3] if best else default


def run(spark, urls, rules, default="allow"):
    pages = spark.createDataFrame([(i, u, "x", "y", i) for i, u in enumerate(urls)], "page_id long, url string, host string, rule string, row long")
    got = judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), default).collect()
    return {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in got}, len(got)


ODD_URLS = [None, "", "no scheme", "://", "http://", "http://org", "HTTP://A.ORG/x", "http://a.org/?q=/es/", "http://example.org/es/#f", "http://x.example.org/en/12?a", "http://notexample.org/es/",
            "http://example.org./es/", "http://.org/", "http://com/de/", "http://a.com/DE/", "http://u@b.com:80/fr/", "x://y://example.org/es/", "http://é.ORG/ü", "http://a.org/" + "p" * 20000, "http://Ä.com/fr/", "http://a.com/fr",
            "http://a\nb.org/c\nd", "http://org/🙂?x", "http://..org//"]


def test_given_rules(spark):
    got, n = run(spark, ODD_URLS, URL_RULES)
    assert n == len(ODD_URLS)
    assert got == {i: plain(u, URL_RULES) for i, u in enumerate(ODD_URLS)}


def test_random_rules(spark):
    r = random.Random(4)
    host = lambda: ".".join(r.choices(["a", "b", "cc", "A", ""], k=r.randint(1, 4)))
    path = lambda: r.choice(["", "/"]) and "/" + "".join(r.choices("ab/é", k=r.randint(0, 5)))
    rules = list({(host(), path(), v) for v in ("allow", "block") for _ in range(60)}) + [(None, "/", "block"), ("a", None, "block"), ("b", "x", "block"), ("b", "/", None), ("cc", "", "other")]
    urls = ["http://" + host() + path() + r.choice(["", "?q", "#f"]) for _ in range(1500)]
    got, _ = run(spark, urls, rules, "block")
    assert got == {i: plain(u, rules, "block") for i, u in enumerate(urls)}


def test_repeated_rows_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://org/")] * 3 + [(None, None)], "page_id long, url string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    assert sorted((x.page_id or 0, x.rule) for x in judge(pages, rules).collect()) == [(0, None)] + [(1, "org/")] * 3
    assert judge(pages.limit(0), rules).collect() == []
    assert {(x.rule, x.verdict) for x in judge(pages, rules.limit(0)).collect()} == {(None, "allow")}
