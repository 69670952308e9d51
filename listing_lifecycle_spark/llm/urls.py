"""URL rules by hash: host suffixes and path prefixes of each URL meet the rules on a short hash prefix.

Every rule is one expression, host and path, known by its SHA-256.  A URL is expanded into those combinations of a host
suffix and a path prefix that have the shape (labels, path length) of some rule; they meet the rules on the first 32
bits of the hash, full digests confirm, and the longest rule wins.  All in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listing_lifecycle_spark.llm.arrow_text import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORT = 8  # hex digits of a digest that rows are joined on


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://``: the host up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased, and the path from
    there up to ``?``, ``#`` or the end.  Both are empty for a null URL or one without ``://``."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring_index(url, "://", 1))
    rest = F.coalesce(F.substring(url, F.char_length(rest) + 4, F.char_length(url)), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def digest(host: Column, path: Column) -> Column:
    """SHA-256 of an expression.  A host has no slash and a path begins with one, so the two can't run together."""
    return F.sha2(F.concat(host, path), 256)


def labels(host: Column) -> Column:
    return F.size(F.split(host, r"\.", -1))


def prepared(rules: DataFrame) -> DataFrame:
    """digest, rule, verdict, host_length, labels, length of each distinct rule; ``block`` wins over ``allow``."""
    host, path = F.translate("host", UPPER, LOWER), F.coalesce("path", F.lit(""))
    fine = rules.where("host IS NOT NULL AND verdict IN ('allow', 'block')").select(host.alias("host"), path.alias("path"), "verdict")
    fine = fine.where("path = '' OR path LIKE '/%'").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # 'block' > 'allow'
    shape = {"labels": labels(F.col("host")), "length": F.char_length("path"), "host_length": F.char_length("host")}
    return fine.withColumns(shape | {"digest": digest(F.col("host"), F.col("path")), "rule": F.concat("host", "path")})


def expressions(urls: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """row, prefix, digest: the expressions of each URL that have one of the ``shapes`` (labels, path length)."""
    every = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("length")) for a, b in shapes])
    own = F.filter(every, lambda s: (s["labels"] <= labels(F.col("host"))) & (s["length"] <= F.char_length("path")))
    suffix = lambda s: F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"])
    prefix = lambda s: F.substring(F.col("path"), F.lit(1), s["length"])
    rows = urls.select("row", F.explode(F.transform(own, lambda s: digest(suffix(s), prefix(s)))).alias("digest"))
    return rows.withColumn("prefix", F.substring("digest", 1, SHORT))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url; other columns are not read).

    ``rules`` has host, path and verdict (allow or block).  A rule fits its host and all subdomains if the URL's path
    starts with the rule's (letter by letter); the longest fitting rule wins, of equally long ones that with the longer
    host, of equal ones block.  Without a fitting rule ``rule`` is null and the verdict is ``default``.  Rules without
    host, with another verdict or with a path that begins with no slash (no URL has such a path) are left out.  A null
    URL or one without ``://`` has an empty host and path.  Repeated rows and null page_ids stay; an empty table gives none.

    The distinct shapes of the rules reach the driver: a pair for each number of labels and path length in use.
    """
    host, path = host_and_path(F.col("url"))
    urls = stored(pages.select(F.monotonically_increasing_id().alias("row"), "page_id", host.alias("host"), path.alias("path")), "urls")
    own = prepared(rules)
    shapes = [tuple(s) for s in own.select("labels", "length").distinct().collect()]
    none = [F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")]
    if not shapes:
        return urls.select("page_id", "host", "path", *none)
    known = own.select(F.substring("digest", 1, SHORT).alias("prefix"), F.col("digest").alias("full"), "rule", "verdict", "host_length")
    hits = expressions(urls, shapes).join(known, "prefix").where("digest = full")
    order = F.struct(F.char_length("rule").alias("length"), "host_length", "rule", "verdict")
    best = hits.groupBy("row").agg(F.max(order).alias("best"))
    judged = urls.join(best, "row", "left")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
