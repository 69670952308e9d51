"""Resampling against plain loops, and ranks by regular sampling against a plain sort."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from listing_lifecycle_spark.llm import ranks, resample
from tests.llm.conftest import ODD


def plain_features(text, longest):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
    return len(words), [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute(rows, target, percent, least_words, longest, buckets, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in plain_features(t, longest)[1])
    t = Counter(bucket(f) for x in target for f in plain_features(x, longest)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)}
    out = []
    for i, text in rows:
        n_words, own = plain_features(text, longest)
        weight = sum(gain[bucket(f)] for f in own) // max(len(own), 1)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(own), weight, score, None, n_words >= least_words and i is not None])
    part = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0]))
    for place, r in enumerate(part[: percent * len(part) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("longest,buckets,segment_rows", [(1, 10000, 7), (3, 50, 1000)])
def test_equals_plain_loops(spark, texts_table, monkeypatch, longest, buckets, segment_rows):
    monkeypatch.setattr(ranks, "SEGMENT_ROWS", segment_rows)
    monkeypatch.setattr(ranks.ranked, "__defaults__", (segment_rows,))
    r = random.Random(longest)
    vocabulary = ["w%d" % i for i in range(50)] + ["Straße", "été,", "中文", "a-b", "X_y"]
    rows = [(i * 3, " ".join(r.choices(vocabulary, k=r.randint(0, 60)))) for i in range(300)] + ODD + [(77, "same words " * 30)] * 9
    target = [" ".join(r.choices(vocabulary[:10], k=30)) for _ in range(20)] + [None, ""]
    got = resample.resample(texts_table(rows), spark.createDataFrame([(t, 1, 2) for t in target], "text string, weight int, doc_id int"), 10, 20, longest, buckets)
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(rows, target, 10, 20, longest, buckets, 2024)


def test_empty_tables(spark, texts_table):
    none = texts_table([])
    assert resample.resample(none, none).collect() == []
    got = resample.resample(texts_table([(1, "a b"), (2, None)]), none, percent=100, least_words=1).collect()
    assert [(x.doc_id, x.n_features, x.rank) for x in sorted(got)] == [(1, 2, 1), (2, 0, None)]


@pytest.mark.parametrize("wanted", [0, 1, 499, 5000])
def test_ranks_equal_a_plain_sort(spark, wanted):
    """Many ties, a third of all rows equal in all but the last key, more partitions than segments and fewer."""
    for parts in (3, 40):
        rows = spark.range(0, 3000, numPartitions=parts).select(
            F.when(F.col("id") % 3 == 0, 5).otherwise(F.pmod(F.xxhash64("id"), F.lit(40))).alias("a"),
            F.when(F.col("id") % 3 == 0, 5).otherwise(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(7))).alias("b"),
            F.col("id").alias("c"), (F.col("id") % 10 > 0).alias("takes_part"),
        )
        want = sorted((x.a, x.b, x.c) for x in rows.collect() if x.takes_part)
        got = ranks.ranked(rows, ["a", "b", "c"], wanted, len(want), segment_rows=100).collect()
        assert len(got) == 3000
        assert [(x.a, x.b, x.c) for x in sorted((x for x in got if x["rank"]), key=lambda x: x["rank"])] == want[:wanted]
        assert sorted(x["rank"] for x in got if x["rank"]) == list(range(1, min(wanted, len(want)) + 1))


def test_segments_are_even(spark):
    """No segment holds much more than its share, also with a third of all rows tied."""
    rows = spark.range(0, 20000, numPartitions=16).select((F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 1000)).alias("a"), "id", F.lit(True).alias("takes_part"))
    sizes = ranks.ranked(rows, ["a", "id"], 20000, 20000, segment_rows=1000).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 16 and max(x["count"] for x in sizes) < 2500
