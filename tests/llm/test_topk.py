"""Exact top-k search against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from listing_lifecycle_spark.llm import topk

SCHEMA = "vec_id bigint, embedding array<double>, label int, query_id bigint, rank string"


def brute(rows, k, is_query):
    fine = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            ints = [math.floor(64 * x) for x in v]
            fine[i] = min(fine[i], ints) if i in fine else ints
    out = set()
    for q, a in fine.items():
        if is_query(q):
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine.items() if i != q and len(a) == len(b))
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("shard_rows,block_rows", [(8192, 8192), (7, 3)])
def test_equals_brute_force(spark, monkeypatch, shard_rows, block_rows):
    monkeypatch.setattr(topk, "FAN", 4)
    random = np.random.default_rng(1)
    rows = [(i, np.round(random.normal(size=4), 1).tolist()) for i in range(150)]
    rows += [(i, [1.0, 0.5, 0.0, 0.0]) for i in range(150, 190)]  # ties
    rows += [(200, None), (None, [1.0] * 4), (201, []), (202, [1.0, None, 0.0, 0.0]), (203, [math.nan] * 4), (205, [math.inf] * 4), (20, [9.0] * 4), (206, [1.0, 2.0]), (210, [2.0, 1.0])]
    table = spark.createDataFrame([(*r, 0, 1, "x") for r in rows], SCHEMA)
    got = topk.search(table, F.col("id") % 5 == 0, k=6, shard_rows=shard_rows, block_rows=block_rows)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute(rows, 6, lambda i: i % 5 == 0)


def test_empty_and_few(spark):
    assert topk.search(spark.createDataFrame([], SCHEMA), F.col("id") % 5 == 0).count() == 0
    two = spark.createDataFrame([(5, [1.0], 0, 0, ""), (6, [2.0], 0, 0, "")], SCHEMA)
    assert [tuple(r) for r in topk.search(two, F.col("id") % 5 == 0).collect()] == [(5, 1, 6, 64 * 128)]


def test_large_integers_stay_exact():
    a = np.array([[2**40, 3], [-(2**40), 1]])
    assert topk.products(a, a).tolist() == [[2**63 - 1, -(2**63 - 1)], [-(2**63 - 1), 2**63 - 1]]
    b = np.array([[2**30, 1], [2**30, -1]])
    assert topk.products(b, b).tolist() == [[2**60 + 1, 2**60 - 1], [2**60 - 1, 2**60 + 1]]
    assert topk.best(np.array([[2**62, 5, 2**62, 7]]), 2).tolist() == [[0, 2]]
