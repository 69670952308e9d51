"""Exact top-k search: tiles of a query block times a base shard, partial selection per tile, tree merging of top lists.

Queries are dealt to blocks and base vectors to shards by hash; one cogroup is one tile of bounded size.  A tile is
worked through in strips of queries as matrix products, and keeps only its k best per query.  The lists of a query meet
in a tree: every level merges the lists of ``FAN`` neighbouring shards, so no group ever holds more than FAN * k entries.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN = 16
STRIP = 256
LONG = 2**63 - 1


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """id, vec: components as floor(scale * x).  Rows without id, and vectors that are null, empty or hold a null or
    non-finite component, are left out; of several rows with one id the least vector stays."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: F.coalesce(F.abs(v) < F.lit(math.inf), F.lit(False)))
    rows = vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))).alias("vec"))
    return rows.groupBy("id").agg(F.min("vec").alias("vec"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact; results beyond a long are held at its ends."""
    top_a, top_b = (max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0)))) for m in (a, b))
    bound = top_a * top_b * a.shape[1]
    if bound < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound <= LONG:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -LONG, LONG).astype(np.int64)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k highest scores, ties to the left, in order."""
    n = scores.shape[1]
    top = max(abs(int(scores.max(initial=0))), abs(int(scores.min(initial=0)))) + 1
    if top * n <= LONG:
        key = scores * n + np.arange(n - 1, -1, -1)  # no two of a row are equal
        if k < n:
            part = np.argpartition(key, n - k, axis=1)[:, n - k :]
            order = np.argsort(-np.take_along_axis(key, part, 1), axis=1)
            return np.take_along_axis(part, order, 1)
        return np.argsort(-key, axis=1)
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def _by_length(table: pa.Table, side: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids in ascending order and the matrix of their vectors, for each vector length."""
    ids, lists = table.column(f"{side}_id").to_numpy(), table.column(f"{side}_vec").combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    lengths, begin = np.diff(lists.offsets.to_numpy()), lists.offsets.to_numpy()[:-1]
    values, out = lists.values.to_numpy(zero_copy_only=False).astype(np.int64), {}
    for size in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == size)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        out[size] = ids[rows], values[begin[rows][:, None] + np.arange(size)]
    return out


def _tile(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    schema = pa.schema([("query_id", pa.int64()), ("shard", pa.int64()), ("best", pa.list_(pa.struct([("neg", pa.int64()), ("vec_id", pa.int64())])))])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    shard, base, parts = right.column("shard")[0].as_py(), _by_length(right, "base"), []
    for size, (query_ids, queries) in _by_length(left, "query").items():
        ids, matrix = base.get(size, (np.zeros(0, np.int64), None))
        for begin in range(0, len(query_ids) if len(ids) else 0, STRIP):
            own, scores = query_ids[begin : begin + STRIP], products(queries[begin : begin + STRIP], matrix)
            columns = best(scores, min(k + 1, len(ids)))  # one more, as the query's own row may be among them
            found, score = ids[columns], np.take_along_axis(scores, columns, 1)
            keep = found != own[:, None]
            keep &= np.cumsum(keep, axis=1) <= k
            entry = pa.StructArray.from_arrays([pa.array(-score[keep]), pa.array(found[keep])], ["neg", "vec_id"])
            edges = np.concatenate([[0], np.cumsum(keep.sum(axis=1))])
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), entry)
            parts.append(pa.Table.from_arrays([pa.array(own), pa.array(np.full(len(own), shard)), lists], schema=schema))
    return pa.concat_tables(parts) if parts else schema.empty_table()


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 8192, shard_rows: int = 8192) -> DataFrame:
    """For every row of ``vectors`` with ``is_query`` (on ``id``): its ``k`` highest inner products with all other rows.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id; all candidates if there are fewer
    than ``k``.  Vectors that are null, empty or hold a null or non-finite component take no part, nor do rows without
    id; rows of one id count as one (its least vector), which is never its own candidate; vectors are compared with
    those of the same length only.  An empty table gives no rows.
    """
    rows = scaled(vectors, id_col, vector_col, scale)
    size = rows.agg(F.count(F.lit(1)).alias("all"), F.count(F.when(is_query, 1)).alias("queries")).first()
    shards, blocks = max(1, math.ceil(size["all"] / shard_rows)), max(1, math.ceil(size["queries"] / block_rows))
    number = F.xxhash64("id", F.lit(7))
    queries = rows.where(is_query).select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"), F.pmod(number, F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    base = rows.select(F.col("id").alias("base_id"), F.col("vec").alias("base_vec"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(number, F.lit(shards)).alias("shard"))
    keys = ("block", "shard")
    tiles = queries.groupBy(*keys).cogroup(base.groupBy(*keys)).applyInArrow(partial(_tile, k=k), "query_id long, shard long, best array<struct<neg:long,vec_id:long>>")
    while shards > 1:
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best")
        tiles = tiles.groupBy("query_id", F.floor(F.col("shard") / FAN).alias("shard")).agg(merged)
        shards = math.ceil(shards / FAN)
    found = tiles.select("query_id", F.posexplode("best").alias("place", "hit"))
    return found.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.neg")).alias("score"))
