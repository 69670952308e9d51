"""Near-duplicate documents with an LSH forest.

Minimum hashes of a document's shingle set are read in several orders ("trees").  In each, documents are sorted by their
sequence of hashes, and the neighbours with the longest common prefix are candidates.  Documents that meet in a short
prefix are split by as deep a prefix as it takes to leave a region small enough for one task.  Candidates whose
signatures allow the similarity are confirmed on full sets; links make components.  Equal sets are one class from the
start, so copies cost nothing.

A region with more rows than a row has neighbours may hold links that the sorted order did not show.  There, in tiles of
two blocks, the rows outside the region's largest component are compared with all of its rows.  A first pass names the
rows with a pair in question, a second brings their full sets to the tile, confirms there and returns a forest of links,
so neither returns more rows than a tile has.  Shingles that no other candidate has can't be common, which rules most
such pairs out first.  So every pair with a common prefix of ``LEAST`` hashes is either confirmed or in one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listing_lifecycle_spark.llm.arrow_text import release, slices, stored
from listing_lifecycle_spark.llm.components import components
from listing_lifecycle_spark.llm.shingles import digest, minimum_hashes, shared, shingle_sets

TREES = 16
DEPTH = 6  # hashes of each tree
WIDTH = 2  # bytes of a hash; marks keep 4 bits of it
LEAST = 3  # hashes that candidates share at least
NEIGHBOURS = 4  # rows before a row, in sorted order, that it is compared with
BLOCK = 1024  # rows of a large region that are compared at once with as many others
BLOCK_SHINGLES = 1 << 19  # and their shingles: 4 MB of sets
LARGE = 4 << 20  # bytes of a tile after which a worker gives memory back
HOT = 4096  # rows that a region may hold before it is split by a deeper prefix
SMALL = 500_000  # ids that may be broadcast
SIGMAS = 4.6  # how far below the threshold an estimate may lie


def _sign(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        value, offsets = shingle_sets(batch.column(1), width)
        minima = minimum_hashes(value, offsets, TREES * DEPTH) & 0xFFFF
        signature, marks = minima.astype(">u2"), (minima[:, ::2] & 15 | (minima[:, 1::2] & 15) << 4).astype(np.uint8)
        names = [digest(value[a:b]) if b > a else None for a, b in zip(offsets, offsets[1:])]
        columns = [batch.column(0), pa.array(np.diff(offsets)), pa.array(names, pa.binary()), *[pa.array([x.tobytes() for x in m], pa.binary()) for m in (signature, marks)]]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "signature", "marks"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        value, offsets = shingle_sets(batch.column(1), width)
        parts = [value[a:b] for a, b in zip(offsets, offsets[1:])]
        columns = [pa.array([digest(p) for p in parts], pa.binary()), pa.array([p.tobytes() for p in parts], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["digest", "shingles"])


def least_alike(part: int, whole: int, values: int = 16) -> float:
    """The share of equal hashes of ``values`` values below which a pair can't be as similar as ``part`` / ``whole``."""
    equal = part / whole + (1 - part / whole) / values
    return max(0.0, equal - SIGMAS * float(np.sqrt(equal * (1 - equal) / (TREES * DEPTH))))


def _neighbours(batches: Iterator[pa.RecordBatch], part: int, whole: int) -> Iterator[pa.RecordBatch]:
    """Candidates among rows sorted by tree and hashes: class, n, tree, key, signature bytes."""
    least, before = least_alike(part, whole), None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, n, tree = (batch.column(i).to_numpy() for i in (0, 1, 2))
        key = np.frombuffer(b"".join(x[: WIDTH * LEAST] for x in batch.column(3).to_pylist()), f"V{WIDTH * LEAST}")
        marks = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, TREES * DEPTH // 2)
        own = [ids, n, tree, key, marks]
        if before is not None:
            own = [np.concatenate([a, b]) for a, b in zip(before, own)]
        old = 0 if before is None else len(before[0])
        ids, n, tree, key, marks = own
        for lag in range(1, NEIGHBOURS + 1):
            at = np.arange(max(old, lag), len(ids))
            at = at[(tree[at] == tree[at - lag]) & (key[at] == key[at - lag])]
            small, large = np.minimum(n[at], n[at - lag]), np.maximum(n[at], n[at - lag])
            at = at[whole * small >= part * large]
            odd = marks[at] ^ marks[at - lag]
            alike = (((odd & 15) == 0).sum(axis=1) + ((odd >> 4) == 0).sum(axis=1)) / (TREES * DEPTH)
            at, alike = at[alike >= least], alike[alike >= least]
            if len(at):
                a, b = ids[at], ids[at - lag]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(alike)], ["a", "b", "alike"])
        before = [x[-NEIGHBOURS:].copy() for x in own]
    release()


def _confirm(batches: Iterator[pa.RecordBatch], part: int, whole: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = shared(x, y)
            linked.append(whole * both >= part * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))
    release()


def few(rows: DataFrame, bound: int = SMALL) -> DataFrame:
    """``rows``, marked for broadcast if they are ``bound`` at most."""
    return F.broadcast(rows) if rows.limit(bound + 1).count() <= bound else rows


def tree_rows(classes: DataFrame, *more: str) -> DataFrame:
    """A row for each class and tree: class, n, tree, prefix, key and ``more`` columns of ``classes``."""
    rows = classes.select("class", "n", "signature", *more, F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    key = F.expr(f"substring(signature, tree * {WIDTH * DEPTH} + 1, {WIDTH * DEPTH})")
    return rows.withColumn("key", key).withColumn("prefix", F.substring("key", 1, WIDTH * LEAST))


def with_regions(rows: DataFrame, crowds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the prefix that keeps a region together: of ``LEAST`` hashes, deeper where more than ``HOT`` rows meet.

    Also the regions that stay too large with all hashes: their rows, equal in this order, are dealt to parts.
    """
    rows, hot = rows.withColumn("region", F.col("prefix")), crowds.where(F.col("size") > HOT).select("tree", F.col("prefix").alias("region"), F.col("size").alias("count"))
    for depth in range(LEAST + 1, DEPTH + 1):
        if hot.isEmpty():  # there are at most rows / HOT hot regions
            return rows, hot
        rows = rows.join(few(hot.select("tree", "region")).withColumn("hot", F.lit(True)), ["tree", "region"], "left")
        rows = rows.withColumn("region", F.when(F.col("hot"), F.substring("key", 1, WIDTH * depth)).otherwise(F.col("region"))).drop("hot")
        deeper = rows.where(F.octet_length("region") == WIDTH * depth).groupBy("tree", "region").count()
        hot = stored(deeper.where(F.col("count") > HOT).select("tree", "region", "count"), "regions")
    return rows, hot


def candidates(classes: DataFrame, crowds: DataFrame, part: int, whole: int) -> DataFrame:
    """a, b, alike: pairs of classes that are neighbours in a tree and whose marks allow the similarity.

    The parts of a region of equal hashes are bridged: the first row of each part is a candidate with the first of all.
    """
    rows, hot = with_regions(tree_rows(classes, "marks").drop("signature"), crowds)
    rows = rows.drop("prefix").withColumn("part", F.lit(0).cast("long"))
    bridges = None
    if not hot.isEmpty():
        dealt = F.pmod(F.xxhash64("class"), F.ceil(F.col("count") / HOT))
        rows = rows.join(few(hot), ["tree", "region"], "left").withColumn("part", F.coalesce(dealt, "part")).drop("count")
        firsts = rows.join(few(hot.select("tree", "region")), ["tree", "region"]).groupBy("tree", "region", "part").agg(F.min("class").alias("b"))
        ends = firsts.join(firsts.groupBy("tree", "region").agg(F.min("b").alias("a")), ["tree", "region"])
        bridges = ends.where("a <> b").select("a", "b", F.lit(1.0).alias("alike"))
    rows = rows.repartition("tree", "region", "part").sortWithinPartitions("tree", "key", "part", "class")
    found = rows.select("class", "n", "tree", "key", "marks").mapInArrow(partial(_neighbours, part=part, whole=whole), "a bigint, b bigint, alike double")
    return (found.union(bridges) if bridges is not None else found).groupBy("a", "b").agg(F.max("alike").alias("alike"))


def linked(pairs: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    left, right = sets.select(F.col("class").alias("a"), F.col("shingles").alias("left")), sets.select(F.col("class").alias("b"), F.col("shingles").alias("right"))
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return rows.mapInArrow(partial(_confirm, part=part, whole=whole), "a bigint, b bigint")


def with_labels(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``pairs`` with the labels of both ends; an id without a label is its own."""
    for end in ("a", "b"):
        own = labels.select(F.col("id").alias(end), F.col("label").alias(f"label_{end}"))
        pairs = pairs.join(own, end, "left").withColumn(f"label_{end}", F.coalesce(f"label_{end}", end))
    return pairs


def least_pair(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def best_of(pairs: DataFrame) -> DataFrame:
    """Every class with its most similar candidate, as distinct pairs."""
    both = pairs.select("a", "b", "alike").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "alike"))
    best = both.groupBy("a").agg(F.max(F.struct("alike", (-F.col("b")).alias("b"))).alias("top"))
    return best.select(*least_pair(F.col("a"), -F.col("top.b"))).distinct()


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further ``links`` between classes; ``links`` is a stored table."""
    if links.isEmpty():
        return labels
    tops = components(with_labels(links, labels).select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
    known = labels.union(links.select("a", "a")).union(links.select("b", "b")).groupBy("id").agg(F.min("label").alias("label"))
    known = known.join(labels.select("id", F.col("label").alias("own")), "id", "left").select("id", F.coalesce("own", "label").alias("label"))
    tops = tops.select(F.col("id").alias("label"), F.col("label").alias("top"))
    return stored(known.join(tops, "label", "left").select("id", F.coalesce("top", "label").alias("label")), "labels")


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            own = batch.slice(begin, 256)
            sets = [np.frombuffer(x, np.uint64) for x in own.column(1).to_pylist()]
            shingle = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own.column(0).to_numpy(), [len(x) for x in sets])), pa.array(shingle)], ["class", "shingle"])


def shareable(sets: DataFrame) -> DataFrame:
    """class, n, s: size of each set, and how many of its shingles any other set has (or may have, by half its hash)."""
    rows = sets.select("class", "shingles").mapInArrow(_shingle_rows, "class bigint, shingle int")
    alone = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("times"), F.min("class").alias("class")).where("times = 1")
    rare = alone.groupBy("class").agg(F.count(F.lit(1)).alias("rare"))
    n = sets.select("class", (F.octet_length("shingles") / 8).cast("long").alias("n"))
    return n.join(rare, "class", "left").select("class", "n", (F.col("n") - F.coalesce("rare", F.lit(0))).alias("s"))


def reachable(pairs: DataFrame, sizes: DataFrame, part: int, whole: int) -> DataFrame:
    """The pairs whose common shingles, at most those that others have, can be enough."""
    for end in ("a", "b"):
        pairs = pairs.join(few(sizes.select(F.col("class").alias(end), F.col("n").alias(f"n_{end}"), F.col("s").alias(f"s_{end}"))), end)
    most = F.least("s_a", "s_b")
    return pairs.where(whole * most >= part * (F.col("n_a") + F.col("n_b") - most)).select("a", "b", "alike")


def _possible(left: pa.Table, right: pa.Table, part: int, whole: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each outer row of a tile with those rows of the region that may be linked with it and bear another label.

    A pair that meets in an earlier tree is left to that tree, and of two outer rows the one of less number takes the pair.
    """
    least, tree = least_alike(part, whole, 1 << 8 * WIDTH), left.column("outer_tree")[0].as_py()
    sides = (("outer", left), ("row", right))
    signs = [np.frombuffer(b"".join(t.column(f"{side}_signature").to_pylist()), np.uint16).reshape(-1, TREES, DEPTH) for side, t in sides]
    (ids, label, n, s), (ids_r, label_r, n_r, s_r) = ([t.column(f"{side}_{c}").to_numpy() for c in ("class", "label", "n", "s")] for side, t in sides)
    outer_r = right.column("row_is_outer").to_numpy(zero_copy_only=False)
    for i in range(len(ids)):
        most = np.where((s_r >= 0) & (s[i] >= 0), np.minimum(s_r, s[i]), np.minimum(n_r, n[i]))
        at = np.flatnonzero((label_r != label[i]) & (~outer_r | (ids_r > ids[i])) & (whole * most >= part * (n_r + n[i] - most)))
        same = signs[1][at] == signs[0][i]
        fine = (same.mean(axis=(1, 2)) >= least) & ~same[:, :tree, :LEAST].all(axis=2).any(axis=1) if len(at) else np.zeros(0, bool)
        if fine.any():
            yield i, at[fine]


def _in_question(left: pa.Table, right: pa.Table, part: int, whole: int) -> pa.Table:
    """The rows of a tile that have a pair to be confirmed, once each: tile, side and class."""
    names, schema = ("tree", "prefix", "place", "block"), pa.schema([("tree", pa.int32()), ("prefix", pa.binary()), ("place", pa.int64()), ("block", pa.int64()), ("is_left", pa.bool_()), ("class", pa.int64())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    first, second = np.zeros(left.num_rows, bool), np.zeros(right.num_rows, bool)
    for i, at in _possible(left, right, part, whole):
        first[i] = second[at] = True
    ids = np.concatenate([left.column("outer_class").to_numpy()[first], right.column("row_class").to_numpy()[second]])
    tile = [pa.array([left.column(f"outer_{c}")[0].as_py()] * len(ids), schema.field(c).type) for c in names]
    return pa.Table.from_arrays([*tile, pa.array(np.arange(len(ids)) < first.sum()), pa.array(ids)], schema=schema)


def _forest(left: pa.Table, right: pa.Table, part: int, whole: int) -> pa.Table:
    """Links of a tile confirmed on full sets, no more than it takes to join what they join: fewer than the tile has rows."""
    schema, links = pa.schema([("a", pa.int64()), ("b", pa.int64())]), []
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    sets = [[np.frombuffer(x.as_buffer(), np.uint64) for x in t.column(c)] for t, c in ((left, "outer_shingles"), (right, "row_shingles"))]
    (ids, label), (ids_r, label_r) = ([t.column(f"{side}_{c}").to_pylist() for c in ("class", "label")] for side, t in (("outer", left), ("row", right)))
    parent = {x: x for x in [*label, *label_r]}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, at in _possible(left, right, part, whole):
        x, own = sets[0][i], label[i]
        for j in at.tolist():
            if top(own) != top(label_r[j]):
                both = shared(x, sets[1][j])
                if whole * both >= part * (len(x) + len(sets[1][j]) - both):
                    parent[top(own)] = top(label_r[j])
                    links.append((ids[i], ids_r[j]))
    del sets
    if left.nbytes + right.nbytes > LARGE:
        release()
    a, b = np.array(links, np.int64).reshape(-1, 2).T
    return pa.Table.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)


def crowd_tiles(classes: DataFrame, crowds: DataFrame, sizes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """The rows of regions with more rows than a row has neighbours, where they are not in one component yet, in tiles;
    None if there are no such regions.

    Outer rows, which are not in the region's largest component, meet all rows of the region: a tile is a block of each,
    of about ``BLOCK`` rows and ``BLOCK_SHINGLES`` shingles.
    """
    keys = ["tree", "prefix"]
    rows = tree_rows(classes).drop("key").join(few(crowds), keys)
    own = few(labels.select(F.col("id").alias("class"), "label"))
    rows = rows.join(own, "class", "left").withColumn("label", F.coalesce("label", "class"))
    rows = rows.join(few(sizes.select("class", "s")), "class", "left").withColumn("s", F.coalesce("s", F.lit(-1)))
    narrow = rows.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    most = F.max(F.struct("rows", "label", "shingles")).alias("top")
    regions = narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("labels"), most, F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"))
    blocks = lambda n, shingles: F.greatest(F.ceil(n / BLOCK), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("long")
    outers = blocks(F.col("rows") - F.col("top.rows"), F.col("shingles") - F.col("top.shingles"))
    regions = regions.where("labels > 1").select(*keys, F.col("top.label").alias("top"), blocks(F.col("rows"), F.col("shingles")).alias("blocks"), outers.alias("outers"))
    regions = stored(regions, "regions")
    if regions.isEmpty():
        return None
    rows = rows.join(few(regions), keys).withColumn("is_outer", F.col("label") != F.col("top"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("class"), F.col(n))
    name = lambda side: [F.col(c).alias(f"{side}_{c}") for c in ("class", "label", "n", "s", "is_outer", "signature", "tree", "prefix")]
    outer = rows.where("is_outer").select(*name("outer"), deal("outers").alias("outer_place"), each("blocks").alias("outer_block"))
    return outer, rows.select(*name("row"), each("outers").alias("row_place"), deal("blocks").alias("row_block"))


def tiled(outer: DataFrame, every: DataFrame, fn, schema: str) -> DataFrame:
    groups = [t.groupBy(*[f"{side}_{c}" for c in ("tree", "prefix", "place", "block")]) for t, side in ((outer, "outer"), (every, "row"))]
    return groups[0].cogroup(groups[1]).applyInArrow(fn, schema)


def crowded(tiles: tuple[DataFrame, DataFrame], asked: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """a, b: links in tiles that join components.  Only the rows of ``asked`` go to their tile again, now with full sets."""
    full = []
    for side, t, is_left in (("outer", tiles[0], True), ("row", tiles[1], False)):
        names = {c: f"{side}_{c}" for c in ("tree", "prefix", "place", "block", "class")}
        own = asked.where(F.col("is_left") == is_left).select(*[F.col(c).alias(n) for c, n in names.items()])
        own = own.join(sets.select(F.col("class").alias(names["class"]), F.col("shingles").alias(f"{side}_shingles")), names["class"])
        full.append(t.join(own, list(names.values())))
    return tiled(*full, partial(_forest, part=part, whole=whole), "a long, b long").distinct()


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()


def sets_of(read: DataFrame, one: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """class, shingles: full sets of some classes, worked out anew from the texts of their documents."""
    needed = stored(one.join(classes, "class").select("class", "doc_id", "digest"), "needed")
    texts = read.join(few(needed.select("doc_id").distinct()), "doc_id", "left_semi")
    sets = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(partial(_sets, width=width), "digest binary, shingles binary")
    return stored(sets.join(few(needed.select("digest", "class")), "digest").dropDuplicates(["class"]).select("class", "shingles"), "sets")


def near_duplicates(docs: DataFrame, width: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """Group near-duplicate documents: doc_id, n_shingles, component_id, kept.

    A document's set holds its distinct shingles of ``width`` words (A-Z lower-cased), the whole sequence if it has
    fewer words.  Documents are linked if ``whole`` * intersection >= ``part`` * union.  component_id is the least
    doc_id reachable over links; ``kept`` says that it is the document's own.  A row for each row of ``docs``: texts that
    are null, empty or blank have no set and are linked with nothing, nor are rows without doc_id (component_id null,
    kept).  Repeated rows are copies of each other and have the same id, so all of them have the same ``kept``.
    A pair of similarity s meets in a tree with probability 1 - (1 - s^3)^16: 0.9999998 at 0.85, 0.99999 at 0.8.
    """
    read = docs.select("doc_id", "text")
    signed = read.mapInArrow(partial(_sign, width=width), "doc_id bigint, n_shingles bigint, digest binary, signature binary, marks binary")
    signed = stored(signed.withColumn("row", F.monotonically_increasing_id()), "signatures")
    filled = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy("digest").agg(F.min("row").alias("class"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    one = filled.select(F.col("row").alias("class"), F.col("n_shingles").alias("n"), "signature", "marks", "digest", "doc_id")
    classes = stored(classes, "classes")
    own = stored(one.drop("digest", "doc_id").join(classes.select("class"), "class"), "signatures")
    counts = tree_rows(own).groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("size"))
    crowds = stored(counts.where(F.col("size") > NEIGHBOURS + 1), "crowds")
    pairs = stored(candidates(own, crowds, part, whole), "pairs")
    sets = sets_of(read, one, ends_of(pairs), width)
    sizes = stored(shareable(sets), "sizes")
    pairs = stored(reachable(pairs, sizes, part, whole), "pairs")
    first = stored(linked(best_of(pairs), sets, part, whole), "links")
    labels = merged(first.limit(0).select(F.col("a").alias("id"), F.col("b").alias("label")), first)
    # Pairs inside a component can change nothing; all others are confirmed, so no link between components is missed.
    rest = with_labels(pairs.join(best_of(pairs), ["a", "b"], "left_anti"), labels).where("label_a <> label_b")
    labels = merged(labels, stored(linked(rest, sets, part, whole), "links"))
    tiles = crowd_tiles(own, crowds, sizes, labels)
    if tiles:
        asked = stored(tiled(*tiles, partial(_in_question, part=part, whole=whole), "tree int, prefix binary, place long, block long, is_left boolean, class long"), "asked")
        more = asked.select("class").distinct().join(sets, "class", "left_anti")
        if not more.isEmpty():
            sets = sets.union(sets_of(read, one, more, width))
        labels = merged(labels, stored(crowded(tiles, asked, sets, part, whole), "links"))
    named = classes.join(labels.select(F.col("id").alias("class"), "label"), "class", "left")
    tops = named.where("label IS NOT NULL").groupBy("label").agg(F.min("least").alias("top"))
    grouped = named.where("label IS NOT NULL OR copies > 1").join(tops, "label", "left").select("digest", F.coalesce("top", "least").alias("component"))
    out = signed.join(grouped, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))

