"""A log in parts, with a filter for each part, so that only parts are read that may hold a wanted key.

Every commit to a log is a part of its own.  Beside it lies a blocked Bloom filter of its keys: a key goes to one block of
32,768 bits and sets ``HASHES`` bits there, so a block can be tested by itself.  A run asks for the few listings and
rules that it has matched; parts whose filter has none of them are left alone.  Small parts are folded into one, ordered by
day, now and then.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listing_lifecycle_spark.sources.versions import VersionedTables

HASHES = 6
BLOCK_BITS = 1 << 15
KEYS_PER_BLOCK = 2048  # 16 bits a key: one key in some 2,000 is taken for one that is there
ASKED = 1_000_000  # keys that are tested against the filters; for more, the whole log is read


def _block(hashed: Column, blocks: Column) -> Column:
    return F.pmod(hashed, blocks)


def key_hash(key: list[str]) -> Column:
    return F.xxhash64(*key)


def filter_of(rows: DataFrame, key: list[str], count: int) -> DataFrame:
    """blocks, block, bits: the filter of ``rows``, which have ``count`` rows at most."""
    blocks = max(1, -(-count // KEYS_PER_BLOCK))
    hashed = rows.select(key_hash(key).alias("h")).distinct()
    places = F.array(*[F.pmod(F.xxhash64("h", F.lit(i)), F.lit(BLOCK_BITS)) for i in range(HASHES)])
    bits = hashed.select(_block(F.col("h"), F.lit(blocks)).alias("block"), F.explode(places).alias("bit"))
    # A bit's number counts from 1 within its block; a block is one bitmap of 4 KB.
    whole = F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits")
    return bits.groupBy("block").agg(whole).select(F.lit(blocks).cast("bigint").alias("blocks"), "block", "bits")


def _test(batches: Iterator[pa.RecordBatch], hashes: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The parts with a block that has all bits of a key."""
    sorted_by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        found = []
        for version, blocks, block, bits in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if blocks not in sorted_by:
                own = hashes % blocks  # as pmod: the sign is the divisor's
                order = np.argsort(own, kind="stable")
                sorted_by[blocks] = own[order], order
            own, order = sorted_by[blocks]
            a, b = np.searchsorted(own, [block, block + 1])
            if a < b:
                at, data = places[order[a:b]], np.frombuffer(bits, np.uint8)
                if ((data[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)).any():
                    found.append(version)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["version"])


class EventLog:
    """The log ``name`` of ``tables``, asked by ``key``."""

    def __init__(self, tables: VersionedTables, name: str = "events", key: tuple[str, ...] = ("external_id", "rule_name"), day: str = "created_at"):
        self.tables, self.name, self.key, self.day = tables, name, list(key), day

    def logs(self, rows: DataFrame) -> dict[str, DataFrame]:
        """What a commit writes for new ``rows`` (a stored table): the rows and their filter."""
        return {self.name: rows, f"{self.name}_filter": filter_of(rows, self.key, rows.count())}

    def parts(self) -> list[int]:
        """Versions whose part holds rows that no later part has taken over."""
        return self.tables.log_parts(self.name)

    def parts_with(self, keys: DataFrame) -> list[int]:
        """The parts that may hold one of ``keys``; those without a filter are among them."""
        parts = self.parts()
        filters = self.tables.read_log(f"{self.name}_filter", with_version=True)
        asked = keys.select(key_hash(self.key).alias("h")).distinct()
        asked = asked.select("h", F.array(*[F.pmod(F.xxhash64("h", F.lit(i)), F.lit(BLOCK_BITS)) for i in range(HASHES)]).alias("at")).limit(ASKED + 1).toArrow()
        if filters is None or asked.num_rows > ASKED:
            return parts
        hashes = asked.column("h").to_numpy()
        places = np.array(asked.column("at").to_pylist(), np.int64).reshape(-1, HASHES)
        tested = filters.where(F.col("version").isin(parts)).select(F.col("version").cast("long"), "blocks", "block", "bits")
        filtered = {r["version"] for r in tested.select("version").distinct().collect()}  # a row for each part
        found = tested.mapInArrow(partial(_test, hashes=hashes, places=places), "version long").distinct().collect()
        return sorted((set(parts) - filtered) | {r["version"] for r in found})

    def of(self, keys: DataFrame) -> DataFrame | None:
        """Rows of the log in the parts that may hold one of ``keys``; null if the log is empty."""
        parts = self.parts_with(keys)
        if not self.parts():
            return None
        return self.tables.read_log(self.name, parts=parts)

    def fold(self) -> int | None:
        """Fold all parts into one, ordered by day, which takes their place; the old ones stay for readers at work."""
        parts = self.parts()
        if len(parts) < 2:
            return None
        rows = self.tables.read_log(self.name, parts=parts)
        ordered = rows.repartitionByRange(F.to_date(self.day)).sortWithinPartitions(self.day)
        return self.tables.commit(logs={self.name: ordered, f"{self.name}_filter": filter_of(rows, self.key, rows.count())}, takes_over={self.name: max(parts), f"{self.name}_filter": max(parts)})
