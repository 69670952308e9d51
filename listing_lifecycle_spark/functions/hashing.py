"""Stable hashes over named fields."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from listing_lifecycle_spark import fixed_values as fv

CONTENT_FIELDS = [name for name in fv.LISTING_SCHEMA if name not in fv.NOT_IN_CONTENT_HASH]


def stable_hash(fields: Iterable[str]) -> Column:
    """SHA-256 of the fields as JSON in name order; null fields count, so (1, null, 2) differs from (1, 2, null)."""
    row = F.struct(*[F.col(name) for name in sorted(fields)])
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def content_hash() -> Column:
    """Hash of everything that makes a listing's content."""
    return stable_hash(CONTENT_FIELDS)


def alert_fingerprint() -> Column:
    """Hash of the fields whose change justifies a further alert."""
    return stable_hash(fv.FINGERPRINT_FIELDS)
