"""Lifecycle, coverage, alert and market analytics over repeatedly observed listings."""

from listing_lifecycle_spark.session import get_spark

__all__ = ["get_spark"]
