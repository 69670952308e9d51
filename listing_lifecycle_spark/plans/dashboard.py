"""Report plans: what one page of the market dashboard shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listing_lifecycle_spark.functions.text import week_labels
from listing_lifecycle_spark.operators import filters, ranking, seasonality
from listing_lifecycle_spark.operators.facts import explorer_rows


def overview_report(facts: DataFrame) -> dict[str, DataFrame]:
    """Card, regions and pet mix."""
    return {
        "card": ranking.overview(facts),
        "regions": ranking.count_by(facts, "region", limit=12),
        "pets": ranking.count_by(facts, "pet_label", limit=10),
    }


def seasonality_report(
    facts: DataFrame, *, basis: str = "sit_dates", interval: str = "month", metric: str = "listing_count"
) -> dict[str, DataFrame]:
    """Series and year-by-period grid of one metric."""
    profile = seasonality.seasonality(facts, basis=basis, interval=interval)
    return {
        "series": profile.select("period_start", metric).orderBy("period_start"),
        "heatmap": seasonality.heatmap(profile, metric=metric, interval=interval),
    }


def lead_report(facts: DataFrame, *, include_baseline: bool = False) -> dict[str, DataFrame]:
    """Statistics, histogram and boxes of the lead time."""
    rows = ranking.lead_rows(facts, include_baseline=include_baseline)
    return {
        "statistics": ranking.lead_statistics(rows),
        "histogram": ranking.lead_histogram(rows),
        "boxes": ranking.lead_boxes(rows),
    }


def location_report(
    facts: DataFrame, level: str = "region", *, region: str | None = None, subregion: str | None = None, limit: int = 15
) -> dict[str, DataFrame]:
    """Ranking and pet mix at one location level."""
    focused = filters.focus_location(facts, region=region, subregion=subregion)
    return {
        "counts": ranking.count_by(focused, level, limit=limit),
        "pets": ranking.pet_mix(focused, level, limit=limit),
    }


def market_timeline(facts: DataFrame, *, region: str, subregion: str, year: int | None = None) -> DataFrame:
    """Weeks of one market and year with labels, month boundaries and the range of the counts."""
    market = filters.filter_facts(facts, filters.FactFilter().fixed_market(region, subregion))
    weeks = seasonality.select_year(seasonality.weekly_timeline(market), year)
    whole = Window.partitionBy(F.lit(1))
    return seasonality.month_boundaries(weeks).withColumns(
        {
            **week_labels(F.col("period_start")),
            "quiet": F.min("listing_count").over(whole),
            "busy": F.max("listing_count").over(whole),
        }
    )


def market_report(
    facts: DataFrame, selection: filters.FactFilter, *, region: str, subregion: str
) -> dict[str, DataFrame]:
    """Card, weekly timeline and monthly trend of one fixed market under the other choices of a selection."""
    market = filters.filter_facts(facts, selection.fixed_market(region, subregion))
    trend = seasonality.seasonality(market, interval="month")
    return {
        "card": ranking.market_card(market),
        "weeks": market_timeline(market, region=region, subregion=subregion),
        "trend": trend.select("period_start", "listing_count").orderBy("period_start"),
    }


def explorer_report(facts: DataFrame) -> DataFrame:
    """Filtered rows as listed (and exported)."""
    return explorer_rows(facts)


def sanity_report(listings: DataFrame, *, rows: int = 10) -> dict[str, DataFrame]:
    """Sample rows and two counts to look at after a load."""
    return {
        "sample": listings.limit(rows),
        "regions": ranking.rows_by_region(listings),
        "months": ranking.rows_by_start_month(listings),
    }
