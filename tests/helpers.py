"""Small builders for test rows."""

from __future__ import annotations

from datetime import date, datetime

from listing_lifecycle_spark import fixed_values as fv

LISTING_DDL = ", ".join(f"{name} {kind}" for name, kind in fv.LISTING_SCHEMA.items())
STATE_TYPES = {**fv.LISTING_SCHEMA, **fv.LIFECYCLE_SCHEMA}


def moment(text: str) -> datetime:
    return datetime.fromisoformat(text)


def listing(external_id="one", **changes) -> dict:
    row = {name: None for name in fv.LISTING_SCHEMA}
    row.update({name: 0 for name in ["total_animals", *fv.PET_COUNT_COLUMNS]})
    row.update(
        external_id=external_id, content_hash="h1", island="North Island", region="Auckland", subregion="Auckland - Central",
        city="Grey Lynn", duration_days=21, start_date=date(2026, 8, 13), end_date=date(2026, 9, 3), house_type="House",
        no_pets=False, starts_soon=False, reply_rating_score=9, title="Sunny home", intro="Two calm pets", listing_tag="Garden",
        url=f"https://listings.example/{external_id}",
    )
    row.update(changes)
    return row


def listings(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in fv.LISTING_SCHEMA) for r in rows], LISTING_DDL)


def batch(spark, rows, at="2026-05-02T10:00:00"):
    ddl = LISTING_DDL + ", observed_at timestamp_ntz"
    data = [tuple(r[c] for c in fv.LISTING_SCHEMA) + (moment(r.get("observed_at", at)),) for r in rows]
    return spark.createDataFrame(data, ddl)


def state(spark, rows):
    ddl = ", ".join(f"{name} {kind}" for name, kind in STATE_TYPES.items())
    base = {
        "first_seen_at": moment("2026-04-01T00:00:00"), "last_seen_at": moment("2026-05-01T00:00:00"), "first_seen_run_id": 1,
        "last_seen_run_id": 1, "first_seen_context": "observed", "status": "active", "missing_count": 0, "missing_since": None,
        "closed_at": None, "appearance_sequence": 1, "created_at": moment("2026-04-01T00:00:00"), "updated_at": moment("2026-05-01T00:00:00"),
    }
    data = []
    for row in rows:
        full = {**listing(row.get("external_id", "one")), **base, **row}
        data.append(tuple(full[c] for c in STATE_TYPES))
    return spark.createDataFrame(data, ddl)


def by(df, key="external_id"):
    return {row[key]: row.asDict() for row in df.collect()}
