"""The taxi-trips configuration of the operators."""

from __future__ import annotations

from functools import cache
from pathlib import Path

from strata.names import Workspace
from strata.quality import Contract, Rule, accepted_values, load_contract, not_null, unique

# Tables, columns and bounds of the taxi trips.
TRIPS = "trips"
TRIPS_MODEL = "trips_clean"
DAILY = "daily_trip_summary"

PICKUP = "tpep_pickup_datetime"
DROPOFF = "tpep_dropoff_datetime"
DURATION = "trip_duration_minutes"
PASSENGERS = "passenger_count"
MIN_PASSENGERS = 1
MAX_PASSENGERS = 6
REQUIRED = ("fare_amount", "trip_distance", PICKUP, DROPOFF)
TRIP_COLUMNS = (
    PICKUP,
    DROPOFF,
    PASSENGERS,
    "trip_distance",
    "fare_amount",
    "extra",
    "mta_tax",
    "tip_amount",
    "tolls_amount",
    "total_amount",
    "payment_type",
)

DAY = "pickup_date"
TRIP_COUNT = "total_trips"
AVERAGES = {
    "avg_fare_usd": "fare_amount",
    "avg_trip_distance_miles": "trip_distance",
    "avg_duration_minutes": DURATION,
}
SUMS = {"total_passengers": PASSENGERS}

WORKSPACE = Workspace(catalog_prefix="strata", schema_prefix="taxi")


@cache
def contract(name: str) -> Contract:
    """``trips_bronze``, ``trips_silver`` or ``daily_gold``."""
    return load_contract(Path(__file__).parent / "contracts" / f"{name}.yml")


def silver_tests() -> list[Rule]:
    """Column tests that the clean SQL model has to pass before gold is built."""
    return [
        *(not_null(c) for c in (PICKUP, DROPOFF, PASSENGERS)),
        accepted_values(PASSENGERS, list(range(MIN_PASSENGERS, MAX_PASSENGERS + 1))),
        *(not_null(c) for c in ("fare_amount", DURATION)),
    ]


def gold_tests() -> list[Rule]:
    """Column tests of the daily summary model."""
    return [unique(DAY), *(not_null(c) for c in (DAY, TRIP_COUNT, *AVERAGES, *SUMS))]
