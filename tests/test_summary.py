"""Daily summary on hand-made silver trips."""

from datetime import date, timedelta
from decimal import ROUND_HALF_UP, Decimal

import pytest
from helpers import START, lasting, make, trip
from pyspark.sql import functions as F

from strata.functions import exact_average, rounded_average
from strata.operators import daily_summary
from strata.plans import aggregate, clean, daily_model, taxi


def summaries(spark, *rows):
    """The summary from both paths, averaged both ways."""
    trips = clean(make(spark, *rows))
    return [
        [tuple(r) for r in df.collect()]
        for df in (
            aggregate(trips),
            aggregate(trips, exact=True),
            spark.sql(daily_model("{t}"), t=trips),
            spark.sql(daily_model("{t}", exact=True), t=trips),
        )
    ]


def test_one_sorted_row_per_day(spark):
    day = timedelta(days=1)
    rows = [
        trip(tpep_pickup_datetime=START + day, tpep_dropoff_datetime=START + day * 2, fare_amount=9.0),
        trip(),
        trip(fare_amount=20.0, passenger_count=5, trip_distance=3.25),
    ]
    expected = [
        (date(2031, 5, 6), 2, 25.88, 6.38, 24.0, 9),
        (date(2031, 5, 7), 1, 9.0, 9.5, 1440.0, 4),
    ]
    for result in summaries(spark, *rows):
        assert result == expected


def test_columns_and_types(spark):
    df = aggregate(clean(make(spark, trip())))
    assert df.dtypes == [
        ("pickup_date", "date"),
        ("total_trips", "bigint"),
        ("avg_fare_usd", "double"),
        ("avg_trip_distance_miles", "double"),
        ("avg_duration_minutes", "double"),
        ("total_passengers", "bigint"),
    ]
    assert aggregate(clean(make(spark, trip())), exact=True).dtypes == df.dtypes
    assert spark.sql(daily_model("{t}", exact=True), t=clean(make(spark, trip()))).dtypes == df.dtypes


def test_no_trips_give_no_days(spark):
    for result in summaries(spark, trip(passenger_count=0)):
        assert result == []


def test_day_is_cut_in_the_session_time_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    days = {}
    try:
        for name in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", name)
            half_past_eleven_utc = F.timestamp_seconds(F.lit(1673825400))
            moment = spark.range(1).select(half_past_eleven_utc.alias("t"))
            days[name] = daily_summary(moment, "t", "day", "n", {}, {}).first().day
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert days == {"UTC": date(2023, 1, 15), "Asia/Tokyo": date(2023, 1, 16)}


def test_exact_average_rounds_half_away_from_zero(spark):
    cases = {
        "tie": [1.0, 1.01],
        "negative tie": [-1.0, -1.01],
        "many": [0.1] * 7 + [0.05],
        "with null": [2.0, None, 3.01],
        "one": [5.55],
        "all null": [None, None],
    }
    df = spark.createDataFrame(
        [(name, v) for name, values in cases.items() for v in values], "name string, v double"
    )
    got = {r.name: r.a for r in df.groupBy("name").agg(exact_average("v").alias("a")).collect()}
    for name, values in cases.items():
        present = [Decimal(str(v)) for v in values if v is not None]
        if not present:
            assert got[name] is None
            continue
        mean = sum(present) / len(present)
        assert got[name] == float(mean.quantize(Decimal("0.01"), ROUND_HALF_UP)), name


def test_exact_average_of_nan_is_nan_like_the_plain_one(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "v double")
    row = df.agg(exact_average("v").alias("e"), rounded_average("v").alias("r")).first()
    assert row.e != row.e and row.r != row.r


def test_exact_sum_overflow_fails_instead_of_wrapping(spark):
    df = spark.range(4).select(F.lit(5e16).alias("v"))
    with pytest.raises(Exception, match="OVERFLOW"):
        df.agg(exact_average("v")).collect()


def test_measures_are_arguments(spark):
    df = daily_summary(
        make(spark, lasting(minutes=3)), taxi.PICKUP, "d", "n", {"a": "fare_amount"}, {"s": "passenger_count"}
    )
    assert [tuple(r) for r in df.collect()] == [(date(2031, 5, 6), 1, 31.75, 4)]
