"""Properties that hold for any trips, checked on generated ones."""

from collections import Counter
from datetime import timedelta

import pytest
from helpers import START, full_width, make
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strata.operators import dedupe
from strata.plans import aggregate, clean, clean_model, daily_model, taxi
from strata.quality import evaluate

stamps = st.one_of(
    st.none(),
    st.integers(0, 3 * 86400 * 10).map(lambda tenths: START + timedelta(seconds=tenths / 10)),
)
money = st.one_of(
    st.none(), st.just(float("nan")), st.just(-0.0), st.integers(-500, 5000).map(lambda c: c / 100)
)
rows = st.lists(
    st.fixed_dictionaries(
        {
            "tpep_pickup_datetime": stamps,
            "tpep_dropoff_datetime": stamps,
            "fare_amount": money,
            "trip_distance": money,
            "passenger_count": st.one_of(st.none(), st.integers(-1, 8)),
            "dispatcher": st.sampled_from(["north", "south", None]),
        }
    ),
    min_size=1,
    max_size=25,
)
repeated = rows.flatmap(lambda r: st.lists(st.sampled_from(r), min_size=1, max_size=40))
few = settings(
    max_examples=10,
    deadline=None,
    database=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)


def bag(df):
    return Counter(repr(r) for r in df.collect())


@few
@given(repeated)
def test_dedupe_is_idempotent_and_loses_no_distinct_row(spark, trips):
    df = make(spark, *trips)
    once = dedupe(df)
    assert bag(dedupe(once)) == bag(once)
    expected = {
        tuple(repr(v + 0.0) if isinstance(v, float) else repr(v) for v in t.values()) for t in trips
    }
    assert once.count() == len(expected)


@few
@given(repeated)
def test_ingesting_twice_changes_nothing(spark, trips):
    df = make(spark, *trips)
    assert bag(clean(df.unionAll(df))) == bag(clean(df))


@few
@given(repeated)
def test_silver_matches_a_row_by_row_reading_of_the_rules(spark, trips):
    kept = set()
    for t in trips:
        required = [t[c] for c in taxi.REQUIRED]
        if any(v is None or v != v for v in required) or t["passenger_count"] is None:
            continue
        seconds = int(t["tpep_dropoff_datetime"].timestamp() // 1) - int(
            t["tpep_pickup_datetime"].timestamp() // 1
        )
        if 1 <= t["passenger_count"] <= 6 and seconds > 0:
            kept.add(tuple(v + 0.0 if isinstance(v, float) else v for v in t.values()))
    got = clean(make(spark, *trips)).drop("trip_duration_minutes").select(*trips[0]).collect()
    assert Counter(tuple(v + 0.0 if isinstance(v, float) else v for v in r) for r in got) == Counter(kept)


@few
@given(repeated)
def test_gold_adds_up_to_silver(spark, trips):
    silver = clean(make(spark, *trips))
    days = aggregate(silver).collect()
    assert sum(d.total_trips for d in days) == silver.count()
    assert sum(d.total_passengers for d in days) == sum(r.passenger_count for r in silver.collect())
    assert [d.pickup_date for d in days] == sorted({d.pickup_date for d in days})
    for plain, exact in zip(days, aggregate(silver, exact=True).collect(), strict=True):
        for name in taxi.AVERAGES:
            assert abs(plain[name] - exact[name]) <= 0.0101


@few
@given(repeated)
def test_silver_passes_the_critical_rules_of_its_contract(spark, trips):
    silver = clean(full_width(make(spark, *trips)))
    report = evaluate(silver, taxi.contract("trips_silver").rules())
    assert report.filter("severity = 'critical' AND NOT passed").count() == 0


@few
@given(repeated)
def test_paths_differ_only_by_nan_short_trips_and_extra_columns(spark, trips):
    df = full_width(make(spark, *trips)).drop("dispatcher")
    names = [*taxi.TRIP_COLUMNS, taxi.DURATION]
    from_sql = spark.sql(clean_model("{t}"), t=df).select(*names)
    both = from_sql.filter(
        "NOT isnan(fare_amount) AND NOT isnan(trip_distance) AND trip_duration_minutes > 0"
    )
    assert bag(clean(df).select(*names)) == bag(both)


@few
@given(repeated)
def test_both_summaries_agree_on_the_same_silver(spark, trips):
    silver = clean(make(spark, *trips))
    modelled = spark.sql(daily_model("{s}", exact=True), s=silver)
    assert modelled.collect() == aggregate(silver, exact=True).collect()


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_exact_summary_does_not_depend_on_partitioning(spark, partitions):
    df = spark.range(5000).selectExpr(
        "TIMESTAMP '2024-01-01' AS tpep_pickup_datetime",
        "(id * 7919 % 10007) / 100.0D AS fare_amount",
        "1.0D AS trip_distance",
        "2.0D AS trip_duration_minutes",
        "1 AS passenger_count",
    )
    cents = [i * 7919 % 10007 for i in range(5000)]
    expected = (2 * sum(cents) + 5000) // 10000 / 100
    assert aggregate(df.repartition(partitions), exact=True).first().avg_fare_usd == expected
