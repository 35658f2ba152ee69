"""Plan shapes and hot keys."""

import re

import pytest
from helpers import formatted, plan, shuffled_records
from pyspark.sql import functions as F

from strata.plans import aggregate, clean, clean_model, daily_model, taxi
from strata.quality import evaluate, no_duplicates, primary_key, unique, value_above
from strata.samples.trips import trips


@pytest.fixture(scope="module")
def stored(spark, sf_dir):
    folder = spark.conf.get("spark.checkpoint.dir")
    trips(spark, sf_dir).write.mode("overwrite").parquet(f"{folder}/plan-trips")
    raw = spark.read.parquet(f"{folder}/plan-trips")
    clean(raw).write.mode("overwrite").parquet(f"{folder}/plan-silver")
    return raw, spark.read.parquet(f"{folder}/plan-silver")


def pushed(df):
    return re.search(r"PushedFilters: \[(.*)\]", formatted(df)).group(1)


def paths(stored, spark):
    raw, _ = stored
    return [clean(raw), spark.sql(clean_model("{t}"), t=raw)]


def test_filters_reach_the_scan(spark, stored):
    for df in paths(stored, spark):
        for column in taxi.REQUIRED:
            assert f"IsNotNull({column})" in pushed(df)
        assert "GreaterThanOrEqual(passenger_count,1)" in pushed(df)
        assert "LessThanOrEqual(passenger_count,6)" in pushed(df)


def test_cleaning_shuffles_once_after_dropping_copies_in_each_task(spark, stored):
    for df in paths(stored, spark):
        text = plan(df)
        assert text.count("Exchange hashpartitioning") == text.count("Exchange") == 1
        assert text.count("HashAggregate") == 2
        assert "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text


def test_sql_model_reads_only_its_columns(spark, stored):
    raw, _ = stored
    assert "vendor_name" not in plan(spark.sql(clean_model("{t}"), t=raw))


def test_summary_reads_only_its_columns(spark, stored):
    _, silver = stored
    for df in (
        aggregate(silver),
        aggregate(silver, exact=True),
        spark.sql(daily_model("{s}"), s=silver),
    ):
        schema = re.search(r"ReadSchema: struct<(.*)>", formatted(df)).group(1)
        assert {c.split(":")[0] for c in schema.split(",")} == {
            "tpep_pickup_datetime",
            "fare_amount",
            "trip_distance",
            "trip_duration_minutes",
            "passenger_count",
        }
        assert plan(df).count("Exchange hashpartitioning") == 1
        assert plan(df).count("HashAggregate") == 2


def test_key_rule_reads_only_its_key(stored):
    _, silver = stored
    report = evaluate(silver, [unique(taxi.PICKUP)])
    assert "ReadSchema: struct<tpep_pickup_datetime:timestamp_ntz>" in formatted(report)


@pytest.fixture(scope="module")
def hot(spark):
    """A third of all rows are copies of one trip, another third share one day and key."""
    third = 20_000
    base = spark.range(3 * third, numPartitions=8).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 0 WHEN id % 3 = 1 THEN id ELSE id * 86400 END AS shift",
        "id % 3 = 0 AS copied",
        "id",
    )
    start = F.lit(1_700_000_000) + F.when(F.col("id") % 3 == 2, F.col("shift")).otherwise(0)
    end = start + 60 + F.when(F.col("copied"), 0).otherwise(F.col("id"))
    return base.select(
        F.timestamp_seconds(start).alias("tpep_pickup_datetime"),
        F.timestamp_seconds(end).alias("tpep_dropoff_datetime"),
        F.lit(2).alias("passenger_count"),
        F.lit(1.5).alias("trip_distance"),
        F.lit(10.0).alias("fare_amount"),
    ), third




def test_hot_groups_keep_results_whole(hot):
    df, third = hot
    silver = clean(df)
    assert silver.count() == 2 * third + 1
    busiest = aggregate(silver).orderBy(F.desc("total_trips")).first()
    assert busiest.total_trips >= third + 1
    assert aggregate(silver).agg(F.sum("total_trips")).first()[0] == 2 * third + 1
    report = evaluate(
        df, [no_duplicates(), unique(taxi.PICKUP), primary_key(taxi.PICKUP), value_above("fare_amount", 0)]
    )
    counts = {r.rule: (r.total_rows, r.failing_rows) for r in report.collect()}
    assert counts == {
        "no_duplicates": (3 * third, third - 1),
        "unique": (3 * third, 2 * third - 1),
        "primary_key": (3 * third, 2 * third - 1),
        "value_above": (3 * third, 0),
    }


def test_hot_groups_are_reduced_before_the_shuffle(hot):
    """A hot group reaches the shuffle as at most one record per task."""
    df, third = hot
    tasks = df.rdd.getNumPartitions()
    assert max(shuffled_records(clean(df))) <= 2 * third + tasks
    assert max(shuffled_records(evaluate(df, [no_duplicates()]))) <= 2 * third + tasks
    starts = df.select(taxi.PICKUP).distinct().count()
    assert max(shuffled_records(evaluate(df, [unique(taxi.PICKUP)]))) <= starts + tasks
    days = df.select(F.to_date(taxi.PICKUP)).distinct().count()
    assert max(shuffled_records(aggregate(df.withColumn(taxi.DURATION, F.lit(1.0))))) <= tasks * days
