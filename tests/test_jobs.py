"""Jobs of both paths over stored tables."""

import uuid

import pytest
from helpers import full_width, lasting, make, plan, trip
from pyspark.sql import functions as F

from strata import plans
from strata.names import Workspace
from strata.plans import taxi
from strata.quality import ContractViolation, check_table, not_null, require, unique, value_above
from strata.session import scratch_path
from strata.sinks import Layout


@pytest.fixture
def workspace(spark):
    space = Workspace("strata", f"j{uuid.uuid4().hex[:8]}", catalog="spark_catalog")
    for env in ("dev", "prod"):
        space.create_schemas(spark, env, scratch_path(spark, env))
    return space


@pytest.fixture
def raw(spark):
    return full_width(make(spark, trip(), trip(), lasting(minutes=30), trip(passenger_count=9)))


def test_layers_are_built_from_stored_tables(spark, workspace, raw):
    gold = plans.run_all(spark, "dev", raw, workspace)
    assert gold == workspace.table("dev", "gold", taxi.DAILY)
    assert spark.read.table(workspace.table("dev", "bronze", taxi.TRIPS)).count() == 4
    assert spark.read.table(workspace.table("dev", "silver", taxi.TRIPS)).count() == 2
    row = spark.read.table(gold).first()
    assert (row.total_trips, row.avg_duration_minutes, row.total_passengers) == (2, 27.0, 8)


def test_source_may_be_a_table_name(spark, workspace, raw):
    source = workspace.table("dev", "bronze", "arrivals")
    raw.write.saveAsTable(source)
    target = plans.run_bronze(spark, "dev", source, workspace)
    assert spark.read.table(target).count() == 4


def test_environments_do_not_mix(spark, workspace, raw):
    plans.run_bronze(spark, "dev", raw, workspace)
    assert not spark.catalog.tableExists(workspace.table("prod", "bronze", taxi.TRIPS))


def test_run_again_leaves_silver_and_gold_unchanged(spark, workspace, raw):
    gold = plans.run_all(spark, "dev", raw, workspace)
    first = spark.read.table(gold).collect()
    plans.run_all(spark, "dev", raw, workspace)
    assert spark.read.table(workspace.table("dev", "bronze", taxi.TRIPS)).count() == 8
    assert spark.read.table(gold).collect() == first


def test_run_again_after_a_new_column(spark, workspace, raw):
    plans.run_bronze(spark, "dev", raw, workspace)
    plans.run_bronze(spark, "dev", raw.withColumn("surge", F.lit(1.5)), workspace)
    silver = plans.run_silver(spark, "dev", workspace)
    assert spark.read.table(silver).count() == 4
    plans.run_silver(spark, "dev", workspace, columns=raw.columns)
    assert spark.read.table(silver).count() == 2
    assert "surge" not in spark.read.table(silver).columns


def test_models_are_stored_as_tables(spark, workspace, raw):
    plans.run_bronze(spark, "dev", raw, workspace)
    silver = plans.run_silver_model(spark, "dev", workspace)
    gold = plans.run_gold_model(spark, "dev", workspace)
    assert spark.read.table(silver).columns == [*taxi.TRIP_COLUMNS, taxi.DURATION]
    assert [tuple(r)[1:] for r in spark.read.table(gold).collect()] == [(2, 31.75, 9.5, 27.0, 8)]


def test_gate_passes(spark, workspace, raw):
    plans.run_bronze(spark, "dev", raw, workspace)
    report = plans.run_gated(spark, "dev", workspace).collect()
    assert len(report) == 13
    assert all(r.passed for r in report)
    assert {(r.table_name, r.total_rows) for r in report} == {("trips_clean", 2), ("daily_trip_summary", 1)}
    assert spark.catalog.tableExists(workspace.table("dev", "gold", taxi.DAILY))


def test_failed_silver_test_stops_before_gold(spark, workspace):
    raw = full_width(make(spark, trip(), lasting(milliseconds=400)))
    plans.run_bronze(spark, "dev", raw, workspace)
    with pytest.raises(ContractViolation, match="trips_clean: value_above"):
        plans.run_gated(spark, "dev", workspace, silver_tests=[value_above(taxi.DURATION, 0)])
    assert spark.catalog.tableExists(workspace.table("dev", "silver", taxi.TRIPS_MODEL))
    assert not spark.catalog.tableExists(workspace.table("dev", "gold", taxi.DAILY))


def test_failed_key_test_stops_too(spark, workspace, raw):
    plans.run_bronze(spark, "dev", raw, workspace)
    with pytest.raises(ContractViolation, match="trips_clean: unique"):
        plans.run_gated(spark, "dev", workspace, silver_tests=[unique(taxi.PASSENGERS)])


def test_failed_gold_test_is_reported_after_gold_is_stored(spark, workspace, raw):
    plans.run_bronze(spark, "dev", raw, workspace)
    with pytest.raises(ContractViolation, match="daily_trip_summary"):
        plans.run_gated(spark, "dev", workspace, gold_tests=[value_above("total_trips", 2)])


def test_failed_warning_does_not_stop(spark, workspace, raw):
    plans.run_bronze(spark, "dev", raw, workspace)
    report = plans.run_gated(spark, "dev", workspace, silver_tests=[not_null("tip_amount", "warning")])
    assert [r.passed for r in report.filter("severity = 'warning'").collect()] == [False]


def test_jobs_refuse_an_unknown_environment(spark, workspace, raw):
    with pytest.raises(ValueError, match="env must be"):
        plans.run_bronze(spark, "release_in_prod", raw, workspace)


def test_own_columns_through_both_models(spark):
    rides = spark.sql(
        """SELECT n, 4.0D AS p, TIMESTAMP '2024-03-01 10:00:00' AS a, TIMESTAMP '2024-03-01 10:00:30' AS b
           FROM VALUES (1), (9) AS t(n)"""
    )
    text = plans.clean_model(
        "{r}", columns=["a", "b", "n", "p"], required=["p"], counted="n", low=1, high=4,
        start="a", end="b", duration="m",
    )
    clean = spark.sql(text, r=rides)
    assert [r.m for r in clean.collect()] == [0.5]
    text = plans.daily_model("{c}", timestamp="a", day="d", rows="k", averages={"avg_p": "p"}, sums={"s": "n"})
    assert [tuple(r)[1:] for r in spark.sql(text, c=clean).collect()] == [(1, 4.0, 1)]


def test_stored_layers_can_be_held_to_their_contracts(spark, workspace, raw):
    gold = plans.run_all(spark, "dev", raw, workspace)
    silver = workspace.table("dev", "silver", taxi.TRIPS)
    require(check_table(spark, silver, taxi.contract("trips_silver")))
    contract = taxi.contract("daily_gold")
    for as_of, failed in (("2031-05-07 03:00:00", set()), ("2031-05-07 03:00:01", {"freshness"})):
        report = check_table(spark, gold, contract, as_of=as_of, fresh=taxi.DAY)
        assert {r.rule for r in report.filter("NOT passed").collect()} == failed
    with pytest.raises(ContractViolation, match="total_trips: missing"):
        check_table(spark, silver, taxi.contract("daily_gold"))


def test_a_whole_contract_can_be_the_gate(spark, workspace, raw):
    plans.run_bronze(spark, "dev", raw, workspace)
    silver, gold = taxi.contract("trips_silver"), taxi.contract("daily_gold")
    report = plans.run_gated(spark, "dev", workspace, silver_tests=silver, gold_tests=gold)
    assert report.count() == len(silver.rules()) + len(gold.rules()) and report.filter("NOT passed").isEmpty()
    with pytest.raises(ContractViolation, match="trips_clean: pickup_date: missing"):
        plans.run_gated(spark, "dev", workspace, silver_tests=gold)


def test_small_files_can_be_compacted_and_bronze_bucketed(spark, workspace, raw):
    layout = Layout(bucket_by=(taxi.PICKUP,), buckets=2)
    bronze = plans.run_bronze(spark, "dev", raw.repartition(16), workspace, layout, compact=True)
    assert len(spark.read.table(bronze).inputFiles()) <= 2
    assert "Exchange" not in plan(plans.clean(spark.read.table(bronze)))
    assert spark.read.table(plans.run_silver(spark, "dev", workspace)).count() == 2
