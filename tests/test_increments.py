"""Layers kept up to date by batches equal those rebuilt whole."""

import uuid

import pytest
from helpers import full_width, lasting, make, plan, trip
from pyspark.sql import functions as F

from strata import plans
from strata.names import Workspace
from strata.plans import increments, taxi
from strata.samples import queries
from strata.samples.trips import trips
from strata.session import scratch_path
from strata.sinks import BATCH, committed


@pytest.fixture
def workspace(spark):
    space = Workspace("strata", f"i{uuid.uuid4().hex[:8]}", catalog="spark_catalog")
    space.create_schemas(spark, "dev", scratch_path(spark, "dev"))
    return space


def batches(spark):
    """Three batches; days come twice, rows come again, and the last has a column more."""
    first = full_width(make(spark, trip(), trip(), lasting(minutes=30)))
    later = first.withColumn(taxi.PICKUP, F.col(taxi.PICKUP) + F.expr("INTERVAL 40 DAY")).withColumn(
        taxi.DROPOFF, F.col(taxi.DROPOFF) + F.expr("INTERVAL 40 DAY")
    )
    nan = full_width(make(spark, lasting(minutes=45))).withColumn("tip_amount", F.lit(float("nan")))
    return [first, first.unionByName(later).unionByName(nan), nan.unionByName(later).withColumn("vendor", F.lit("v"))]


def rebuilt(spark, sent):
    whole = sent[0]
    for batch in sent[1:]:
        whole = whole.unionByName(batch, allowMissingColumns=True)
    return plans.clean(whole)


def rows(df):
    return sorted(map(repr, (r.asDict() for r in df.select(*sorted(df.columns)).collect())))


def test_every_build_equals_a_full_one(spark, workspace):
    sent = []
    for i, batch in enumerate(batches(spark)):
        gold = plans.run_increment(spark, "dev", batch, f"b{i}", workspace)
        sent.append(batch)
        expected = rebuilt(spark, sent)
        silver = spark.read.table(workspace.table("dev", "silver", increments.SILVER)).drop(BATCH, increments.PERIOD)
        assert rows(silver) == rows(expected)
        assert rows(spark.read.table(gold)) == rows(plans.aggregate(expected, exact=True))
    again = plans.run_increment(spark, "dev", sent[1], "b1", workspace)
    assert rows(spark.read.table(again)) == rows(plans.aggregate(rebuilt(spark, sent), exact=True))


@pytest.mark.parametrize("layer", ["silver", "gold"])
def test_a_build_that_died_is_done_again(spark, workspace, layer, monkeypatch):
    first, second, _ = batches(spark)
    plans.run_increment(spark, "dev", first, "b0", workspace)
    table = workspace.table("dev", layer, {"silver": increments.SILVER, "gold": increments.PARTS}[layer])
    whole = increments.append_batch

    def dying(df, name, batch, *rest, **options):
        wrote = whole(df, name, batch, *rest, **options, done=name != table)
        if name == table:
            raise RuntimeError("the driver is lost before the record")
        return wrote

    with monkeypatch.context() as lost:
        lost.setattr(increments, "append_batch", dying)
        with pytest.raises(RuntimeError):
            plans.run_increment(spark, "dev", second, "b1", workspace)
    assert committed(spark, table) == ["b0"]
    gold = plans.run_increment(spark, "dev", second, "b1", workspace)
    assert rows(spark.read.table(gold)) == rows(plans.aggregate(rebuilt(spark, [first, second]), exact=True))


def test_only_touched_days_are_read(spark, workspace):
    first, second, _ = batches(spark)
    plans.run_increment(spark, "dev", first, "b0", workspace)
    plans.run_increment(spark, "dev", second, "b1", workspace)
    table = workspace.table("dev", "silver", increments.SILVER)
    days = [row[0] for row in spark.read.table(table).select(increments.PERIOD).distinct().collect()]
    assert len(days) == 2
    stored = increments.stored_rows(spark, table, ["b0", "b1"], [min(days)])
    assert "PartitionFilters: [isnotnull(" in plan(stored) or "PartitionFilters: [" in plan(stored)
    read = {f.rpartition("/")[0].rpartition("=")[2] for f in stored.inputFiles()}
    assert read and stored.select(increments.PERIOD).distinct().count() == 1
    new = plans.clean(second).withColumn(increments.PERIOD, F.trunc(F.to_date(taxi.PICKUP), "month"))
    assert increments.added_rows(new, table, days).count() == 0


def test_nothing_new_reads_nothing(spark, workspace):
    first, _, _ = batches(spark)
    gold = plans.run_increment(spark, "dev", first, "b0", workspace)
    assert plans.run_silver_increment(spark, "dev", workspace) == []
    assert plans.run_gold_increment(spark, "dev", workspace) == gold
    assert not plans.run_bronze_batch(spark, "dev", first, "b0", workspace)


@pytest.fixture
def tables(spark, tmp_path):
    """A few orders and their line items, a third of them with a copy."""
    orders = spark.range(1, 31).selectExpr("id AS o_orderkey", "TIMESTAMP'2031-01-30 08:00:00' + make_dt_interval(id % 9) AS o_orderdate", "id * 1.5D AS o_totalprice")
    lines = spark.range(0, 90).selectExpr(
        "id % 30 + 1 AS l_orderkey", "CAST(id % 7 + 1 AS INT) AS l_linenumber", "CAST(id % 5 + 1 AS DOUBLE) AS l_quantity", "id * 2.5D AS l_extendedprice",
        "0.1D AS l_discount", "0.2D AS l_tax", "substr('ANR', CAST(id % 3 AS INT) + 1, 1) AS l_returnflag", "'F' AS l_linestatus", "TIMESTAMP'2031-03-01 09:00:00' AS l_shipdate",
    )
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    lines.unionAll(lines.filter("l_orderkey % 3 = 0")).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["silver_incremental", "gold_incremental"])
def test_sent_trips_are_joined_once(spark, tables, name, monkeypatch):
    sources, whole = [], queries.run_bronze_batch
    made = trips(spark, tables, nan=name == "gold_incremental")

    def watched(session, env, source, batch, space):
        sources.append((plan(source), rows(source)))
        return whole(session, env, source, batch, space)

    monkeypatch.setattr(queries, "run_bronze_batch", watched)
    found = getattr(queries, name)(spark, tables)
    silver = plans.clean(made)
    expected = silver if name == "silver_incremental" else plans.aggregate(silver, exact=True)
    assert rows(found) == rows(expected)
    assert len(sources) == 4 and not any("Join" in text for text, _ in sources)
    assert sources[3][1] == rows(made) and sorted(r for _, some in sources[:3] for r in some) == sorted(rows(made) * 2)


def test_copies_and_stored_rows_leave_in_one_shuffle(spark, workspace):
    first, second, _ = batches(spark)
    plans.run_increment(spark, "dev", first, "b0", workspace)
    table = workspace.table("dev", "silver", increments.SILVER)
    days = [row[0] for row in second.select(F.trunc(F.to_date(taxi.PICKUP), "month")).distinct().collect()]
    added = increments.silver_rows(second.unionByName(second), table, days)
    assert plan(added).count("Exchange") == 2  # by row, then by month
    stored = plans.clean(first)
    assert rows(added.drop(increments.PERIOD)) == rows(plans.clean(second).exceptAll(stored))
