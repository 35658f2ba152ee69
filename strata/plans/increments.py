"""The layers kept up to date batch by batch: each build reads what is new, and the months it touches.

Bronze holds each batch once. Silver is divided by batch and month; a build cleans the new rows,
drops those that the stored rows of the same months already hold, and appends the rest, so nothing
stored is written again. Gold stores what each batch adds to a day and merges these few rows. After
every build the tables equal those of a full rebuild. A build that died is done again by the next:
its batch has no record yet, and what it wrote is overwritten.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.names import Workspace
from strata.operators import daily_parts, dedupe, merged_days
from strata.plans import taxi
from strata.plans.jobs import clean
from strata.session import discard, scratch_path, sized_session
from strata.sinks import BATCH, append_batch, committed, evolve, refresh
from strata.sources import read_table

# Names of the tables that are built by batches.
BRONZE = f"{taxi.TRIPS}_batches"
SILVER = f"{taxi.TRIPS}_added"
PARTS = f"{taxi.DAILY}_parts"
#: The month of a trip divides silver; days would make thousands of small partitions.
PERIOD = "pickup_month"


def run_bronze_batch(
    spark: SparkSession, env: str, source: DataFrame | str, batch: str, workspace: Workspace = taxi.WORKSPACE
) -> bool:
    """Append the source as ``batch``; False, and nothing happens, if bronze holds that batch."""
    raw = read_table(spark, source) if isinstance(source, str) else source
    return append_batch(raw, workspace.table(env, "bronze", BRONZE), batch, workspace.format)


def run_silver_increment(spark: SparkSession, env: str, workspace: Workspace = taxi.WORKSPACE) -> list[str]:
    """Bring silver up to date with bronze; returns the batches that were new to it."""
    source, target = workspace.table(env, "bronze", BRONZE), workspace.table(env, "silver", SILVER)
    new = [batch for batch in committed(spark, source) if batch not in committed(spark, target)]
    for batch in new:
        own = sized_session(read_table(spark, source).filter(F.col(BATCH) == batch))
        raw = batch_of(own, source, batch)
        # A batch has few months, and never more than the calendar; they choose the partitions to read.
        periods = [row[0] for row in raw.select(_period()).distinct().collect()]
        rows = silver_rows(raw, target, periods)
        # Spark overwrites no partition of a table that it reads, so the new rows are set aside first.
        aside = scratch_path(own, "added")
        rows.write.parquet(aside)
        append_batch(own.read.schema(rows.schema).parquet(aside), target, batch, workspace.format, partition_by=(PERIOD,))
        discard(own, aside)
    spark.catalog.refreshTable(target)  # it was written in other sessions
    return new


def _period() -> Column:
    return F.trunc(F.to_date(taxi.PICKUP), "month").alias(PERIOD)


def silver_rows(raw: DataFrame, table: str, periods: Sequence) -> DataFrame:
    """What ``raw``, which falls in ``periods``, adds to the silver ``table``, dealt out by month.

    Copies within ``raw`` and rows that are stored already leave in one shuffle; what is added is
    shuffled once more to lie together by month.
    """
    rows = clean(raw, distinct=lambda trips: added_rows(trips, table, periods))
    return rows.select("*", _period()).hint("rebalance", PERIOD)


def batch_of(spark: SparkSession, table: str, batch: str) -> DataFrame:
    """The rows of one batch as they came."""
    return read_table(spark, table).filter(F.col(BATCH) == batch).drop(BATCH)


def stored_rows(spark: SparkSession, table: str, batches: Sequence[str], periods: Sequence) -> DataFrame:
    """The rows of these batches and months; only their partitions are listed and read."""
    return read_table(spark, table).filter(F.col(BATCH).isin(list(batches)) & F.col(PERIOD).isin(list(periods)))


def added_rows(rows: DataFrame, table: str, periods: Sequence) -> DataFrame:
    """The ``rows``, which fall in ``periods``, that ``table`` does not hold yet, one copy of each.

    Equal rows share their month, so stored rows of other months are not read. Rows are compared as
    ``dropDuplicates`` does: nulls are equal, and so are NaN. Month and duration follow from the
    other columns, so ``rows`` may lack them.
    """
    spark = rows.sparkSession
    done = committed(spark, table)
    if not done:
        return rows.transform(dedupe)
    evolve(spark, table, rows.schema)
    derived = {BATCH, PERIOD, taxi.DURATION} - (set(rows.columns) - {BATCH})
    columns = [c for c in read_table(spark, table).columns if c not in derived]
    known = stored_rows(spark, table, done, periods).select(*columns).withColumn("__known", F.lit(True))
    both = rows.withColumn("__known", F.lit(False)).unionByName(known, allowMissingColumns=True)
    # A row of either kind is reduced to one inside each task before it is shuffled.
    found = both.groupBy(*columns).agg(F.bool_or("__known").alias("__known"))
    return found.filter(~F.col("__known")).select(*rows.columns)


def run_gold_increment(spark: SparkSession, env: str, workspace: Workspace = taxi.WORKSPACE) -> str:
    """Bring the daily summary up to date with silver; averages are exact."""
    source, parts = workspace.table(env, "silver", SILVER), workspace.table(env, "gold", PARTS)
    target = workspace.table(env, "gold", taxi.DAILY)
    new = [batch for batch in committed(spark, source) if batch not in committed(spark, parts)]
    for batch in new:
        added = daily_parts(batch_of(spark, source, batch), taxi.PICKUP, taxi.DAY, taxi.TRIP_COUNT, taxi.AVERAGES, taxi.SUMS)
        append_batch(added, parts, batch, workspace.format)
    if new or not spark.catalog.tableExists(target):
        stored = read_table(spark, parts).filter(F.col(BATCH).isin(committed(spark, parts)))
        refresh(merged_days(stored, taxi.DAY, taxi.TRIP_COUNT, taxi.AVERAGES, taxi.SUMS), target, workspace.format)
    return target


def run_increment(
    spark: SparkSession, env: str, source: DataFrame | str, batch: str, workspace: Workspace = taxi.WORKSPACE
) -> str:
    """One batch through all layers; returns the gold table's name. Safe to run again."""
    run_bronze_batch(spark, env, source, batch, workspace)
    run_silver_increment(spark, env, workspace)
    return run_gold_increment(spark, env, workspace)
