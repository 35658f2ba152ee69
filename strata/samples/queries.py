"""One query per operator, over the whole sample tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import elapsed
from strata.names import LAYERS, Workspace
from strata.operators import daily_summary as daily_summary_of
from strata.operators import (
    dedupe,
    drop_incomplete,
    drop_nulls,
    keep_after,
    keep_between,
    keep_positive,
    project,
    with_elapsed,
)
from strata.plans import (
    aggregate,
    clean,
    clean_model,
    daily_model,
    run_all,
    run_bronze,
    increments,
    run_bronze_batch,
    run_gated,
    run_gold_increment,
    run_gold_model,
    run_silver,
    run_silver_increment,
    run_silver_model,
    taxi,
)
from strata.quality import (
    REPORT_SCHEMA,
    accepted_values,
    check_table,
    declared_not_null,
    evaluate,
    evaluate_footers,
    freshness,
    no_duplicates,
    no_future,
    not_null,
    primary_key,
    row_count_above,
    schema_report,
    table_not_empty,
    unique,
    value_above,
    value_above_or_equal,
    value_between,
)
from strata.samples.trips import read, trips
from strata.session import configure, discard, scratch_path
from strata.sinks import BATCH, Layout, append_batch, append_evolving, append_evolving_path, evolve, positions, refresh_path
from strata.sources import accepted, read_evolved, read_lines, read_source, rejected

Query = Callable[[SparkSession, str], DataFrame]

# Averages of columns that hold whole numbers.
_WHOLE = {"avg_distance": "trip_distance", "avg_passengers": taxi.PASSENGERS}

# The times that dates in the samples are compared with.
MID_EVENTS = "2024-01-15 00:00:00"
AFTER_EVENTS = "2024-01-31 00:00:00"
LONG_AFTER_EVENTS = "2024-02-05 00:00:00"
INSIDE_A_DAY = "2024-01-31 02:00:00"
MID_TRIPS = "2000-01-01 00:00:00"
AFTER_TRIPS = "2002-01-01 00:00:00"


def _workspace(spark: SparkSession) -> Workspace:
    """A workspace of its own for one run, stored in the shared folder."""
    run = uuid.uuid4().hex[:12]
    workspace = Workspace("strata", f"sample_{run}", catalog="spark_catalog")
    workspace.create_schemas(spark, "test", scratch_path(spark, "layers"))
    return workspace


def _result(spark: SparkSession, workspace: Workspace, table: str) -> DataFrame:
    """The rows of a layer's table, kept while the layers of this run are dropped."""
    path = scratch_path(spark, "result")
    spark.read.table(table).write.parquet(path)
    kept = spark.read.parquet(path)
    _drop(spark, workspace)
    return kept


def _drop(spark: SparkSession, workspace: Workspace) -> None:
    for layer in LAYERS:
        spark.sql(f"DROP SCHEMA IF EXISTS {workspace.schema('test', layer)} CASCADE")


def _model(df: DataFrame, model: Callable[..., str], **options) -> DataFrame:
    """Run a SQL model over ``df``."""
    return df.sparkSession.sql(model("{source}", **options), source=df)


def _sql_silver(spark: SparkSession, sf_dir: str, nan: bool = False) -> DataFrame:
    return _model(trips(spark, sf_dir, nan), clean_model)


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(clean(trips(spark, sf_dir)), exact=True)


def _sql_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(_sql_silver(spark, sf_dir), daily_model, exact=True)


def _no_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").filter(F.col("ts") > F.lit(LONG_AFTER_EVENTS).cast("timestamp_ntz"))


def _union(*reports: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, reports)


# Sources and sinks


def bronze_passthrough(spark, sf_dir):
    return read_source(spark, path=f"{sf_dir}/events.parquet")


def bronze_lines(spark, sf_dir):
    """Events written as CSV and as JSON, some with a word for a number and some cut off, read back."""
    wrong = F.when(F.col("event_id") % 7 == 0, F.lit("many")).otherwise(F.col("user_id").cast("string"))
    event, kind = F.col("event_id").cast("string"), F.col("event_type")
    quoted = F.when(F.col("event_id") % 7 == 0, F.lit('"many"')).otherwise(F.col("user_id").cast("string"))
    texts = {
        "csv": F.concat_ws(",", event, wrong, kind),
        "json": F.concat(F.lit('{"event_id":'), event, F.lit(',"user_id":'), quoted, F.lit(',"event_type":"'), kind, F.lit('"}')),
    }
    found = []
    for format, text in texts.items():
        path = scratch_path(spark, format)
        cut = F.when(F.col("event_id") % 11 == 0, F.substring(text, 1, 5)).otherwise(text)
        read(spark, sf_dir, "events").select(cut.alias("value")).write.text(path)
        lines = read_lines(spark, path, "event_id bigint, user_id bigint, event_type string", format=format)
        good = accepted(lines).select(F.lit(format).alias("format"), "event_id", "user_id", "event_type", F.lit(None).cast("string").alias("line"))
        null = [F.lit(None).cast(t).alias(c) for c, t in (("event_id", "bigint"), ("user_id", "bigint"), ("event_type", "string"))]
        found += [good, rejected(lines).select(F.lit(format).alias("format"), *null, "line")]
    return _union(*found)


def bronze_append_evolved(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    path = scratch_path(spark, "bronze")
    append_evolving_path(events.drop("props"), path)
    append_evolving_path(events, path)
    return read_evolved(spark, path)


def bronze_table_evolved(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    workspace = _workspace(spark)
    table = workspace.table("test", "bronze", "events")
    append_evolving(events.drop("props"), table)
    append_evolving(events.drop("value").withColumn("received", F.to_date("ts")), table)
    append_evolving(events, table)
    return _result(spark, workspace, table)


def bronze_partitioned_evolved(spark, sf_dir):
    """A table divided by event type, whose second batch has one column more."""
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    workspace = _workspace(spark)
    table = workspace.table("test", "bronze", "events")
    append_evolving(events, table, layout=Layout(partition_by=("event_type",)))
    append_evolving(events.withColumn("twice", F.col("user_id") * 2), table)
    return _result(spark, workspace, table)


def bronze_nested_evolved(spark, sf_dir):
    """An array, a struct that gains a field, and a column without a type at first."""
    events = read(spark, sf_dir, "events")
    small = F.struct(F.col("user_id").alias("user"))
    wide = F.struct(F.col("user_id").alias("user"), F.col("value").alias("worth"))
    ids = events.select("event_id", F.array("event_id", "user_id").alias("ids"))
    workspace = _workspace(spark)
    table = workspace.table("test", "bronze", "events")
    first = ids.join(events.select("event_id", small.alias("who")), "event_id").withColumn("note", F.lit(None))
    second = ids.join(events.select("event_id", wide.alias("who"), F.col("event_type").alias("note")), "event_id")
    for batch in (first, first, second, second):
        append_evolving(batch, table)
    return _result(spark, workspace, table).select(
        "event_id", F.element_at("ids", 2).alias("second_id"), F.col("who.user").alias("who_user"), F.col("who.worth").alias("who_worth"), "note"
    )


def bronze_widen_retried(spark, sf_dir):
    """A batch whose struct has a new field dies after the table was widened, and is tried again."""
    events = read(spark, sf_dir, "events")
    small = F.struct(F.col("user_id").alias("user"))
    wide = F.struct(F.col("user_id").alias("user"), F.col("value").alias("worth"))
    workspace = _workspace(spark)
    table = workspace.table("test", "bronze", "events")
    append_evolving(events.select("event_id", small.alias("who")), table)
    second = events.select("event_id", wide.alias("who"), "event_type")
    evolve(spark, table, second.schema)
    append_evolving(second, table)
    found = _result(spark, workspace, table)
    return found.select("event_id", F.col("who.user").alias("who_user"), F.col("who.worth").alias("who_worth"), "event_type")


def bronze_batch_retried(spark, sf_dir):
    """Two batches; the first is sent again when it is stored, the second after it died unrecorded."""
    events = read(spark, sf_dir, "events")
    workspace = _workspace(spark)
    table = workspace.table("test", "bronze", "events")
    append_batch(events.drop("value"), table, "first")
    append_batch(events.drop("value"), table, "first")
    append_batch(events.filter("event_id % 2 = 0"), table, "second", done=False)
    append_batch(events, table, "second")
    return _result(spark, workspace, table).select("event_id", "user_id", "event_type", "value", BATCH)


def silver_refresh(spark, sf_dir):
    raw = trips(spark, sf_dir)
    path = scratch_path(spark, "silver")
    refresh_path(raw.select(taxi.PICKUP, F.lit("old").alias("status")), path)
    refresh_path(clean(raw), path)
    return spark.read.parquet(path)


# Filters, projections, duplicates


def drop_incomplete_rows(spark, sf_dir):
    return drop_incomplete(trips(spark, sf_dir, nan=True), taxi.REQUIRED)


def drop_null_sql(spark, sf_dir):
    kept = drop_nulls(trips(spark, sf_dir, nan=True), taxi.REQUIRED)
    return kept.groupBy(F.isnan("fare_amount").alias("fare_is_nan")).agg(
        F.count(F.lit(1)).alias("trips")
    )


def keep_passengers_between(spark, sf_dir):
    return keep_between(
        trips(spark, sf_dir), taxi.PASSENGERS, taxi.MIN_PASSENGERS, taxi.MAX_PASSENGERS
    )


def elapsed_minutes(spark, sf_dir):
    return with_elapsed(trips(spark, sf_dir), taxi.PICKUP, taxi.DROPOFF, taxi.DURATION)


def keep_positive_elapsed(spark, sf_dir):
    return keep_positive(elapsed_minutes(spark, sf_dir), taxi.DURATION)


def keep_end_after_start(spark, sf_dir):
    return keep_after(trips(spark, sf_dir), taxi.PICKUP, taxi.DROPOFF)


def project_columns(spark, sf_dir):
    return project(
        trips(spark, sf_dir),
        taxi.TRIP_COLUMNS,
        {taxi.DURATION: elapsed(taxi.PICKUP, taxi.DROPOFF)},
    )


def dedupe_rows(spark, sf_dir):
    return dedupe(trips(spark, sf_dir))


def scalar_functions(spark, sf_dir):
    start, end = F.unix_timestamp(taxi.PICKUP), F.unix_timestamp(taxi.DROPOFF)
    return trips(spark, sf_dir).select(
        start.alias("start_seconds"),
        end.alias("end_seconds"),
        (end - start).alias("seconds"),
        F.to_date(taxi.PICKUP).alias("pickup_date"),
        F.col(taxi.PASSENGERS).cast("long").alias("passengers"),
        (F.col(taxi.DROPOFF) > F.col(taxi.PICKUP)).alias("ends_after_start"),
        F.col(taxi.PASSENGERS).between(1, 6).alias("passengers_in_range"),
        F.col("fare_amount").isNotNull().alias("has_fare"),
    )


# Layers


def silver_clean(spark, sf_dir):
    return clean(trips(spark, sf_dir, nan=True))


def silver_clean_closed(spark, sf_dir):
    return clean(trips(spark, sf_dir), columns=taxi.TRIP_COLUMNS)


def silver_clean_sql(spark, sf_dir):
    return _sql_silver(spark, sf_dir)


def silver_clean_recomputed(spark, sf_dir):
    """Trips that carry a stale duration, another one for each copy."""
    stale = F.monotonically_increasing_id().cast("double")
    return clean(trips(spark, sf_dir, nan=True).withColumn(taxi.DURATION, stale))


def silver_clean_sql_nan(spark, sf_dir):
    return _by_nan(_sql_silver(spark, sf_dir, nan=True), "fare_amount", taxi.PICKUP)


def daily_summary_sql_nan(spark, sf_dir):
    """Both ways to average NaN rows, compared with integers only: the NaN itself as a flag."""
    silver = _sql_silver(spark, sf_dir, nan=True)
    exact = _model(silver, daily_model, exact=True)
    plain = _model(silver, daily_model).select(taxi.DAY, F.isnan("avg_fare_usd").alias("plain_is_nan"))
    return exact.join(plain, taxi.DAY).select(
        taxi.DAY,
        taxi.TRIP_COUNT,
        "total_passengers",
        "avg_trip_distance_miles",
        F.isnan("avg_fare_usd").alias("exact_is_nan"),
        "plain_is_nan",
        F.when(~F.isnan("avg_fare_usd"), F.col("avg_fare_usd")).alias("avg_fare_usd"),
    )


def _by_nan(df: DataFrame, column: str, day: str) -> DataFrame:
    return df.groupBy(F.to_date(day).alias("day"), F.isnan(column).alias("is_nan")).agg(F.count(F.lit(1)).alias("trips"))


def daily_summary_plain(spark, sf_dir):
    """The plain average; over whole numbers, whose sums are exact in any order."""
    silver = clean(trips(spark, sf_dir))
    return daily_summary_of(silver, taxi.PICKUP, taxi.DAY, taxi.TRIP_COUNT, _WHOLE, taxi.SUMS)


def daily_summary_plain_sql(spark, sf_dir):
    return _model(_sql_silver(spark, sf_dir), daily_model, averages=_WHOLE)


def daily_summary(spark, sf_dir):
    return aggregate(clean(trips(spark, sf_dir, nan=True)), exact=True)


def daily_summary_sql(spark, sf_dir):
    return _sql_gold(spark, sf_dir)


def rerun_idempotent(spark, sf_dir):
    workspace = _workspace(spark)
    raw = trips(spark, sf_dir)
    run_bronze(spark, "test", raw, workspace)
    run_silver(spark, "test", workspace)
    run_bronze(spark, "test", raw, workspace)
    return _result(spark, workspace, run_silver(spark, "test", workspace))


def _in_batches(spark: SparkSession, sf_dir: str, workspace: Workspace, nan: bool) -> None:
    """Trips sent in three batches, each row in two of them, and silver after each; one is sent twice."""
    # The sender makes its trips once: a batch reads them and does not join all tables again.
    sent = scratch_path(spark, "sent")
    made = trips(spark, sf_dir, nan)
    made.write.parquet(sent)
    raw = spark.read.schema(made.schema).parquet(sent)
    part = F.pmod(F.hash(taxi.PICKUP, "total_amount", taxi.PASSENGERS), F.lit(3))
    for i in range(3):
        run_bronze_batch(spark, "test", raw.filter(part != i), f"batch-{i}", workspace)
        run_silver_increment(spark, "test", workspace)
    run_bronze_batch(spark, "test", raw, "batch-1", workspace)
    run_silver_increment(spark, "test", workspace)
    discard(spark, sent)


def silver_incremental(spark, sf_dir):
    workspace = _workspace(spark)
    _in_batches(spark, sf_dir, workspace, nan=False)
    return _result(spark, workspace, workspace.table("test", "silver", increments.SILVER)).drop(BATCH, increments.PERIOD)


def gold_incremental(spark, sf_dir):
    workspace = _workspace(spark)
    _in_batches(spark, sf_dir, workspace, nan=True)
    return _result(spark, workspace, run_gold_increment(spark, "test", workspace))


def layered_gold(spark, sf_dir):
    raw, workspace = trips(spark, sf_dir, nan=True), _workspace(spark)
    return _result(spark, workspace, run_all(spark, "test", raw, workspace, exact=True))


def gold_stored_order(spark, sf_dir):
    """Where the stored summary holds each day: its files, one after the other, are in order."""
    workspace = _workspace(spark)
    gold = run_all(spark, "test", trips(spark, sf_dir, nan=True), workspace, exact=True)
    path = scratch_path(spark, "positions")
    positions(spark, gold).select(taxi.DAY, taxi.TRIP_COUNT, "position").write.parquet(path)
    _drop(spark, workspace)
    return spark.read.parquet(path)


def layered_gold_sql(spark, sf_dir):
    workspace = _workspace(spark)
    run_bronze(spark, "test", trips(spark, sf_dir), workspace)
    run_silver_model(spark, "test", workspace)
    return _result(spark, workspace, run_gold_model(spark, "test", workspace, exact=True))


def gated_gold(spark, sf_dir):
    workspace = _workspace(spark)
    run_bronze(spark, "test", trips(spark, sf_dir), workspace)
    run_gated(spark, "test", workspace, exact=True)
    return _result(spark, workspace, workspace.table("test", "gold", taxi.DAILY))


def gated_report(spark, sf_dir):
    workspace = _workspace(spark)
    run_bronze(spark, "test", trips(spark, sf_dir), workspace)
    report = run_gated(spark, "test", workspace, exact=True)
    _drop(spark, workspace)
    return report


# Checks, each on a table that passes and on one that fails


def check_not_null(spark, sf_dir):
    rules = [not_null("fare_amount")]
    return _union(
        evaluate(trips(spark, sf_dir), rules, "trips"),
        evaluate(_sql_silver(spark, sf_dir), rules, "silver"),
    )


def check_declared_nulls(spark, sf_dir):
    declared = [f.name for f in taxi.contract("trips_silver").fields if not f.nullable]
    rules = [declared_not_null(c) for c in declared]
    raw = [r for r in rules if r.column != taxi.DURATION]
    return _union(
        evaluate(trips(spark, sf_dir), raw, "trips"),
        evaluate(_sql_silver(spark, sf_dir), rules, "silver"),
    )


def check_unique(spark, sf_dir):
    return _union(
        evaluate(_gold(spark, sf_dir), [unique(taxi.DAY)], "gold"),
        evaluate(read(spark, sf_dir, "lineitem"), [unique("l_orderkey")], "lineitem"),
    )


def check_primary_key(spark, sf_dir):
    return _union(
        evaluate(_gold(spark, sf_dir), [primary_key(taxi.DAY)], "gold"),
        evaluate(trips(spark, sf_dir), [primary_key(taxi.PICKUP)], "trips"),
    )


def check_accepted_values(spark, sf_dir):
    rules = [accepted_values(taxi.PASSENGERS, [1, 2, 3, 4, 5, 6])]
    return _union(
        evaluate(_sql_silver(spark, sf_dir), rules, "silver"),
        evaluate(trips(spark, sf_dir), rules, "trips"),
    )


def check_value_between(spark, sf_dir):
    rules = [value_between(taxi.PASSENGERS, taxi.MIN_PASSENGERS, taxi.MAX_PASSENGERS)]
    fares = [value_between("fare_amount", 0, 50000, "warning")]
    return _union(
        evaluate(_sql_silver(spark, sf_dir), rules, "silver"),
        evaluate(trips(spark, sf_dir), rules, "trips"),
        evaluate(trips(spark, sf_dir, nan=True), fares, "trips with NaN"),
    )


def check_value_above(spark, sf_dir):
    rules = [value_above(taxi.DURATION, 0)]
    return _union(
        evaluate(clean(trips(spark, sf_dir)), rules, "silver"),
        evaluate(_sql_silver(spark, sf_dir), rules, "sql silver"),
    )


def check_value_above_or_equal(spark, sf_dir):
    rules = [value_above_or_equal("fare_amount", 0, "warning")]
    return _union(
        evaluate(clean(trips(spark, sf_dir)), rules, "silver"),
        evaluate(_sql_silver(spark, sf_dir), rules, "sql silver"),
        evaluate(read(spark, sf_dir, "orders"), [value_above_or_equal("o_totalprice", 0)], "orders"),
    )


def check_not_empty(spark, sf_dir):
    return _union(
        evaluate(trips(spark, sf_dir), [table_not_empty()], "trips"),
        evaluate(_no_events(spark, sf_dir), [table_not_empty()], "late events"),
    )


def check_row_count(spark, sf_dir):
    return _union(
        evaluate(trips(spark, sf_dir), [row_count_above(1)], "trips"),
        evaluate(_no_events(spark, sf_dir), [row_count_above(1)], "late events"),
    )


def check_no_future(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    return _union(
        evaluate(events, [no_future("ts", MID_EVENTS)], "events at mid month"),
        evaluate(events, [no_future("ts", AFTER_EVENTS)], "events at month end"),
    )


def check_no_duplicates(spark, sf_dir):
    return _union(
        evaluate(_sql_silver(spark, sf_dir), [no_duplicates()], "silver"),
        evaluate(trips(spark, sf_dir), [no_duplicates()], "trips"),
    )


def check_freshness(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    day = F.to_date("ts").alias("day")
    return _union(
        evaluate(events, [freshness("ts", 25, AFTER_EVENTS)], "events at month end"),
        evaluate(events, [freshness("ts", 25, LONG_AFTER_EVENTS)], "events later"),
        evaluate(events.select(day), [freshness("day", 25.5, INSIDE_A_DAY)], "event days"),
        evaluate(events.select(day), [freshness("day", 26.5, INSIDE_A_DAY)], "event days, longer"),
    )


def check_availability(spark, sf_dir):
    """Each order and each line item is read as a run; an order still open failed."""
    rules = [taxi.contract("trips_silver").availability_rule("ok")]
    orders = read(spark, sf_dir, "orders").select((F.col("o_orderstatus") != "P").alias("ok"))
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").isin("F", "O").alias("ok")
    )
    return _union(evaluate(orders, rules, "orders"), evaluate(lines, rules, "lineitem"))


def bronze_report(spark, sf_dir):
    rules = taxi.contract("trips_bronze").rules(as_of=MID_TRIPS, fresh=taxi.PICKUP)
    return evaluate(trips(spark, sf_dir), rules, "bronze")


def contract_report(spark, sf_dir):
    rules = taxi.contract("trips_silver").rules(as_of=AFTER_TRIPS, fresh=taxi.PICKUP)
    return evaluate(_sql_silver(spark, sf_dir), rules, "silver")


def gold_report(spark, sf_dir):
    rules = taxi.contract("daily_gold").rules(as_of=AFTER_TRIPS, fresh=taxi.DAY)
    path = scratch_path(spark, "gold")
    refresh_path(_sql_gold(spark, sf_dir), path)
    return evaluate(spark.read.parquet(path), rules, "gold")


def footer_report(spark, sf_dir):
    """Rules about all events and their days, answered from the footers of stored files."""
    path = scratch_path(spark, "event-days")
    refresh_path(read(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), path)
    rules = [
        table_not_empty(),
        row_count_above(1),
        no_future("ts", MID_EVENTS),
        freshness("ts", 25, LONG_AFTER_EVENTS),
        freshness("day", 25.5, INSIDE_A_DAY),
    ]
    return evaluate_footers(spark, path, rules, "event days")


def contract_conformance(spark, sf_dir):
    """Stored layers held to their contracts, and raw trips to one they do not meet."""
    workspace = _workspace(spark)
    raw = trips(spark, sf_dir)
    gold = run_all(spark, "test", raw, workspace, exact=True)
    silver = workspace.table("test", "silver", taxi.TRIPS)
    lines = []
    for table, name, fresh in ((silver, "trips_silver", taxi.PICKUP), (gold, "daily_gold", taxi.DAY)):
        contract = taxi.contract(name)
        lines += schema_report(spark.read.table(table), contract, table.split(".")[-1]).collect()
        lines += check_table(spark, table, contract, AFTER_TRIPS, fresh).collect()
    lines += schema_report(raw, taxi.contract("daily_gold"), "raw").collect()
    _drop(spark, workspace)
    return spark.createDataFrame(lines, REPORT_SCHEMA)


# Query names that differ from the name of the function.
_NAMES = {"drop_incomplete_rows": "drop_incomplete", "keep_passengers_between": "keep_between"}

_QUERIES = (
    bronze_passthrough,
    bronze_lines,
    bronze_append_evolved,
    bronze_table_evolved,
    bronze_partitioned_evolved,
    bronze_nested_evolved,
    bronze_widen_retried,
    bronze_batch_retried,
    silver_refresh,
    drop_incomplete_rows,
    drop_null_sql,
    keep_passengers_between,
    elapsed_minutes,
    keep_positive_elapsed,
    keep_end_after_start,
    project_columns,
    dedupe_rows,
    scalar_functions,
    silver_clean,
    silver_clean_closed,
    silver_clean_sql,
    silver_clean_sql_nan,
    silver_clean_recomputed,
    daily_summary,
    daily_summary_sql,
    daily_summary_sql_nan,
    daily_summary_plain,
    daily_summary_plain_sql,
    rerun_idempotent,
    silver_incremental,
    gold_incremental,
    layered_gold,
    gold_stored_order,
    layered_gold_sql,
    gated_gold,
    gated_report,
    check_not_null,
    check_declared_nulls,
    check_unique,
    check_primary_key,
    check_accepted_values,
    check_value_between,
    check_value_above,
    check_value_above_or_equal,
    check_not_empty,
    check_row_count,
    check_no_future,
    check_no_duplicates,
    check_freshness,
    check_availability,
    bronze_report,
    contract_report,
    gold_report,
    footer_report,
    contract_conformance,
)


def _configured(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(configure(spark), sf_dir)

    return run


def queries() -> dict[str, Query]:
    """All queries by name; each pins the session settings it depends on."""
    return {_NAMES.get(q.__name__, q.__name__): _configured(q) for q in _QUERIES}
