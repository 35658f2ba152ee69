"""The DataFrame path: bronze, silver and gold jobs over stored tables.

Each job reads the table of the layer below, so it can be repeated on its own, and
gold reads only the silver columns it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from strata.functions import elapsed
from strata.names import Workspace
from strata.operators import (
    daily_summary,
    dedupe,
    drop_incomplete,
    keep_between,
    keep_positive,
    project,
    with_elapsed,
)
from strata.plans import taxi
from strata.session import sized_session
from strata.sinks import Layout, append_evolving, refresh
from strata.sources import read_table


def clean(
    df: DataFrame, columns: Sequence[str] | None = None, distinct: Callable[[DataFrame], DataFrame] = dedupe
) -> DataFrame:
    """Bronze trips to silver trips; all input columns pass through.

    Copies are compared over all columns. After the source gained a column, a trip
    ingested before and after differs in it and stays twice; ``columns`` (the bronze
    columns to keep, both timestamps among them) compares without it.

    The duration follows from the timestamps, so it is added after the copies are
    gone: the shuffle carries one column less. ``distinct`` removes the copies, and may
    remove in the same shuffle what is stored already.
    """
    # A stale duration in the input would tell copies apart.
    trips = (
        df.drop(taxi.DURATION)
        .transform(drop_incomplete, taxi.REQUIRED)
        .transform(keep_between, taxi.PASSENGERS, taxi.MIN_PASSENGERS, taxi.MAX_PASSENGERS)
        .transform(keep_positive, elapsed(taxi.PICKUP, taxi.DROPOFF))
    )
    if columns is not None:
        trips = trips.transform(project, columns)
    return trips.transform(distinct).transform(
        with_elapsed, taxi.PICKUP, taxi.DROPOFF, taxi.DURATION
    )


def aggregate(df: DataFrame, exact: bool = False) -> DataFrame:
    """Silver trips to the daily summary."""
    return daily_summary(
        df, taxi.PICKUP, taxi.DAY, taxi.TRIP_COUNT, taxi.AVERAGES, taxi.SUMS, exact=exact
    )


def run_bronze(
    spark: SparkSession,
    env: str,
    source: DataFrame | str,
    workspace: Workspace = taxi.WORKSPACE,
    layout: Layout | None = None,
    compact: bool = False,
) -> str:
    """Append the whole source, a table name or a DataFrame, to bronze.

    ``layout`` holds for a table that is created. A source of many small files would stay so;
    ``compact`` shuffles it to files of ``spark.sql.adaptive.advisoryPartitionSizeInBytes``.
    """
    raw = read_table(spark, source) if isinstance(source, str) else source
    target = workspace.table(env, "bronze", taxi.TRIPS)
    append_evolving(raw.hint("rebalance") if compact else raw, target, workspace.format, layout)
    return target


def run_silver(
    spark: SparkSession,
    env: str,
    workspace: Workspace = taxi.WORKSPACE,
    columns: Sequence[str] | None = None,
) -> str:
    """Rebuild silver from bronze."""
    source = workspace.table(env, "bronze", taxi.TRIPS)
    target = workspace.table(env, "silver", taxi.TRIPS)
    own = sized_session(read_table(spark, source))
    refresh(clean(read_table(own, source), columns), target, workspace.format)
    spark.catalog.refreshTable(target)  # it was written in another session
    return target


def run_gold(
    spark: SparkSession, env: str, workspace: Workspace = taxi.WORKSPACE, exact: bool = False
) -> str:
    """Rebuild the daily summary from silver.

    The SQL path stores its summary under the same name, so the later run replaces the
    other's; give each path a workspace of its own where both run.
    """
    source = workspace.table(env, "silver", taxi.TRIPS)
    target = workspace.table(env, "gold", taxi.DAILY)
    own = sized_session(read_table(spark, source), shuffles=False)
    refresh(aggregate(read_table(own, source), exact), target, workspace.format)
    spark.catalog.refreshTable(target)
    return target


def run_all(
    spark: SparkSession,
    env: str,
    source: DataFrame | str,
    workspace: Workspace = taxi.WORKSPACE,
    exact: bool = False,
) -> str:
    """Bronze, silver and gold in turn; returns the gold table's name."""
    run_bronze(spark, env, source, workspace)
    run_silver(spark, env, workspace)
    return run_gold(spark, env, workspace, exact)
