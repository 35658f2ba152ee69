"""The SQL path: two models, materialized as tables, with tests between them.

The models differ from the DataFrame jobs on purpose: the column list is closed,
NaN counts as a value, and a trip shorter than a second stays, with duration 0.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Row, SparkSession

from strata.functions import elapsed_sql, quoted
from strata.names import Workspace
from strata.plans import taxi
from strata.quality import (
    REPORT_SCHEMA,
    Contract,
    ContractViolation,
    Rule,
    evaluate,
    observe,
    raise_on_failure,
    schema_problems,
)
from strata.session import sized_session
from strata.sinks import refresh


def clean_model(
    source: str,
    *,
    columns: Sequence[str] = taxi.TRIP_COLUMNS,
    required: Sequence[str] = taxi.REQUIRED,
    counted: str = taxi.PASSENGERS,
    low: int = taxi.MIN_PASSENGERS,
    high: int = taxi.MAX_PASSENGERS,
    start: str = taxi.PICKUP,
    end: str = taxi.DROPOFF,
    duration: str = taxi.DURATION,
) -> str:
    """SQL of the clean rows of table or view ``source``.

    ``columns`` hold ``start`` and ``end``, from which the duration follows; it is
    added to the distinct rows.
    """
    complete = " AND ".join(f"{quoted(c)} IS NOT NULL" for c in required)
    return f"""
        WITH trips AS (
            SELECT DISTINCT {", ".join(map(quoted, columns))}
            FROM {source}
            WHERE {complete} AND {quoted(counted)} BETWEEN {low} AND {high}
                AND {quoted(end)} > {quoted(start)}
        )
        SELECT *, {elapsed_sql(start, end)} AS {quoted(duration)} FROM trips
    """


def daily_model(
    source: str,
    *,
    timestamp: str = taxi.PICKUP,
    day: str = taxi.DAY,
    rows: str = taxi.TRIP_COUNT,
    averages: Mapping[str, str] = taxi.AVERAGES,
    sums: Mapping[str, str] = taxi.SUMS,
    exact: bool = False,
) -> str:
    """SQL of one summary row per day of table or view ``source``.

    ``exact`` averages in integers, for inputs with at most two decimals; as with the
    plain average, a NaN makes the average NaN.
    """

    def average(column: str) -> str:
        name = quoted(column)
        if not exact:
            return f"ROUND(AVG({name}), 2)"
        number = f"CAST({name} AS DOUBLE)"
        units = f"SUM(CASE WHEN NOT ISNAN({number}) THEN CAST(RINT({number} * 100) AS BIGINT) END)"
        half = f"IF({units} < 0, -COUNT({name}), COUNT({name}))"
        mean = f"({units} * 2 + {half}) DIV NULLIF(COUNT({name}) * 2, 0) / 100"
        return f"IF(BOOL_OR(ISNAN({number})), DOUBLE('NaN'), {mean})"

    date = f"CAST({quoted(timestamp)} AS DATE)"
    measures = [f"COUNT(*) AS {quoted(rows)}"]
    measures += [f"{average(column)} AS {quoted(name)}" for name, column in averages.items()]
    measures += [f"CAST(SUM({quoted(column)}) AS BIGINT) AS {quoted(name)}" for name, column in sums.items()]
    return f"""
        SELECT {date} AS {quoted(day)}, {", ".join(measures)}
        FROM {source}
        GROUP BY {date}
        ORDER BY {quoted(day)}
    """


def build_model(spark: SparkSession, sql: str, target: str, format: str = "parquet") -> str:
    """Run a model and store its result as table ``target``."""
    refresh(spark.sql(sql), target, format)
    return target


def run_silver_model(
    spark: SparkSession, env: str, workspace: Workspace = taxi.WORKSPACE
) -> str:
    """Rebuild the clean SQL model from bronze."""
    source = workspace.table(env, "bronze", taxi.TRIPS)
    target = workspace.table(env, "silver", taxi.TRIPS_MODEL)
    own = sized_session(spark.read.table(source))
    build_model(own, clean_model(source), target, workspace.format)
    spark.catalog.refreshTable(target)  # it was written in another session
    return target


def run_gold_model(
    spark: SparkSession, env: str, workspace: Workspace = taxi.WORKSPACE, exact: bool = False
) -> str:
    """Rebuild the daily SQL model from the clean one."""
    source = workspace.table(env, "silver", taxi.TRIPS_MODEL)
    target = workspace.table(env, "gold", taxi.DAILY)
    own = sized_session(spark.read.table(source), shuffles=False)
    build_model(own, daily_model(source, exact=exact), target, workspace.format)
    spark.catalog.refreshTable(target)
    return target


def _build_and_test(
    spark: SparkSession, sql: str, target: str, tests: Sequence[Rule] | Contract, format: str
) -> list[Row]:
    """Store a model, then require its tests; returns the rows of their report.

    Row tests are counted while the table is written; only key tests read it back.
    """
    table = target.split(".")[-1]
    if isinstance(tests, Contract):
        if problems := schema_problems(spark.sql(sql), tests):
            raise ContractViolation(f"{table}: {'; '.join(problems)}")
        tests = tests.rules()
    keyed = [t for t in tests if t.is_keyed]
    counted, observed = observe(spark.sql(sql), [t for t in tests if not t.is_keyed], table)
    refresh(counted, target, format)
    lines = observed.lines()
    if keyed:
        lines += evaluate(spark.read.table(target), keyed, table).collect()
    raise_on_failure(lines)
    return lines


def run_gated(
    spark: SparkSession,
    env: str,
    workspace: Workspace = taxi.WORKSPACE,
    exact: bool = False,
    silver_tests: Sequence[Rule] | Contract | None = None,
    gold_tests: Sequence[Rule] | Contract | None = None,
) -> DataFrame:
    """Clean model, its tests, daily model, its tests; returns the report of both.

    A failed critical test raises :class:`strata.quality.ContractViolation`, and
    nothing after it is built. The default tests are those of :mod:`strata.plans.taxi`. A
    whole contract can be given instead: the model's columns have to conform before it is
    stored, then the contract's rules have to hold.
    """
    bronze = workspace.table(env, "bronze", taxi.TRIPS)
    silver = workspace.table(env, "silver", taxi.TRIPS_MODEL)
    gold = workspace.table(env, "gold", taxi.DAILY)
    silver_tests = taxi.silver_tests() if silver_tests is None else silver_tests
    gold_tests = taxi.gold_tests() if gold_tests is None else gold_tests
    own = sized_session(spark.read.table(bronze))
    first = _build_and_test(own, clean_model(bronze), silver, silver_tests, workspace.format)
    summary = daily_model(silver, exact=exact)
    second = _build_and_test(own, summary, gold, gold_tests, workspace.format)
    for target in (silver, gold):
        spark.catalog.refreshTable(target)  # they were written in another session
    return spark.createDataFrame(first + second, REPORT_SCHEMA)
