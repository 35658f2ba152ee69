"""Evaluation of rules into a report DataFrame, and the gate on it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.quality.rules import CRITICAL, Rule

REPORT_SCHEMA = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("total_rows", T.LongType()),
        T.StructField("failing_rows", T.LongType()),
        T.StructField("passed", T.BooleanType()),
    ]
)

_COPIES = "__copies"
_TOTAL = "__total"


class ContractViolation(Exception):
    """A critical rule failed."""


def _failing(rule: Rule, schema: T.StructType, copies: Column) -> Column:
    """Aggregate that counts the rows failing ``rule``; each input row stands for ``copies``."""

    def tally(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, copies)), F.lit(0))

    if rule.is_keyed:
        return F.coalesce(F.sum(rule.surplus(schema, copies)), F.lit(0)).cast("long")
    if rule.violated is not None:
        return tally(rule.violated(schema)).cast("long")
    rows = F.coalesce(F.sum(copies), F.lit(0))
    return F.when(rule.broken(schema, rows, tally), 1).otherwise(0).cast("long")


def _counters(rules: Sequence[Rule], schema: T.StructType, copies: Column) -> list[Column]:
    return [
        F.coalesce(F.sum(copies), F.lit(0)).cast("long").alias(_TOTAL),
        *(_failing(rule, schema, copies).alias(f"__{i}") for i, rule in enumerate(rules)),
    ]


def _unpivot(counters: DataFrame, rules: Sequence[Rule], table: str) -> DataFrame:
    lines = [
        F.struct(
            F.lit(table).alias("table_name"),
            F.lit(rule.name).alias("rule"),
            F.lit(rule.column).cast("string").alias("column_name"),
            F.lit(rule.severity).alias("severity"),
            F.col(_TOTAL).alias("total_rows"),
            F.col(f"__{i}").alias("failing_rows"),
            (F.col(f"__{i}") == 0).alias("passed"),
        )
        for i, rule in enumerate(rules)
    ]
    return counters.select(F.inline(F.array(*lines)))


def _rides_on(rule: Rule, key: tuple[str, ...]) -> bool:
    """Whether ``rule`` can be answered from rows grouped by ``key``.

    Violations are counted while grouping. A rule about the table can look at the number of
    rows and at columns of the key.
    """
    return rule.violated is not None or rule.column is None or rule.column in key


def evaluate(df: DataFrame, rules: Sequence[Rule], table: str = "") -> DataFrame:
    """Report with one row per rule: rows looked at, rows failing, passed or not.

    All row and table rules share one pass over the columns they name. Key rules
    with the same key share one grouping. The other rules ride on the first grouping,
    whose tasks count their violations beside the copies of each key, so a table with one
    key is read once in all. If the key is the whole row, they are counted once per
    distinct row instead and weighted by its copies. Copies are counted inside each task
    before they are shuffled, so a hot key costs one row per task.

    The report runs with the number of shuffle partitions of the session of ``df``. A
    no_duplicates rule shuffles whole rows: read large tables through
    :func:`strata.session.sized_session`, as ``check_table`` does.
    """
    plain = [rule for rule in rules if not rule.is_keyed]
    keyed: dict[tuple[str, ...], list[Rule]] = {}
    for rule in rules:
        if rule.is_keyed:
            keyed.setdefault(rule.key or tuple(df.columns), []).append(rule)

    parts = []
    # A grouping by whole rows takes the other rules first, for it reads all columns anyway.
    for key, group in sorted(keyed.items(), key=lambda x: set(x[0]) != set(df.columns)):
        whole = set(key) == set(df.columns)
        riding = [rule for rule in plain if whole or _rides_on(rule, key)]
        plain = [rule for rule in plain if rule not in riding]
        counted = [] if whole else [rule for rule in riding if rule.violated is not None]
        copies = df.groupBy(*(F.col(f"`{c}`") for c in key)).agg(
            F.count(F.lit(1)).alias(_COPIES),
            *(F.count_if(rule.violated(df.schema)).alias(f"__violated{i}") for i, rule in enumerate(counted)),
        )
        sums = {id(rule): F.coalesce(F.sum(f"__violated{i}"), F.lit(0)) for i, rule in enumerate(counted)}
        group = group + riding
        counters = [F.coalesce(F.sum(_COPIES), F.lit(0)).cast("long").alias(_TOTAL)]
        for i, rule in enumerate(group):
            count = sums.get(id(rule))
            counters.append((_failing(rule, df.schema, F.col(_COPIES)) if count is None else count).cast("long").alias(f"__{i}"))
        parts.append(_unpivot(copies.agg(*counters), group, table))
    if plain:
        parts.append(_unpivot(df.agg(*_counters(plain, df.schema, F.lit(1))), plain, table))
    if not parts:
        return df.sparkSession.createDataFrame([], REPORT_SCHEMA)
    return reduce(DataFrame.unionAll, parts)


class Observed:
    """Counters of row and table rules, filled while the DataFrame is written."""

    def __init__(self, observation: Observation, rules: Sequence[Rule], table: str):
        self._observation = observation
        self._rules = rules
        self._table = table

    def lines(self) -> list[Row]:
        """The report's rows; waits for the write to have run."""
        counted = self._observation.get
        line = Row(*REPORT_SCHEMA.names)
        return [
            line(
                self._table,
                rule.name,
                rule.column,
                rule.severity,
                counted[_TOTAL],
                counted[f"__{i}"],
                counted[f"__{i}"] == 0,
            )
            for i, rule in enumerate(self._rules)
        ]

    def report(self, spark: SparkSession) -> DataFrame:
        """The report as a DataFrame."""
        return spark.createDataFrame(self.lines(), REPORT_SCHEMA)


def observe(df: DataFrame, rules: Sequence[Rule], table: str = "") -> tuple[DataFrame, Observed]:
    """Count row and table rules on the rows that pass through ``df``.

    Writing the returned DataFrame fills the counters, so a table can be checked
    without being read again. Key rules need a shuffle and are not accepted.
    """
    if any(rule.is_keyed for rule in rules):
        raise ValueError("key rules cannot be observed; evaluate them on the table")
    observation = Observation()
    counters = _counters(rules, df.schema, F.lit(1))
    return df.observe(observation, *counters), Observed(observation, rules, table)


def raise_on_failure(lines: Sequence[Row]) -> None:
    """Raise :class:`ContractViolation` naming the critical rules that failed."""
    failed = [line for line in lines if line.severity == CRITICAL and not line.passed]
    if failed:
        raise ContractViolation(
            "; ".join(
                f"{line.table_name}: {line.rule}({line.column_name or '*'}) fails for "
                f"{line.failing_rows} of {line.total_rows}"
                for line in failed
            )
        )


def require(report: DataFrame) -> DataFrame:
    """Return ``report`` as evaluated rows, or raise if a critical rule failed.

    A report has one row per rule, so it is collected whole.
    """
    lines = report.collect()
    raise_on_failure(lines)
    return report.sparkSession.createDataFrame(lines, REPORT_SCHEMA)
