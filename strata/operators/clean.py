"""Row filters, derived columns and duplicate removal."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions import elapsed


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda left, right: left & right, conditions, F.lit(True))


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows where any of ``columns`` is null, or NaN in a float column.

    Keeps the rows ``dropna`` keeps. Its predicate is not pushed into the scan,
    while ``IS NOT NULL`` is, so the null tests are spelled out.
    """
    floats = [
        c for c in columns if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
    ]
    present = [F.col(c).isNotNull() for c in columns]
    return df.filter(_all(present + [~F.isnan(c) for c in floats]))


def drop_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows where any of ``columns`` is null; NaN stays."""
    return df.filter(_all([F.col(c).isNotNull() for c in columns]))


def keep_between(df: DataFrame, column: str, low, high) -> DataFrame:
    """Keep rows with ``low <= column <= high``; a null is dropped."""
    return df.filter(F.col(column).between(low, high))


def with_elapsed(
    df: DataFrame, start: str, end: str, name: str, unit_seconds: int = 60, places: int = 2
) -> DataFrame:
    """Add the elapsed time from ``start`` to ``end`` as column ``name``."""
    return df.withColumn(name, elapsed(start, end, unit_seconds, places))


def keep_positive(df: DataFrame, value: str | Column) -> DataFrame:
    """Keep rows where a column, or an expression over columns, is above 0."""
    return df.filter((F.col(value) if isinstance(value, str) else value) > 0)


def keep_after(df: DataFrame, start: str, end: str) -> DataFrame:
    """Keep rows with ``end`` after ``start``, at full timestamp precision."""
    return df.filter(F.col(end) > F.col(start))


def project(
    df: DataFrame, columns: Sequence[str], derived: Mapping[str, Column] | None = None
) -> DataFrame:
    """Keep ``columns`` in this order, then the ``derived`` ones."""
    return df.select(*columns, *(c.alias(name) for name, c in (derived or {}).items()))


def dedupe(df: DataFrame) -> DataFrame:
    """Keep one copy of each row, compared over all columns.

    Spark drops copies inside each task before the shuffle, so a row repeated in
    a third of the input reaches its reducer once per task, not once per copy.
    """
    return df.dropDuplicates()
