"""Averages rounded half up to a number of decimal places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded_average(column: str, places: int = 2) -> Column:
    """Plain average of doubles, then rounded."""
    return F.round(F.avg(column), places)


def exact_average(column: str, places: int = 2) -> Column:
    """Average of values that have at most ``places`` decimals, in integers.

    A sum of doubles depends on the order in which partitions arrive, so two runs
    may round a tie differently. Sums of integers do not. A NaN value makes the
    average NaN, as it does for the plain average.
    """
    return average_of_units(units_sum(column, places), units_count(column), any_nan(column), places)


def units_sum(column: str, places: int = 2) -> Column:
    """Sum of the values in units of the last place, as a long; NaN is left out."""
    value = F.col(column).cast("double")
    return F.sum(F.when(~F.isnan(value), F.rint(value * 10**places).cast("long")))


def units_count(column: str) -> Column:
    """How many values there are, NaN included."""
    return F.count(column)


def any_nan(column: str) -> Column:
    """Whether a value is NaN."""
    return F.bool_or(F.isnan(F.col(column).cast("double")))


def average_of_units(units: Column, count: Column, nan: Column, places: int = 2) -> Column:
    """The rounded average that a sum of units, a count and a NaN flag stand for."""
    half = F.when(units < 0, -count).otherwise(count)
    average = F.call_function("div", units * 2 + half, F.nullif(count * 2, F.lit(0))) / 10**places
    return F.when(nan, F.lit(float("nan"))).otherwise(average)
