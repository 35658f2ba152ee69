"""One row per calendar day."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import any_nan, average_of_units, exact_average, rounded_average, units_count, units_sum


def daily_summary(
    df: DataFrame,
    timestamp: str,
    day: str,
    rows: str,
    averages: Mapping[str, str],
    sums: Mapping[str, str],
    *,
    places: int = 2,
    exact: bool = False,
) -> DataFrame:
    """Group by the date of ``timestamp`` and sort by it.

    ``averages`` and ``sums`` map result columns to input columns. Averages are
    rounded to ``places``; ``exact`` computes them in integers (see
    :func:`strata.functions.exact_average`). Sums come back as longs. Each task
    pre-aggregates its rows, so what is shuffled grows with tasks times days and
    a day holding most of the rows weighs no more than another.
    """
    average = exact_average if exact else rounded_average
    return (
        df.groupBy(F.to_date(timestamp).alias(day))
        .agg(
            F.count(F.lit(1)).alias(rows),
            *(average(column, places).alias(name) for name, column in averages.items()),
            *(F.sum(column).cast("long").alias(name) for name, column in sums.items()),
        )
        .orderBy(day)
    )


def daily_parts(
    df: DataFrame,
    timestamp: str,
    day: str,
    rows: str,
    averages: Mapping[str, str],
    sums: Mapping[str, str],
    *,
    places: int = 2,
) -> DataFrame:
    """What each day of ``df`` adds to an exact :func:`daily_summary`: counts, integer sums, NaN flags.

    Parts of disjoint rows can be stored and merged by :func:`merged_days` in any order.
    """
    found = [F.count(F.lit(1)).alias(rows)]
    for name, column in averages.items():
        found += [
            units_sum(column, places).alias(f"{name}_units"),
            units_count(column).alias(f"{name}_count"),
            any_nan(column).alias(f"{name}_nan"),
        ]
    found += [F.sum(column).cast("long").alias(name) for name, column in sums.items()]
    return df.groupBy(F.to_date(timestamp).alias(day)).agg(*found)


def merged_days(
    parts: DataFrame, day: str, rows: str, averages: Mapping[str, str], sums: Mapping[str, str], *, places: int = 2
) -> DataFrame:
    """The exact :func:`daily_summary` of all rows that ``parts`` stand for."""

    def average(name: str) -> Column:
        units, count, nan = F.sum(f"{name}_units"), F.sum(f"{name}_count"), F.bool_or(f"{name}_nan")
        return average_of_units(units, count, nan, places).alias(name)

    return (
        parts.groupBy(day)
        .agg(F.sum(rows).alias(rows), *map(average, averages), *(F.sum(name).alias(name) for name in sums))
        .orderBy(day)
    )
