"""Time between two timestamps, in a unit, rounded half up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A column's name as SQL text, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def elapsed_sql(start: str, end: str, unit_seconds: int = 60, places: int = 2) -> str:
    """SQL text of the elapsed time from ``start`` to ``end``.

    Both ends are cut to whole seconds. The value equals
    ``round(seconds / unit_seconds, places)`` to the last bit, but is computed in
    integers: ``round`` on a double goes through decimal text for every row.
    """
    scale = 10**places
    seconds = f"(unix_timestamp({quoted(end)}) - unix_timestamp({quoted(start)}))"
    half = f"IF({seconds} < 0, -{unit_seconds}, {unit_seconds})"
    return f"({seconds} * {2 * scale} + {half}) DIV {2 * unit_seconds} / {scale}"


def elapsed(start: str, end: str, unit_seconds: int = 60, places: int = 2) -> Column:
    """Column form of :func:`elapsed_sql`."""
    return F.expr(elapsed_sql(start, end, unit_seconds, places))
