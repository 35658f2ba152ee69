"""Quality rules as column expressions.

A *row* rule counts the rows that violate it. A *table* rule looks at the table as
a whole and fails once or not at all. A *key* rule needs the rows grouped by its
columns. A null passes every rule except those about nulls and keys; NaN violates
every range rule.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CRITICAL = "critical"
WARNING = "warning"


@dataclass(frozen=True)
class Rule:
    """One rule of a table.

    ``violated(schema)`` gives the condition under which a row fails.
    ``broken(schema, rows, tally)`` gives the condition under which the table
    fails, where ``rows`` is its row count and ``tally(condition)`` counts rows.
    ``surplus(schema, copies)`` gives how many rows of one key group fail; an empty ``key``
    stands for all columns.
    """

    name: str
    column: str | None = None
    severity: str = CRITICAL
    violated: Callable[[T.StructType], Column] | None = None
    broken: Callable[[T.StructType, Column, Callable[[Column], Column]], Column] | None = None
    surplus: Callable[[T.StructType, Column], Column] | None = None
    key: tuple[str, ...] = ()

    def __post_init__(self):
        if self.severity not in (CRITICAL, WARNING):
            raise ValueError(f"severity must be {CRITICAL} or {WARNING}, not {self.severity!r}")

    @property
    def is_keyed(self) -> bool:
        return self.surplus is not None


def _field(schema: T.StructType, name: str) -> T.StructField | None:
    """The field of that name: spelled alike, or else but for the case.

    Names that differ in case only stand side by side only where the session tells them apart,
    and there the spelling decides.
    """
    alike = [f for f in schema if f.name == name] or [f for f in schema if f.name.lower() == name.lower()]
    return alike[0] if alike else None


def _column(schema: T.StructType, name: str) -> Column:
    """The column or, if there is none of that name, the field of a struct it stands for."""
    if _field(schema, name) is not None:
        return F.col("`" + name.replace("`", "``") + "`")
    return F.col(name)


def _type_of(schema: T.StructType, name: str) -> T.DataType | None:
    """The type of the column that Spark would find for ``name``; None if it is not plain."""
    if (field := _field(schema, name)) is not None:
        return field.dataType
    head, _, rest = name.partition(".")
    inner = _type_of(schema, head) if rest else None
    return _type_of(inner, rest) if isinstance(inner, T.StructType) else None


def _outside(column: str, condition: Callable[[Column], Column]) -> Callable[[T.StructType], Column]:
    def violated(schema: T.StructType) -> Column:
        value = _column(schema, column)
        if isinstance(_type_of(schema, column), (T.DoubleType, T.FloatType)):
            return condition(value) | F.isnan(value)
        return condition(value)

    return violated


def _moment(as_of) -> Column:
    """``as_of`` to the microsecond; dates are compared with it as the moment they begin."""
    return F.current_timestamp() if as_of is None else F.lit(str(as_of)).cast("timestamp")


def not_null(column: str, severity: str = CRITICAL) -> Rule:
    return Rule("not_null", column, severity, violated=lambda s: _column(s, column).isNull())


def declared_not_null(column: str, severity: str = CRITICAL) -> Rule:
    """The null test that a ``nullable: false`` declaration implies."""
    return Rule("declared_not_null", column, severity, violated=lambda s: _column(s, column).isNull())


def accepted_values(column: str, values: Sequence, severity: str = CRITICAL) -> Rule:
    """Only ``values``; a null passes whether or not it is listed."""
    listed = [v for v in values if v is not None]

    def violated(schema):
        value = _column(schema, column)
        return ~value.isin(listed) if listed else value.isNotNull()

    return Rule("accepted_values", column, severity, violated=violated)


def value_between(column: str, low, high, severity: str = CRITICAL) -> Rule:
    outside = _outside(column, lambda value: ~value.between(low, high))
    return Rule("value_between", column, severity, violated=outside)


def value_above(column: str, minimum, severity: str = CRITICAL) -> Rule:
    """Strictly above ``minimum``."""
    outside = _outside(column, lambda value: value <= minimum)
    return Rule("value_above", column, severity, violated=outside)


def value_above_or_equal(column: str, minimum, severity: str = CRITICAL) -> Rule:
    outside = _outside(column, lambda value: value < minimum)
    return Rule("value_above_or_equal", column, severity, violated=outside)


def no_future(column: str, as_of=None, severity: str = WARNING, name: str = "no_future") -> Rule:
    """No timestamp after ``as_of``, which is the time of the query if not given."""
    return Rule(
        name, column, severity, violated=lambda s: _column(s, column).cast("timestamp") > _moment(as_of)
    )


def table_not_empty(severity: str = CRITICAL) -> Rule:
    return Rule("table_not_empty", None, severity, broken=lambda _, rows, __: rows < 1)


def row_count_above(minimum: int, severity: str = CRITICAL) -> Rule:
    """At least ``minimum`` rows."""
    return Rule("row_count_above", None, severity, broken=lambda _, rows, __: rows < minimum)


def freshness(column: str, hours: float, as_of=None, severity: str = CRITICAL) -> Rule:
    """The newest timestamp is at most ``hours`` older than ``as_of``."""

    def stale(schema, rows, tally):
        newest = F.max(_column(schema, column)).cast("timestamp")
        age = F.make_dt_interval(secs=F.lit(hours * 3600).cast("decimal(18, 6)"))
        return newest.isNull() | (newest < _moment(as_of) - age)

    return Rule("freshness", column, severity, broken=stale)


def availability(column: str, percent: float, severity: str = CRITICAL) -> Rule:
    """At least ``percent`` of the runs in a run log succeeded.

    The table is a log with one row per run and a boolean ``column``; a run whose
    outcome is null did not succeed.
    """

    def unavailable(schema, rows, tally):
        return (rows < 1) | (tally(_column(schema, column)) * 100 < rows * percent)

    return Rule("availability", column, severity, broken=unavailable)


def unique(column: str, severity: str = CRITICAL) -> Rule:
    """No value twice; nulls are not compared. Rows beyond the first copy fail."""
    return Rule(
        "unique",
        column,
        severity,
        key=(column,),
        surplus=lambda s, copies: F.when(_column(s, column).isNotNull(), copies - 1),
    )


def primary_key(*columns: str, severity: str = CRITICAL) -> Rule:
    """No null in the key and no key twice."""
    if not columns:
        raise ValueError("a primary key needs a column")

    def surplus(schema: T.StructType, copies: Column) -> Column:
        null = F.lit(False)
        for c in columns:
            null = null | _column(schema, c).isNull()
        return F.when(null, copies).otherwise(copies - 1)

    return Rule("primary_key", ", ".join(columns), severity, key=columns, surplus=surplus)


def no_duplicates(severity: str = CRITICAL) -> Rule:
    """No two rows equal in all columns. Rows beyond the first copy fail."""
    return Rule("no_duplicates", None, severity, surplus=lambda _, copies: copies - 1)
