"""Column expressions shared by the operators and the SQL models."""

from strata.functions.averages import any_nan, average_of_units, exact_average, rounded_average, units_count, units_sum
from strata.functions.elapsed import elapsed, elapsed_sql, quoted

__all__ = [
    "any_nan",
    "average_of_units",
    "elapsed",
    "elapsed_sql",
    "exact_average",
    "quoted",
    "rounded_average",
    "units_count",
    "units_sum",
]
