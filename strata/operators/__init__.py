"""DataFrame operators; each takes its columns and bounds as arguments."""

from strata.operators.clean import (
    dedupe,
    drop_incomplete,
    drop_nulls,
    keep_after,
    keep_between,
    keep_positive,
    project,
    with_elapsed,
)
from strata.operators.summary import daily_parts, daily_summary, merged_days

__all__ = [
    "daily_parts",
    "daily_summary",
    "dedupe",
    "drop_incomplete",
    "drop_nulls",
    "keep_after",
    "keep_between",
    "keep_positive",
    "merged_days",
    "project",
    "with_elapsed",
]
