"""Writing layer tables."""

from strata.sinks.batches import BATCH, append_batch, commit, committed
from strata.sinks.order import file_ranges, positions
from strata.sinks.writers import (
    Layout,
    SchemaConflict,
    added_columns,
    append_evolving,
    append_evolving_path,
    evolve,
    layout_of,
    merged_schema,
    refresh,
    refresh_path,
)

__all__ = [
    "BATCH",
    "Layout",
    "SchemaConflict",
    "added_columns",
    "append_batch",
    "append_evolving",
    "append_evolving_path",
    "commit",
    "committed",
    "evolve",
    "file_ranges",
    "layout_of",
    "merged_schema",
    "positions",
    "refresh",
    "refresh_path",
]
