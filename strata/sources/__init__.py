"""Reading raw sources and layer tables."""

from strata.sources.lines import accepted, read_lines, rejected
from strata.sources.readers import read_evolved, read_source, read_table

__all__ = ["accepted", "read_evolved", "read_lines", "read_source", "read_table", "rejected"]
