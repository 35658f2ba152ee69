"""Quality rules, their one-pass evaluation, and data contracts."""

from strata.quality.contracts import (
    Contract,
    check_table,
    load_contract,
    load_document,
    model_tests,
    schema_problems,
    schema_report,
)
from strata.quality.footers import evaluate_footers
from strata.quality.report import (
    REPORT_SCHEMA,
    ContractViolation,
    evaluate,
    observe,
    raise_on_failure,
    require,
)
from strata.quality.rules import (
    Rule,
    accepted_values,
    availability,
    declared_not_null,
    freshness,
    no_duplicates,
    no_future,
    not_null,
    primary_key,
    row_count_above,
    table_not_empty,
    unique,
    value_above,
    value_above_or_equal,
    value_between,
)

__all__ = [
    "REPORT_SCHEMA",
    "Contract",
    "ContractViolation",
    "Rule",
    "accepted_values",
    "availability",
    "check_table",
    "declared_not_null",
    "evaluate",
    "evaluate_footers",
    "freshness",
    "load_contract",
    "load_document",
    "model_tests",
    "no_duplicates",
    "no_future",
    "not_null",
    "observe",
    "primary_key",
    "raise_on_failure",
    "require",
    "row_count_above",
    "schema_problems",
    "schema_report",
    "table_not_empty",
    "unique",
    "value_above",
    "value_above_or_equal",
    "value_between",
]
