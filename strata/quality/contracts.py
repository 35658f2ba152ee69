"""Data contracts: a table's columns, rules and targets in one document."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from strata.quality import rules as R
from strata.quality.report import REPORT_SCHEMA, ContractViolation, evaluate
from strata.session import sized_session

# The column types a contract can declare. Either kind of timestamp
# satisfies ``timestamp``.
TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "integer": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "boolean": T.BooleanType(),
}

# The rule names a contract can use.
RULES: dict[str, Callable[[dict, str, object], R.Rule]] = {
    "not_null": lambda r, s, _: R.not_null(r["column"], s),
    "unique": lambda r, s, _: R.unique(r["column"], s),
    "accepted_values": lambda r, s, _: R.accepted_values(r["column"], r["values"], s),
    "value_between": lambda r, s, _: R.value_between(r["column"], r["min"], r["max"], s),
    "value_above": lambda r, s, _: R.value_above(r["column"], r["min"], s),
    "value_above_or_equal": lambda r, s, _: R.value_above_or_equal(r["column"], r["min"], s),
    "table_not_empty": lambda r, s, _: R.table_not_empty(s),
    "row_count_above": lambda r, s, _: R.row_count_above(r["min"], s),
    "no_future_pickup_dates": lambda r, s, as_of: R.no_future(r["column"], as_of, s, r["rule"]),
    "no_duplicates": lambda r, s, _: R.no_duplicates(s),
}

# The rules that name no column.
TABLE_RULES = ("table_not_empty", "row_count_above", "no_duplicates")

# The tests a model's column can have.
COLUMN_TESTS = ("not_null", "unique", "accepted_values")


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    nullable: bool = True
    primary_key: bool = False
    description: str = ""


@dataclass(frozen=True)
class Contract:
    """A parsed contract. Build it with :func:`load_contract` or ``Contract.parse``."""

    metadata: Mapping
    fields: tuple[Field, ...]
    quality: tuple[Mapping, ...] = ()
    servers: Mapping = field(default_factory=dict)
    freshness_hours: int | None = None
    availability_percent: float | None = None
    tags: tuple[str, ...] = ()

    @classmethod
    def parse(cls, document: Mapping) -> Contract:
        fields = tuple(
            Field(
                name=f["name"],
                type=f["type"],
                nullable=f.get("nullable", True),
                primary_key=f.get("primary_key", False),
                description=f.get("description", ""),
            )
            for f in document["schema"]
        )
        unknown = [f.type for f in fields if f.type not in TYPES]
        unknown += [r["rule"] for r in document.get("quality", ()) if r["rule"] not in RULES]
        if unknown:
            raise ValueError(f"unknown in contract: {', '.join(unknown)}")
        sla = document.get("sla", {})
        parsed = cls(
            metadata=document.get("metadata", {}),
            fields=fields,
            quality=tuple(document.get("quality", ())),
            servers=document.get("servers", {}),
            freshness_hours=sla.get("freshness_hours"),
            availability_percent=sla.get("availability_percent"),
            tags=tuple(document.get("tags", ())),
        )
        parsed.rules()  # a rule with missing or odd arguments is an error here, not when it runs
        return parsed

    @property
    def name(self) -> str:
        return self.metadata["name"]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, TYPES[f.type], f.nullable) for f in self.fields])

    def rules(self, as_of=None, fresh: str | None = None) -> list[R.Rule]:
        """The quality rules, then those the schema and the targets imply.

        ``as_of`` is the time that dates are compared with. Freshness is checked
        on the timestamp column ``fresh``; the document does not name one.
        """
        rules = []
        for entry in self.quality:
            severity = entry.get("severity", R.CRITICAL)
            columns = entry.get("columns") or [entry.get("column")]
            if entry["rule"] == "unique" and len(columns) > 1:
                raise ValueError("unique takes one column; declare several as primary_key")
            if entry["rule"] not in TABLE_RULES and None in columns:
                raise ValueError(f"{entry['rule']} needs a column")
            for column in columns:
                try:
                    rules.append(RULES[entry["rule"]]({**entry, "column": column}, severity, as_of))
                except KeyError as missing:
                    raise ValueError(f"{entry['rule']} needs {missing.args[0]}") from missing
        rules += [R.declared_not_null(f.name) for f in self.fields if not f.nullable]
        keys = [f.name for f in self.fields if f.primary_key]
        if keys:
            rules.append(R.primary_key(*keys))
        if fresh is not None and self.freshness_hours is not None:
            rules.append(R.freshness(fresh, self.freshness_hours, as_of))
        return rules

    def availability_rule(self, column: str) -> R.Rule:
        """The availability target, for a run log with outcome ``column``."""
        if self.availability_percent is None:
            raise ValueError(f"{self.name} declares no availability target")
        return R.availability(column, self.availability_percent)


def load_document(path: str | Path) -> dict:
    """Read a YAML or JSON file on the driver."""
    text = Path(path).read_text(encoding="utf-8")
    if Path(path).suffix == ".json":
        return json.loads(text)
    try:
        import yaml
    except ImportError as error:
        raise ImportError("reading YAML needs PyYAML; JSON works without") from error
    return yaml.safe_load(text)


def load_contract(path: str | Path) -> Contract:
    """Read a contract from a YAML or JSON file."""
    return Contract.parse(load_document(path))


def model_tests(document: Mapping) -> dict[str, list[R.Rule]]:
    """Column tests by model, from a document that lists ``models`` and their ``columns``.

    A test is a name (``not_null``, ``unique``) or a name with arguments
    (``accepted_values: {values: [...]}``); its severity is ``error`` unless it says
    ``warn``.
    """
    tests: dict[str, list[R.Rule]] = {}
    for model in document.get("models", ()):
        rules = tests.setdefault(model["name"], [])
        for column in model.get("columns", ()):
            for test in column.get("tests") or column.get("data_tests") or ():
                name, arguments = (test, {}) if isinstance(test, str) else next(iter(test.items()))
                arguments = arguments or {}
                if name not in COLUMN_TESTS:
                    raise ValueError(f"unknown test of {model['name']}: {name}")
                level = arguments.get("severity", arguments.get("config", {}).get("severity"))
                severity = R.WARNING if level == "warn" else R.CRITICAL
                rules.append(RULES[name]({**arguments, "column": column["name"]}, severity, None))
    return tests


def schema_problems(df: DataFrame, contract: Contract) -> list[str]:
    """Declared columns that ``df`` lacks or types differently. Runs no job.

    Names are compared as the session compares them. Nullability is not compared here: Spark marks most computed columns nullable
    whatever they hold, so it is a rule on the data.
    """
    sensitive = df.sparkSession.conf.get("spark.sql.caseSensitive", "false").lower() == "true"
    fold = str if sensitive else str.lower
    actual = {fold(f.name): f.dataType for f in df.schema}
    problems = []
    for f in contract.fields:
        kind = actual.get(fold(f.name))
        if kind is None:
            problems.append(f"{f.name}: missing")
            continue
        allowed = {TYPES[f.type]}
        if f.type == "timestamp":
            allowed.add(T.TimestampNTZType())
        if kind not in allowed:
            problems.append(f"{f.name}: {kind.simpleString()}, declared {f.type}")
    return problems


def schema_report(df: DataFrame, contract: Contract, table: str = "") -> DataFrame:
    """One line for each declared column: whether ``df`` has it with its type. Runs no job."""
    wrong = {problem.partition(":")[0] for problem in schema_problems(df, contract)}
    lines = [(table, "schema", f.name, R.CRITICAL, None, int(f.name in wrong), f.name not in wrong) for f in contract.fields]
    return df.sparkSession.createDataFrame(lines, REPORT_SCHEMA)


def check_table(
    spark: SparkSession, table: str, contract: Contract, as_of=None, fresh: str | None = None
) -> DataFrame:
    """Report of a stored table against its contract.

    Raises :class:`strata.quality.ContractViolation` at once if the columns do not
    conform. Pass the report to :func:`strata.quality.require` to enforce the rules. The
    report runs in a session sized for the table, as a duplicate rule shuffles whole rows.
    """
    df = spark.read.table(table)
    problems = schema_problems(df, contract)
    if problems:
        raise ContractViolation(f"{table}: {'; '.join(problems)}")
    rules = contract.rules(as_of, fresh)
    own = sized_session(df, shuffles=any(rule.is_keyed for rule in rules))
    return evaluate(own.read.table(table), rules, table.split(".")[-1])
