"""Contract documents: parsing, schema conformance, and the three taxi contracts."""

import json

import pytest
from helpers import full_width, make, trip
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.plans import aggregate, clean, clean_model, taxi
from strata.quality import (
    Contract,
    ContractViolation,
    evaluate,
    load_contract,
    load_document,
    model_tests,
    require,
    schema_problems,
)

DOCUMENT = {
    "metadata": {"name": "things", "layer": "silver"},
    "servers": {"dev": {"table": "things"}},
    "schema": [
        {"name": "id", "type": "long", "nullable": False, "primary_key": True},
        {"name": "label", "type": "string"},
        {"name": "seen", "type": "timestamp"},
        {"name": "open", "type": "boolean", "description": "still open"},
    ],
    "quality": [
        {"rule": "not_null", "columns": ["label", "seen"], "severity": "warning"},
        {"rule": "accepted_values", "column": "label", "values": ["a", "b"]},
    ],
    "sla": {"freshness_hours": 25, "availability_percent": 99},
    "tags": ["x"],
}


def test_document_becomes_schema_and_rules():
    contract = Contract.parse(DOCUMENT)
    assert contract.name == "things"
    assert contract.tags == ("x",)
    assert contract.servers["dev"]["table"] == "things"
    assert contract.schema() == T.StructType(
        [
            T.StructField("id", T.LongType(), False),
            T.StructField("label", T.StringType()),
            T.StructField("seen", T.TimestampType()),
            T.StructField("open", T.BooleanType()),
        ]
    )
    rules = contract.rules(as_of="2024-01-01", fresh="seen")
    assert [(r.name, r.column, r.severity) for r in rules] == [
        ("not_null", "label", "warning"),
        ("not_null", "seen", "warning"),
        ("accepted_values", "label", "critical"),
        ("declared_not_null", "id", "critical"),
        ("primary_key", "id", "critical"),
        ("freshness", "seen", "critical"),
    ]
    assert "freshness" not in {r.name for r in contract.rules()}
    assert contract.availability_rule("ok").name == "availability"


def test_rules_of_a_document_run(spark):
    df = spark.sql(
        """SELECT * FROM VALUES (1L, 'a', TIMESTAMP '2024-01-01', true), (1L, 'z', null, false),
           (null, null, null, null) AS t(id, label, seen, open)"""
    )
    report = evaluate(df, Contract.parse(DOCUMENT).rules(as_of="2024-01-02 01:00:00", fresh="seen"))
    assert {(r.rule, r.column_name): r.failing_rows for r in report.collect()} == {
        ("not_null", "label"): 1,
        ("not_null", "seen"): 2,
        ("accepted_values", "label"): 1,
        ("declared_not_null", "id"): 1,
        ("primary_key", "id"): 2,
        ("freshness", "seen"): 0,
    }


@pytest.mark.parametrize(
    "change",
    [
        {"schema": [{"name": "id", "type": "uuid"}]},
        {"quality": [{"rule": "looks_nice", "column": "id"}]},
    ],
)
def test_unknown_types_and_rules_are_refused(change):
    with pytest.raises(ValueError, match="unknown in contract"):
        Contract.parse({**DOCUMENT, **change})


def test_availability_needs_a_target():
    with pytest.raises(ValueError, match="no availability target"):
        Contract.parse({**DOCUMENT, "sla": {}}).availability_rule("ok")


def test_contract_can_be_yaml_or_json(tmp_path):
    yaml = pytest.importorskip("yaml")
    (tmp_path / "c.json").write_text(json.dumps(DOCUMENT))
    (tmp_path / "c.yml").write_text(yaml.safe_dump(DOCUMENT))
    assert load_contract(tmp_path / "c.json") == load_contract(tmp_path / "c.yml")


def test_schema_problems(spark):
    contract = Contract.parse(DOCUMENT)
    good = spark.createDataFrame([], "id long, label string, seen timestamp, open boolean, more int")
    assert schema_problems(good, contract) == []
    local = good.withColumn("seen", F.col("seen").cast("timestamp_ntz"))
    assert schema_problems(local, contract) == []
    bad = spark.createDataFrame([], "id int, label string, seen date")
    assert schema_problems(bad, contract) == [
        "id: int, declared long",
        "seen: date, declared timestamp",
        "open: missing",
    ]


@pytest.mark.parametrize(
    ("name", "columns", "rules"), [("trips_bronze", 11, 2), ("trips_silver", 12, 15), ("daily_gold", 6, 18)]
)
def test_taxi_contracts_load(name, columns, rules):
    contract = taxi.contract(name)
    assert contract.name == name
    assert len(contract.fields) == columns
    assert len(contract.rules()) == rules
    assert contract.freshness_hours in (25, 26, 27)
    assert contract.availability_percent == 99


def test_layers_conform_to_their_contracts(spark):
    bronze = full_width(make(spark, trip(), trip(fare_amount=-2.0), trip()))
    silver = clean(bronze)
    assert schema_problems(bronze, taxi.contract("trips_bronze")) == []
    assert schema_problems(silver, taxi.contract("trips_silver")) == []
    assert schema_problems(aggregate(silver), taxi.contract("daily_gold")) == []
    require(evaluate(bronze, taxi.contract("trips_bronze").rules(as_of="2023-02-01"), "bronze"))
    require(evaluate(silver, taxi.contract("trips_silver").rules(), "silver"))
    require(evaluate(aggregate(silver), taxi.contract("daily_gold").rules(), "gold"))


def test_zero_durations_of_the_sql_path_break_the_silver_contract(spark):
    start = trip()["tpep_pickup_datetime"]
    bronze = full_width(make(spark, trip(), trip(tpep_dropoff_datetime=start.replace(microsecond=400000))))
    silver = spark.sql(clean_model("{b}"), b=bronze)
    with pytest.raises(ContractViolation, match="value_above.trip_duration_minutes. fails for 1 of 2"):
        require(evaluate(silver, taxi.contract("trips_silver").rules(), "silver"))


MODELS = """
version: 2
models:
  - name: riders
    columns:
      - name: id
        description: Key.
        tests: [not_null, unique]
      - name: seats
        tests:
          - not_null: {severity: warn}
          - accepted_values: {values: [1, 2]}
      - name: note
  - name: empty
"""


def test_column_tests_of_models_become_rules(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "models.yml").write_text(MODELS)
    tests = model_tests(load_document(tmp_path / "models.yml"))
    assert tests["empty"] == []
    assert [(r.name, r.column, r.severity) for r in tests["riders"]] == [
        ("not_null", "id", "critical"),
        ("unique", "id", "critical"),
        ("not_null", "seats", "warning"),
        ("accepted_values", "seats", "critical"),
    ]
    df = spark.sql("SELECT * FROM VALUES (1, 1), (1, 3), (null, null) AS t(id, seats)")
    report = evaluate(df, tests["riders"], "riders").collect()
    assert {(r.rule, r.column_name): r.failing_rows for r in report} == {
        ("not_null", "id"): 1,
        ("unique", "id"): 1,
        ("not_null", "seats"): 1,
        ("accepted_values", "seats"): 1,
    }


def test_unknown_column_test_is_refused():
    document = {"models": [{"name": "m", "columns": [{"name": "c", "tests": ["relationships"]}]}]}
    with pytest.raises(ValueError, match="unknown test of m: relationships"):
        model_tests(document)


@pytest.mark.parametrize(
    "rule",
    [{"rule": "unique"}, {"rule": "unique", "columns": ["a", "b"]}, {"rule": "value_between", "column": "a", "min": 1}, {"rule": "not_null"}],
)
def test_rules_with_wrong_arguments_are_refused_when_parsed(rule):
    document = {"metadata": {"name": "n"}, "schema": [{"name": "a", "type": "long"}], "quality": [rule]}
    with pytest.raises(ValueError, match=rule["rule"]):
        Contract.parse(document)


def test_declared_names_are_compared_as_the_session_does(spark):
    declared = Contract.parse({"metadata": {"name": "t"}, "schema": [{"name": "Fare", "type": "double"}]})
    own = spark.newSession()
    own.conf.set("spark.sql.caseSensitive", "true")
    assert schema_problems(spark.sql("SELECT 1D AS fare"), declared) == []
    assert schema_problems(own.sql("SELECT 1D AS fare"), declared) == ["Fare: missing"]
    assert schema_problems(own.sql("SELECT 1D AS Fare, 'x' AS fare"), declared) == []
    assert schema_problems(spark.sql("SELECT 'x' AS FARE"), declared) == ["Fare: string, declared double"]
