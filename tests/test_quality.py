"""Rules, report, observation and gate."""

from datetime import datetime

import pytest
from helpers import START, make, plan, trip
from pyspark.sql import functions as F

from strata import quality as Q
from strata.quality.report import REPORT_SCHEMA

NAN = float("nan")


def failing(df, rule):
    report = Q.evaluate(df, [rule], "t").collect()
    assert len(report) == 1
    row = report[0]
    assert row.table_name == "t" and row.rule == rule.name and row.severity == rule.severity
    assert row.column_name == rule.column
    assert row.total_rows == df.count()
    assert row.passed == (row.failing_rows == 0)
    return row.failing_rows


@pytest.fixture(scope="module")
def numbers(spark):
    rows = [(1, 1.0, "a"), (2, NAN, "a"), (3, None, None), (6, -1.0, "b"), (None, 0.0, None)]
    return spark.createDataFrame(rows, "n int, x double, s string")


@pytest.mark.parametrize(
    ("rule", "expected"),
    [
        (Q.not_null("n"), 1),
        (Q.not_null("s"), 2),
        (Q.declared_not_null("x"), 1),
        (Q.accepted_values("n", [1, 2, 3]), 1),
        (Q.accepted_values("s", ["a", "b"]), 0),
        (Q.value_between("n", 1, 6), 0),
        (Q.value_between("n", 2, 3), 2),
        (Q.value_between("x", -1, 1), 1),
        (Q.value_above("n", 0), 0),
        (Q.value_above("n", 1), 1),
        (Q.value_above("x", 0), 3),
        (Q.value_above_or_equal("x", 0), 2),
        (Q.value_above_or_equal("n", 1), 0),
        (Q.table_not_empty(), 0),
        (Q.row_count_above(5), 0),
        (Q.row_count_above(6), 1),
        (Q.unique("n"), 0),
        (Q.unique("s"), 1),
        (Q.primary_key("n"), 1),
        (Q.primary_key("s"), 3),
        (Q.primary_key("n", "x"), 2),
        (Q.no_duplicates(), 0),
    ],
    ids=lambda value: getattr(value, "name", value),
)
def test_rule(numbers, rule, expected):
    assert failing(numbers, rule) == expected


@pytest.mark.parametrize(
    ("rule", "expected"),
    [
        (Q.not_null("n"), 0),
        (Q.value_above("x", 0), 0),
        (Q.table_not_empty(), 1),
        (Q.row_count_above(1), 1),
        (Q.row_count_above(0), 0),
        (Q.unique("n"), 0),
        (Q.primary_key("n"), 0),
        (Q.no_duplicates(), 0),
    ],
    ids=lambda value: getattr(value, "name", value),
)
def test_rule_on_an_empty_table(numbers, rule, expected):
    assert failing(numbers.limit(0), rule) == expected


def test_rows_beyond_the_first_copy_are_duplicates(spark):
    rows = [(1, None), (1, None), (1, 0.0), (1, -0.0), (2, NAN), (2, NAN), (2, NAN)]
    df = spark.createDataFrame(rows, "n int, x double")
    assert failing(df, Q.no_duplicates()) == 4
    assert failing(df, Q.unique("x")) == 3


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_dates_are_compared_with_a_given_time(spark, kind):
    df = spark.createDataFrame(
        [("2024-01-10 00:00:00",), ("2024-01-20 12:00:00",), (None,)], "t string"
    ).select(F.col("t").cast(kind))
    assert failing(df, Q.no_future("t", "2024-01-15")) == 1
    assert failing(df, Q.no_future("t", datetime(2024, 1, 20, 12))) == 0
    assert failing(df, Q.freshness("t", 25, "2024-01-21 13:00:00")) == 0
    assert failing(df, Q.freshness("t", 25, "2024-01-21 13:00:01")) == 1
    assert failing(df.limit(0), Q.freshness("t", 25, "2024-01-21")) == 1
    assert failing(df.filter("t IS NULL"), Q.freshness("t", 25, "2024-01-21")) == 1


def test_without_a_time_dates_are_compared_with_now(spark):
    df = spark.sql("SELECT current_timestamp() + INTERVAL 1 DAY AS t UNION ALL SELECT TIMESTAMP '2020-01-01'")
    assert failing(df, Q.no_future("t")) == 1
    assert failing(df, Q.freshness("t", 25)) == 0


@pytest.mark.parametrize(
    ("outcomes", "expected"),
    [
        ([True] * 99 + [False], 0),
        ([True] * 98 + [False] * 2, 1),
        ([True] * 98 + [False, None], 1),
        ([None], 1),
        ([], 1),
    ],
)
def test_availability_is_the_share_of_successful_runs(spark, outcomes, expected):
    log = spark.createDataFrame(
        [("silver", START, ok) for ok in outcomes], "layer string, run_at timestamp, ok boolean"
    )
    assert failing(log, Q.availability("ok", 99)) == expected


ALL_RULES = [
    Q.not_null("fare_amount"),
    Q.value_above("fare_amount", 0, "warning"),
    Q.no_duplicates(),
    Q.unique("dispatcher", "warning"),
    Q.primary_key("tpep_pickup_datetime", severity="warning"),
    Q.row_count_above(2),
    Q.freshness("tpep_pickup_datetime", 1, "2031-05-06 22:40:11"),
]


def by_rule(report):
    return {(r.rule, r.column_name): (r.total_rows, r.failing_rows) for r in report.collect()}


def test_rules_evaluated_together_count_as_alone(spark):
    df = make(spark, trip(), trip(), trip(), trip(fare_amount=None), trip(fare_amount=-1.0))
    together = by_rule(Q.evaluate(df, ALL_RULES))
    alone = {}
    for rule in ALL_RULES:
        alone |= by_rule(Q.evaluate(df, [rule]))
    assert together == alone
    assert together["not_null", "fare_amount"] == (5, 1)
    assert together["value_above", "fare_amount"] == (5, 1)
    assert together["no_duplicates", None] == (5, 2)
    assert together["unique", "dispatcher"] == (5, 4)


def test_report_schema_and_no_rules(numbers):
    assert [f.name for f in Q.evaluate(numbers, [Q.not_null("n")]).schema] == REPORT_SCHEMA.names
    empty = Q.evaluate(numbers, [])
    assert empty.schema == REPORT_SCHEMA and empty.count() == 0


def test_observed_counters_equal_evaluated_ones(spark, numbers):
    rules = [Q.not_null("n"), Q.value_above("x", 0), Q.row_count_above(9), Q.accepted_values("n", [1])]
    passing, observed = Q.observe(numbers.repartition(3), rules, "t")
    passing.write.format("noop").mode("overwrite").save()
    assert sorted(observed.report(spark).collect()) == sorted(Q.evaluate(numbers, rules, "t").collect())


def test_key_rules_cannot_be_observed(numbers):
    with pytest.raises(ValueError, match="key rules"):
        Q.observe(numbers, [Q.no_duplicates()])


def test_gate_stops_on_critical_rules_only(numbers):
    warned = Q.evaluate(numbers, [Q.not_null("n", "warning"), Q.table_not_empty()], "numbers")
    assert sorted(r.passed for r in Q.require(warned).collect()) == [False, True]
    with pytest.raises(Q.ContractViolation, match=r"numbers: not_null\(n\) fails for 1 of 5"):
        Q.require(Q.evaluate(numbers, [Q.not_null("n")], "numbers"))


def test_unknown_severity_is_refused():
    with pytest.raises(ValueError, match="severity"):
        Q.not_null("n", "fatal")


def test_row_rules_share_one_scan(numbers, spark):
    stored = spark.conf.get("spark.checkpoint.dir") + "/numbers"
    numbers.write.mode("overwrite").parquet(stored)
    df = spark.read.parquet(stored)
    rows_only = Q.evaluate(df, [Q.not_null("n"), Q.value_above("n", 0), Q.table_not_empty()])
    assert plan(rows_only).count("FileScan") == 1
    assert "ReadSchema: struct<n:int>" in plan(rows_only)
    with_copies = Q.evaluate(df, [Q.not_null("n"), Q.value_above("x", 0), Q.no_duplicates()])
    assert plan(with_copies).count("FileScan") == 1
    same_key = Q.evaluate(df, [Q.unique("n"), Q.primary_key("n")])
    assert plan(same_key).count("FileScan") == 1


def test_a_null_among_accepted_values_accepts_nothing_more(spark):
    df = spark.createDataFrame([(7,), (1,), (None,)], "n int")
    assert failing(df, Q.accepted_values("n", [1, None])) == 1
    assert failing(df, Q.accepted_values("n", [None])) == 2


@pytest.mark.parametrize(("hours", "as_of", "stale"), [(27, "2031-02-04 02:59:59", 0), (27, "2031-02-04 03:00:01", 1), (0.5, "2031-02-03 00:30:00", 0), (0.5, "2031-02-03 00:30:01", 1)])
def test_freshness_of_a_date_counts_from_its_midnight(spark, hours, as_of, stale):
    days = spark.sql("SELECT DATE '2031-02-03' AS d, TIMESTAMP '2031-02-03' AS t, TIMESTAMP_NTZ '2031-02-03' AS n")
    assert [failing(days, Q.freshness(c, hours, as_of)) for c in "dtn"] == [stale] * 3


def test_rules_find_columns_whatever_their_name(spark):
    df = spark.sql("SELECT double('NaN') AS `a.b`, named_struct('x', double('NaN')) AS s, 5 AS Total")
    for column in ("a.b", "s.x", "S.X", "A.B"):
        assert failing(df, Q.value_between(column, 0, 1)) == 1
        assert failing(df, Q.not_null(column)) == 0
    assert failing(df, Q.value_above("total", 5)) == 1


def test_row_rules_ride_on_a_single_key(spark, tmp_path):
    spark.range(100).selectExpr("id % 40 AS k", "id AS v", "timestamp_seconds(id) AS at").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    rules = [Q.unique("k"), Q.not_null("k"), Q.value_above("v", 9), Q.row_count_above(101), Q.freshness("k_at", 1, "2031-01-01")]
    report = Q.evaluate(df.withColumnRenamed("at", "k_at"), rules[:4])
    assert plan(report).count("FileScan") == 1
    assert {r.rule: (r.total_rows, r.failing_rows) for r in report.collect()} == {
        "unique": (100, 60), "not_null": (100, 0), "value_above": (100, 10), "row_count_above": (100, 1)
    }
    both = Q.evaluate(df.withColumnRenamed("at", "k_at"), rules)
    assert plan(both).count("FileScan") == 2  # the newest time is not in the key


@pytest.mark.parametrize("name", ["ID", "s.X"])
def test_nan_is_found_under_names_that_differ_in_case(spark, name):
    own = spark.newSession()
    own.conf.set("spark.sql.caseSensitive", "true")
    df = own.sql("SELECT 1 AS id, double('NaN') AS ID, named_struct('x', 1, 'X', double('NaN')) AS s")
    for rule in (Q.value_above(name, 0), Q.value_above_or_equal(name, 0), Q.value_between(name, 0, 5)):
        assert [r.failing_rows for r in Q.evaluate(df, [rule]).collect()] == [1]
    plain = spark.sql("SELECT double('NaN') AS Fare")
    assert Q.evaluate(plain, [Q.value_above("fare", 0)]).first().failing_rows == 1
