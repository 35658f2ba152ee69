"""Text lines with rejects, and the order in which tables are stored."""

import uuid

import pytest
from pyspark.sql import functions as F

from strata.session import scratch_path
from strata.sinks import append_evolving, file_ranges, positions, refresh
from strata.sources import accepted, read_lines, rejected

SCHEMA = "id int, fare double, day date"


def lines_of(spark, format, *texts, **options):
    path = scratch_path(spark, "lines")
    spark.createDataFrame([(t,) for t in texts], "value string").write.text(path)
    return read_lines(spark, path, SCHEMA, format=format, **options)


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("format", ["csv", "json"])
def test_good_and_rejected_lines_are_parted(spark, format):
    good = {"csv": ['1,2.5,2024-01-01', '2,,2024-01-02', '3,"4.5",2024-01-03'], "json": ['{"id":1,"fare":2.5,"day":"2024-01-01"}', '{"id":2,"day":"2024-01-02"}', '{"id":3,"fare":4.5,"day":"2024-01-03","more":1}']}
    bad = {"csv": ["x,1.0,2024-01-01", "4", "5,1.0", "6,1.0,2024-01-01,extra", "7,1.0,soon"], "json": ['{"id":"x"}', '{"id":4', "not json", '{"id":7,"day":"soon"}', "[1"]}
    lines = lines_of(spark, format, *good[format], *bad[format], "", "  ")
    assert rows(accepted(lines)) == [("1", "2.5", "2024-01-01"), ("2", "None", "2024-01-02"), ("3", "4.5", "2024-01-03")]
    assert sorted(r.line for r in rejected(lines).collect()) == sorted(bad[format])
    assert all("lines-" in r.file for r in rejected(lines).collect())


@pytest.mark.parametrize("format", ["csv", "json"])
def test_lines_are_judged_whole_whichever_columns_are_read(spark, format):
    texts = {"csv": ["1,bad,2024-01-01", "2,1.0,2024-01-01"], "json": ['{"id":1,"fare":"bad"}', '{"id":2,"fare":1.0}']}[format]
    lines = lines_of(spark, format, *texts)
    assert accepted(lines).select("id").collect() == [(2,)]
    assert accepted(lines).count() == 1 and rejected(lines).count() == 1


def test_headers_options_and_names(spark):
    lines = lines_of(spark, "csv", "id;fare;day", "1;2.5;2024-01-01", header="id;fare;day", options={"sep": ";"})
    assert rows(accepted(lines)) == [("1", "2.5", "2024-01-01")] and rejected(lines).count() == 0
    assert accepted(lines_of(spark, "csv")).count() == 0
    with pytest.raises(ValueError, match="csv or json"):
        read_lines(spark, "x", SCHEMA, format="xml")
    with pytest.raises(ValueError, match="_rejected"):
        read_lines(spark, "x", "_rejected string")


@pytest.fixture
def table(spark):
    schema = f"o{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE SCHEMA {schema}")
    yield f"{schema}.days"
    spark.sql(f"DROP SCHEMA {schema} CASCADE")


def test_a_sorted_refresh_is_stored_in_order(spark, table):
    days = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("day")).repartitionByRange(4, "day").sortWithinPartitions("day")
    refresh(days, table)
    ranges = file_ranges(spark, table, "day").collect()
    assert len(ranges) == 4 and all(r.in_order for r in ranges) and sum(r.rows for r in ranges) == 5000
    stored = positions(spark, table).orderBy("position").collect()
    assert [r.position for r in stored] == list(range(1, 5001))
    assert [r.day for r in stored] == sorted(r.day for r in stored)


def test_rows_out_of_order_are_told(spark, table):
    append_evolving(spark.createDataFrame([(1,), (3,), (2,)], "day int").coalesce(1), table)
    assert [r.in_order for r in file_ranges(spark, table, "day").collect()] == [False]
    refresh(spark.createDataFrame([(5,), (1,)], "day int").repartitionByRange(2, F.desc("day")), table)
    assert sorted(r.in_order for r in file_ranges(spark, table, "day").collect()) == [False, True]
