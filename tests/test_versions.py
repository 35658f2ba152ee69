"""Refreshes by version, widening by catalog call, and batches that append once."""

import uuid

import pytest
from pyspark.sql import functions as F

from strata.sinks import Layout, SchemaConflict, append_batch, append_evolving, committed, layout_of, refresh, versions, writers


@pytest.fixture
def table(spark):
    schema = f"v{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE SCHEMA {schema}")
    yield f"spark_catalog.{schema}.trips"
    spark.sql(f"DROP SCHEMA {schema} CASCADE")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n int")


class Dies(Exception):
    """The driver is lost here."""


def dying(*_, **__):
    raise Dies


def test_a_reader_that_has_begun_keeps_its_rows(spark, table):
    refresh(numbers(spark, 1, 2), table)
    begun = spark.read.table(table)
    refresh(numbers(spark, 3).withColumn("more", F.lit("x")), table)
    assert rows(begun) == [(1,), (2,)]
    assert rows(spark.read.table(table)) == [(3, "x")]


def test_old_versions_go_once_newer_ones_are_there(spark, table):
    for n in range(5):
        refresh(numbers(spark, n), table)
        assert rows(spark.read.table(table)) == [(n,)]
    assert len(versions.versions(spark, table)) == 1 + versions.KEPT
    assert versions.current(spark, table) in versions.versions(spark, table)[5]


def test_a_failed_refresh_leaves_the_old_rows(spark, table):
    refresh(numbers(spark, 1), table)
    with pytest.raises(Exception, match="broken"):
        refresh(numbers(spark, 2).select(F.when(F.col("n") == 2, F.raise_error(F.lit("broken"))).cast("int").alias("n")), table)
    assert rows(spark.read.table(table)) == [(1,)]
    refresh(numbers(spark, 3), table)
    assert rows(spark.read.table(table)) == [(3,)]


@pytest.mark.parametrize("step", ["adopt", "publish"])
def test_a_refresh_that_dies_between_steps_leaves_the_old_rows(spark, table, step, monkeypatch):
    refresh(numbers(spark, 1), table)
    with monkeypatch.context() as lost:
        lost.setattr(versions, step, dying)
        with pytest.raises(Dies):
            refresh(numbers(spark, 2), table)
    assert rows(spark.read.table(table)) == [(1,)]
    refresh(numbers(spark, 3), table)
    assert rows(spark.read.table(table)) == [(3,)]


def test_a_plain_table_is_taken_over(spark, table, monkeypatch):
    numbers(spark, 1).write.saveAsTable(table)
    calls = []
    with monkeypatch.context() as lost:
        lost.setattr(versions, "recover", lambda *_: dying() if calls else calls.append(1))
        with pytest.raises(Dies):
            refresh(numbers(spark, 2), table)
    assert not spark.catalog.tableExists(table)  # lost between the two catalog calls
    with pytest.raises(Exception, match="broken"):
        refresh(numbers(spark, 2).select(F.raise_error(F.lit("broken")).cast("int").alias("n")), table)
    assert rows(spark.read.table(table)) == [(1,)]
    refresh(numbers(spark, 3), table)
    assert rows(spark.read.table(table)) == [(3,)]


def test_a_plain_table_with_partitions_is_overwritten(spark, table):
    Layout(("n",)).apply(numbers(spark, 1).withColumn("x", F.lit(5)).write).saveAsTable(table)
    refresh(numbers(spark, 2).withColumn("x", F.lit(6)), table)
    assert rows(spark.read.table(table)) == [(6, 2)]
    assert layout_of(spark, table) == Layout(("n",))


def test_comment_and_properties_of_the_name_stay(spark, table):
    refresh(numbers(spark, 1), table)
    spark.sql(f"ALTER VIEW {table} SET TBLPROPERTIES ('team' = 'me')")
    refresh(numbers(spark, 2), table)
    assert ("team", "me") in rows(spark.sql(f"SHOW TBLPROPERTIES {table}"))


def test_views_of_something_else_are_refused(spark, table):
    spark.sql(f"CREATE VIEW {table} AS SELECT 1 AS n")
    with pytest.raises(ValueError, match="something else"):
        refresh(numbers(spark, 1), table)


def test_drop_takes_all_versions(spark, table):
    for n in range(3):
        refresh(numbers(spark, n), table)
    versions.drop(spark, table)
    assert not spark.catalog.tableExists(table) and not versions.versions(spark, table)


@pytest.mark.parametrize("format", ["parquet", "orc", "json"])
def test_widening_rewrites_no_file_and_keeps_properties(spark, table, format):
    first = spark.sql("SELECT 1 AS id, named_struct('a', 1) AS s, array(named_struct('p', 1)) AS l, map('k', named_struct('q', 1)) AS m, 'x' AS part")
    append_evolving(first, table, format, Layout(("part",)))
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('team' = 'me')")
    files = spark.read.table(table).inputFiles()
    second = spark.sql(
        "SELECT 2 AS id, named_struct('a', 2, 'b', 'n') AS s, array(named_struct('p', 2, 'r', 3)) AS l,"
        " map('k', named_struct('q', 2, 't', 4)) AS m, 5 AS new, 'x' AS part"
    )
    append_evolving(second, table, format)
    assert set(files) < set(spark.read.table(table).inputFiles())
    assert {("team", "me")} <= set(rows(spark.sql(f"SHOW TBLPROPERTIES {table}")))
    got = spark.read.table(table).selectExpr("id", "s.a", "s.b", "l[0].p", "l[0].r", "m['k'].q", "m['k'].t", "new", "part")
    assert rows(got) == [(1, 1, None, 1, None, 1, None, None, "x"), (2, 2, "n", 2, 3, 2, 4, 5, "x")]
    assert rows(spark.read.table(table).filter("s.b IS NULL AND s IS NOT NULL").select("id")) == [(1,)]


@pytest.mark.parametrize("step", ["evolve", "_set_columns", "insertInto"])
def test_an_append_that_dies_between_steps_keeps_all_rows(spark, table, step, monkeypatch):
    append_evolving(spark.sql("SELECT id, named_struct('a', id) AS s FROM range(5)"), table)
    batch = spark.sql("SELECT id, named_struct('a', id, 'b', 'n') AS s FROM range(3)")
    with monkeypatch.context() as lost:
        if step == "insertInto":
            lost.setattr(type(batch.write), step, dying)
        else:
            lost.setattr(writers, step, dying)
        with pytest.raises(Dies):
            append_evolving(batch, table)
    assert spark.read.table(table).count() == 5
    append_evolving(batch, table)
    assert rows(spark.read.table(table).groupBy("s.b").count()) == [("n", 3), (None, 5)]


def test_batches_append_once(spark, table):
    assert append_batch(numbers(spark, 1, 2), table, "b1")
    assert not append_batch(numbers(spark, 1, 2), table, "b1")
    assert append_batch(numbers(spark, 1, 2).withColumn("extra", F.lit("e")), table, "b2")
    assert append_batch(numbers(spark), table, "empty")
    assert committed(spark, table) == ["b1", "b2", "empty"]
    assert rows(spark.read.table(table)) == [(1, "e", "b2"), (1, None, "b1"), (2, "e", "b2"), (2, None, "b1")]


def test_a_batch_that_died_is_written_over(spark, table):
    append_batch(numbers(spark, 1), table, "b1")
    append_batch(numbers(spark, 7, 8), table, "b2", done=False)
    append_batch(numbers(spark, 2), table, "b2")
    assert rows(spark.read.table(table)) == [(1, "b1"), (2, "b2")]


def test_files_that_a_dead_batch_left_unlisted_go(spark, table):
    append_batch(numbers(spark, 1), table, "b1")
    place = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Location'").first().data_type
    numbers(spark, 9).write.parquet(f"{place}/ingest_batch=b2")
    assert rows(spark.read.table(table)) == [(1, "b1")]
    append_batch(numbers(spark, 2), table, "b2")
    assert rows(spark.read.table(table)) == [(1, "b1"), (2, "b2")]


def test_batches_are_refused_where_they_cannot_be_told_apart(spark, table):
    with pytest.raises(ValueError, match="batch id"):
        append_batch(numbers(spark, 1), table, "a/b")
    with pytest.raises(SchemaConflict, match="tells batches apart"):
        append_batch(numbers(spark, 1).withColumn("Ingest_Batch", F.lit(1)), table, "b")
    append_evolving(numbers(spark, 1), table)
    with pytest.raises(SchemaConflict, match="not divided"):
        append_batch(numbers(spark, 1), table, "b")
