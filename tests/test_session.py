"""Settings, shuffle sizing and the shared folder."""

import os

import pytest

from strata.session import (
    SETTINGS,
    _bytes,
    discard,
    input_bytes,
    scratch_path,
    sized_session,
    task_sizes,
)

GIB = 2**30
TIB = 2**40


def test_settings_are_applied(spark):
    for key, value in SETTINGS.items():
        assert spark.conf.get(key) == value


@pytest.mark.parametrize(
    ("total", "split", "partitions"),
    [
        (0, GIB // 8, 0),
        (GIB, GIB // 8, 4),
        (TIB, GIB // 8, 4096),
        (100 * TIB, -(-100 * TIB // 100_000), 50_000),
    ],
)
def test_task_sizes(total, split, partitions):
    assert task_sizes(total) == (split, partitions)


def test_task_counts_stay_bounded():
    for total in (TIB, 10 * TIB, 100 * TIB, 1000 * TIB):
        split, partitions = task_sizes(total)
        assert total / split <= 100_000 and partitions <= 50_000


@pytest.mark.parametrize(
    ("text", "expected"),
    [("134217728b", 134217728), ("128MB", 2**27), ("1g", GIB), ("64", 64), ("2 k", 2048)],
)
def test_sizes_are_read_as_spark_writes_them(text, expected):
    assert _bytes(text) == expected


KEYS = ("spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions")


def numbers(session):
    return _bytes(session.conf.get(KEYS[0])), int(session.conf.get(KEYS[1]))


def on_disk(path):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


@pytest.fixture
def partitioned(spark):
    """A partitioned catalog table without statistics, and its folder."""
    path = scratch_path(spark, "parts")
    rows = spark.range(50_000).selectExpr("id", "rand(1) AS x", "id % 3 AS day")
    rows.write.option("path", path).partitionBy("day").saveAsTable("sized_parts")
    yield path
    spark.sql("DROP TABLE sized_parts")


def test_size_is_that_of_the_files_with_and_without_partitions(spark, partitioned):
    size = on_disk(partitioned)
    assert input_bytes(spark.read.table("sized_parts")) == size
    assert input_bytes(spark.read.parquet(partitioned).filter("x > 0.5").distinct()) == size
    spark.conf.set("spark.sql.defaultSizeInBytes", "1000")
    try:
        assert input_bytes(spark.read.table("sized_parts")) == size
    finally:
        spark.conf.unset("spark.sql.defaultSizeInBytes")


def test_a_job_has_a_session_of_its_own(spark, partitioned, monkeypatch):
    before = numbers(spark)
    df = spark.read.table("sized_parts")
    monkeypatch.setattr("strata.session.input_bytes", lambda _: 3 * TIB)
    first = sized_session(df)
    monkeypatch.setattr("strata.session.input_bytes", lambda _: 5 * TIB)
    second, scans = sized_session(df), sized_session(df, shuffles=False)
    assert numbers(spark) == before
    assert [numbers(s)[1] for s in (first, second, scans)] == [3 * 4096, 5 * 4096, before[1]]
    assert numbers(scans)[0] == max(before[0], -(-5 * TIB // 100_000))
    assert first.conf.get("spark.sql.session.timeZone") == "UTC"
    assert first.read.table("sized_parts").count() == 50_000


def test_small_and_unknown_inputs_keep_the_numbers(spark, partitioned, caplog):
    unknown = spark.createDataFrame([(1,)], "n int")
    assert input_bytes(unknown) is None
    assert numbers(sized_session(unknown)) == numbers(spark)
    assert "unknown" in caplog.text
    assert numbers(sized_session(spark.read.table("sized_parts"))) == numbers(spark)


def test_limits_are_settings_and_say_when_they_bind(spark, partitioned, monkeypatch, caplog):
    monkeypatch.setattr("strata.session.input_bytes", lambda _: TIB)
    spark.conf.set("spark.strata.mostShufflePartitions", "100")
    try:
        assert numbers(sized_session(spark.read.table("sized_parts")))[1] == 100
    finally:
        spark.conf.unset("spark.strata.mostShufflePartitions")
    assert "at most" in caplog.text


def test_discard_deletes_only_in_the_shared_folder(spark):
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    discard(spark, path)
    assert not os.path.exists(path)
    with pytest.raises(ValueError, match="not in the shared folder"):
        discard(spark, "/tmp/elsewhere")
