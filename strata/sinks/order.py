"""Whether a stored table lies in the order of a column, and where its rows stand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.sinks import versions


def _files(spark: SparkSession, table: str) -> DataFrame:
    stored = spark.read.table(versions.current(spark, table) or table)
    return stored.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))


def file_ranges(spark: SparkSession, table: str, column: str) -> DataFrame:
    """One row for each file of ``table``, in the order of its names: ``file``, ``rows``, ``low``, ``high``, ``in_order``.

    ``in_order`` says that no value lies below one of an earlier file, nor, within the file, below
    one of an earlier row. The rows of a file are compared by position, those of two files by
    their least and greatest values; the window runs over files only.
    """
    within = Window.partitionBy("__file").orderBy("__row")
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return (
        _files(spark, table)
        .select("__file", F.col(column).alias("value"), (F.lag(column).over(within) > F.col(column)).alias("falls"))
        .groupBy(F.col("__file").alias("file"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.coalesce(F.bool_or("falls"), F.lit(False)).alias("falls"),
        )
        .withColumn("in_order", ~F.col("falls") & F.coalesce(F.max("high").over(earlier) <= F.col("low"), F.lit(True)))
        .drop("falls")
    )


def positions(spark: SparkSession, table: str) -> DataFrame:
    """The rows of ``table`` with ``position``, from 1, in which its files hold them."""
    rows = _files(spark, table)
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("__file").agg(F.count(F.lit(1)).alias("__rows"))
    shifts = files.select("__file", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    return rows.join(shifts, "__file").withColumn("position", F.col("__before") + F.col("__row") + 1).drop("__file", "__row", "__before")
