"""Scans. Nothing is changed on the way in."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Read a catalog table whole."""
    return spark.read.table(name)


def read_source(
    spark: SparkSession,
    table: str | None = None,
    *,
    path: str | list[str] | None = None,
    format: str = "parquet",
    schema: StructType | str | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Read raw records from a catalog table or through any Spark connector.

    Without ``table`` the records come from ``format`` with its ``options``: files
    at ``path``, or a connector that needs none (``jdbc``). Text formats should be
    given a ``schema``; inferring one reads all the data an extra time.
    """
    if table is not None:
        return read_table(spark, table)
    reader = spark.read.format(format).options(**(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def read_evolved(
    spark: SparkSession,
    path: str,
    *,
    format: str = "parquet",
    schema: StructType | str | None = None,
) -> DataFrame:
    """Read files whose columns grew over time; older rows hold null in newer columns.

    With ``schema`` the footers are not searched for columns. Without it Spark reads
    the footer of every file to merge them, which is slow over very many files; a
    catalog table keeps the merged schema and needs neither.
    """
    if schema is not None:
        return spark.read.format(format).schema(schema).load(path)
    return spark.read.format(format).option("mergeSchema", "true").load(path)
