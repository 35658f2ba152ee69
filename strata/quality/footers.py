"""Rules about a table as a whole, answered from Parquet footers where they hold the answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.quality.report import _TOTAL, _counters, _unpivot
from strata.quality.rules import Rule

#: Types whose greatest value Spark takes from footers; of others the one column is read.
_IN_FOOTERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)
_ROWS = "__rows"
_RULES = ("table_not_empty", "row_count_above", "freshness", "no_future")


def footer_session(spark: SparkSession) -> SparkSession:
    """A session like ``spark`` that counts rows and finds greatest values in Parquet footers."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    first = [s for s in own.conf.get("spark.sql.sources.useV1SourceList").split(",") if s.strip() != "parquet"]
    own.conf.set("spark.sql.sources.useV1SourceList", ",".join(first))
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own


def evaluate_footers(spark: SparkSession, path: str, rules: Sequence[Rule], table: str = "") -> DataFrame:
    """The report that ``evaluate`` gives for the Parquet files at ``path``, without reading their rows.

    Takes rules about emptiness, row counts, freshness and the future. Rows are counted in the
    footers, where the newest value of a date or whole number stands too; the newest timestamp is
    found by reading its column alone. Rows of the future are counted by a filter that skips all
    row groups whose greatest value is not in it. Without rows, or with nulls only, the newest is null.
    """
    unfit = [rule.name for rule in rules if rule.name not in _RULES]
    if unfit:
        raise ValueError(f"footers do not answer {', '.join(unfit)}; evaluate them on the rows")
    df = footer_session(spark).read.parquet(path)
    kinds = {f.name: f.dataType for f in df.schema}
    newest = list(dict.fromkeys(rule.column for rule in rules if rule.name == "freshness"))
    pushed = [c for c in newest if isinstance(kinds.get(c), _IN_FOOTERS)]
    found = df.agg(F.count(F.lit(1)).alias(_ROWS), *(F.max(f"`{c}`").alias(c) for c in pushed))
    for c in newest:
        if c not in pushed:
            found = found.withColumn(c, df.agg(F.max(F.col(c))).scalar())
    # What is left is one row that stands for all.
    whole = [rule for rule in rules if rule.violated is None]
    counters = found.agg(*_counters(whole, df.schema, F.col(_ROWS)))
    names = [_TOTAL, *(f"__{rules.index(rule)}" for rule in whole)]
    counters = counters.toDF(*names)
    for i, rule in enumerate(rules):
        if rule.violated is not None:
            late = df.filter(rule.violated(df.schema)).agg(F.count(F.lit(1)))
            counters = counters.withColumn(f"__{i}", late.scalar())
    return _unpivot(counters, rules, table)
