"""Table rules from footers equal those from the rows."""

import pytest
from helpers import plan
from pyspark.sql import functions as F

from strata import quality
from strata.quality import evaluate_footers

RULES = [
    quality.table_not_empty(),
    quality.no_future("day", "2024-02-10"),
    quality.row_count_above(100),
    quality.freshness("day", 30, "2024-04-10 06:00:00"),
    quality.no_future("at", "2024-01-05 00:00:00"),
    quality.freshness("at", 1, "2024-04-30 00:00:00"),
]


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("n", [0, 1, 100])
def test_as_from_the_rows(spark, tmp_path, n):
    days = spark.range(n).select(
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"),
        F.when(F.col("id") % 3 > 0, F.timestamp_seconds(F.col("id") * 86400 + 1704067200)).alias("at"),
        F.col("id").alias("payload"),
    )
    days.repartition(3).write.parquet(f"{tmp_path}/days")
    expected = quality.evaluate(spark.read.parquet(f"{tmp_path}/days"), RULES, "days")
    assert sorted(map(repr, rows(evaluate_footers(spark, f"{tmp_path}/days", RULES, "days")))) == sorted(map(repr, rows(expected)))


def test_no_row_is_read_for_counts_and_days(spark, tmp_path):
    spark.range(9).select(F.current_date().alias("day"), "id").write.parquet(f"{tmp_path}/t")
    shown = plan(evaluate_footers(spark, f"{tmp_path}/t", [RULES[0], RULES[3]]))
    assert "PushedAggregation: [COUNT(*), MAX(day)]" in shown


def test_other_rules_need_the_rows(spark, tmp_path):
    with pytest.raises(ValueError, match="unique"):
        evaluate_footers(spark, str(tmp_path), [quality.unique("day")])
