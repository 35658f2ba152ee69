"""Small hand-made trips and plan inspection."""

from datetime import datetime, timedelta

from pyspark.sql import types as T

# The columns cleaning looks at, and one that only passes through.
TRIP_SCHEMA = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in {
            "fare_amount": T.DoubleType(),
            "passenger_count": T.IntegerType(),
            "trip_distance": T.DoubleType(),
            "dispatcher": T.StringType(),
            "tpep_dropoff_datetime": T.TimestampType(),
            "tpep_pickup_datetime": T.TimestampType(),
        }.items()
    ]
)

START = datetime(2031, 5, 6, 21, 40, 10)
GOOD = {
    "fare_amount": 31.75,
    "passenger_count": 4,
    "trip_distance": 9.5,
    "dispatcher": "north",
    "tpep_dropoff_datetime": START + timedelta(minutes=24),
    "tpep_pickup_datetime": START,
}


def trip(**changes):
    return {**GOOD, **changes}


def lasting(**duration):
    return trip(tpep_dropoff_datetime=START + timedelta(**duration))


def make(spark, *rows):
    return spark.createDataFrame([tuple(r[f.name] for f in TRIP_SCHEMA) for r in rows], TRIP_SCHEMA)


def full_width(df):
    """Add the columns of a whole bronze trip that ``make`` leaves out."""
    return df.selectExpr(
        "*",
        "0.5D AS extra",
        "0.5D AS mta_tax",
        "CAST(NULL AS DOUBLE) AS tip_amount",
        "0.0D AS tolls_amount",
        "13.5D AS total_amount",
        "1 AS payment_type",
    )


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def shuffled_records(df) -> list[int]:
    """Run ``df`` and return how many records each of its shuffles wrote."""
    df.collect()
    records = []

    def visit(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            visit(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            visit(node.plan())
        else:
            if kind == "ShuffleExchangeExec":
                records.append(node.metrics().apply("shuffleRecordsWritten").value())
            for i in range(node.children().size()):
                visit(node.children().apply(i))

    visit(df._jdf.queryExecution().executedPlan())
    return records
