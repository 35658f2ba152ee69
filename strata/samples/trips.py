"""Taxi-shaped trips made from the order and line item tables.

The tables hold no nulls, duplicates or odd values, so every operator would pass
rows through untouched. Each line item becomes a trip, and a fixed rule over the
order key blanks, spoils or repeats some of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# An order key divisible by the number marks the defect.
NO_PICKUP = 83
NO_DROPOFF = 79
SUB_SECOND = 61
NO_PASSENGERS = 73
NO_DISTANCE = 89
NO_FARE = 97
NAN_FARE = 71
NEGATIVE_FARE = 67
REPEATED = 10


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _marked(number: int) -> Column:
    return F.col("l_orderkey") % number == 0


def trips(spark: SparkSession, sf_dir: str, nan: bool = False) -> DataFrame:
    """All line items as trips; ``nan`` also puts NaN into some fares."""
    lines = read(spark, sf_dir, "lineitem")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    price = F.col("l_extendedprice")
    fare = F.when(_marked(NO_FARE), None)
    if nan:
        fare = fare.when(_marked(NAN_FARE), F.lit(float("nan")))
    fare = fare.when(_marked(NEGATIVE_FARE), -price).otherwise(price)
    dropoff = (
        F.when(_marked(NO_DROPOFF), None)
        .when(_marked(SUB_SECOND), F.col("o_orderdate") + F.expr("INTERVAL 0.4 SECOND"))
        .otherwise(F.col("l_shipdate"))
    )
    flag = F.col("l_returnflag")
    copies = F.when(_marked(REPEATED), 2).otherwise(1)
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .select(
            F.when(~_marked(NO_PICKUP), F.col("o_orderdate")).alias("tpep_pickup_datetime"),
            dropoff.alias("tpep_dropoff_datetime"),
            F.when(~_marked(NO_PASSENGERS), F.col("l_linenumber")).alias("passenger_count"),
            F.when(~_marked(NO_DISTANCE), F.col("l_quantity")).alias("trip_distance"),
            fare.alias("fare_amount"),
            F.col("l_discount").alias("extra"),
            F.col("l_tax").alias("mta_tax"),
            F.when(flag == "R", F.col("l_quantity")).alias("tip_amount"),
            F.lit(0.0).alias("tolls_amount"),
            F.col("o_totalprice").alias("total_amount"),
            F.when(flag == "A", 1).when(flag == "N", 2).when(flag == "R", 3).alias("payment_type"),
            F.col("l_linestatus").alias("vendor_name"),
            F.explode(F.array_repeat(F.lit(1), copies)).alias("copy"),
        )
        .drop("copy")
    )
