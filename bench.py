"""Times the headline queries and prints one JSON line.

The trips are written to Parquet first, so that making them is not timed. Each query
runs once to warm up, then ``BENCH_RUNS`` times; its figure is the median.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strata.names import Workspace
from strata.plans import (
    aggregate,
    clean,
    clean_model,
    daily_model,
    run_all,
    run_bronze,
    run_gated,
    run_gold_model,
    run_silver_model,
    taxi,
)
from strata.quality import evaluate
from strata.samples.trips import trips
from strata.session import configure, scratch_path

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))
# The large table holds each trip this many times, on different days.
COPIES = int(os.environ.get("BENCH_COPIES", "15"))


def seconds(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = configure(
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("strata-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    folder = scratch_path(spark, "bench")
    trips(spark, SF_DIR).repartition(int(CPUS)).write.parquet(f"{folder}/trips")
    raw = spark.read.parquet(f"{folder}/trips")
    raw.createOrReplaceTempView("bench_trips")
    clean(raw).write.parquet(f"{folder}/silver")
    silver = spark.read.parquet(f"{folder}/silver")
    silver.createOrReplaceTempView("bench_silver")
    rows = raw.count()
    shift = F.make_dt_interval(F.col("copy").cast("int"))
    several = raw.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))
    for column in (taxi.PICKUP, taxi.DROPOFF):
        several = several.withColumn(column, F.col(column) + shift)
    several.drop("copy").write.parquet(f"{folder}/large")
    large = spark.read.parquet(f"{folder}/large")
    silver_rules = taxi.contract("trips_silver").rules()

    def workspace(name: str) -> Workspace:
        schema = f"bench_{os.path.basename(folder).replace('-', '_')}_{name}"
        space = Workspace("strata", schema, catalog="spark_catalog")
        space.create_schemas(spark, "test", f"{folder}/{name}")
        return space

    spaces = iter(range(10**6))

    def layered_gold():
        run_all(spark, "test", raw, workspace(f"jobs{next(spaces)}"))

    def layered_gold_sql():
        space = workspace(f"models{next(spaces)}")
        run_bronze(spark, "test", raw, space)
        run_silver_model(spark, "test", space)
        run_gold_model(spark, "test", space)

    def gated_gold():
        space = workspace(f"gated{next(spaces)}")
        run_bronze(spark, "test", raw, space)
        run_gated(spark, "test", space)

    queries = {
        "silver_clean": lambda: consume(clean(raw)),
        "silver_clean_sql": lambda: consume(spark.sql(clean_model("bench_trips"))),
        "daily_summary": lambda: consume(aggregate(silver)),
        "daily_summary_exact": lambda: consume(aggregate(silver, exact=True)),
        "daily_summary_sql": lambda: consume(spark.sql(daily_model("bench_silver"))),
        "contract_report": lambda: consume(evaluate(silver, silver_rules, "silver")),
        "layered_gold": layered_gold,
        "layered_gold_sql": layered_gold_sql,
        "gated_gold": gated_gold,
        "silver_clean_large": lambda: consume(clean(large)),
        "daily_summary_large": lambda: consume(aggregate(clean(large))),
        "contract_report_large": lambda: consume(evaluate(clean(large), silver_rules, "silver")),
    }
    timings = {}
    for name, action in queries.items():
        action()
        runs = max(1, RUNS // 2) if name.endswith("_large") else RUNS
        timings[name] = round(statistics.median(seconds(action) for _ in range(runs)), 4)
    total = round(sum(timings.values()), 4)
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": total,
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "input_rows": rows,
                "rows_per_second": {
                    name: round(rows * (COPIES if name.endswith("_large") else 1) / t)
                    for name, t in timings.items()
                },
                "cpus": CPUS,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
