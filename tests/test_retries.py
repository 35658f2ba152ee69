"""Failed tasks: rows are written once and counted once.

A local session tries a task only once unless its master says otherwise, so this runs
in a session of its own.
"""

import json
import subprocess
import sys
import textwrap
from pathlib import Path

SCRIPT = textwrap.dedent(
    """
    import json, sys

    sys.path.insert(0, sys.argv[1])
    from pyspark import TaskContext
    from pyspark.sql import SparkSession

    from strata.names import Workspace
    from strata.plans import run_bronze, run_gated
    from strata.quality import not_null, observe, table_not_empty
    from strata.session import configure, scratch_path
    from strata.sinks import append_evolving_path

    spark = configure(
        SparkSession.builder.master("local[2,4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.checkpoint.dir", sys.argv[2])
        .config("spark.sql.warehouse.dir", sys.argv[2] + "/warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")

    def lost_once(batches):
        for batch in batches:
            yield batch
        task = TaskContext.get()
        if task.attemptNumber() == 0 and task.partitionId() % 2 == 0:
            raise RuntimeError("executor lost")

    def shaky(df):
        return df.mapInPandas(lost_once, df.schema)

    numbers = shaky(spark.range(0, 1000, 1, 4).selectExpr("id", "nullif(id % 10, 0) AS v"))
    path = scratch_path(spark, "numbers")
    counted, observed = observe(numbers, [not_null("v"), table_not_empty()], "numbers")
    append_evolving_path(counted, path, schema=counted.schema)
    report = {r.rule: [r.total_rows, r.failing_rows] for r in observed.report(spark).collect()}

    trips = spark.range(0, 1000, 1, 4).selectExpr(
        "timestamp_seconds(1700000000 + id) AS tpep_pickup_datetime",
        "timestamp_seconds(1700000600 + id) AS tpep_dropoff_datetime",
        "2 AS passenger_count", "1.0D AS trip_distance", "5.0D AS fare_amount", "0.0D AS extra",
        "0.0D AS mta_tax", "0.0D AS tip_amount", "0.0D AS tolls_amount", "5.0D AS total_amount",
        "1 AS payment_type",
    )
    space = Workspace("strata", "retries", catalog="spark_catalog")
    space.create_schemas(spark, "dev", scratch_path(spark, "layers"))
    bronze = run_bronze(spark, "dev", shaky(trips), space)
    gate = run_gated(spark, "dev", space).collect()
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(i) for i in range(100)]
    print(json.dumps({
        "failed": sum(s.numFailedTasks for s in stages if s) >= 4,
        "rows": spark.read.parquet(path).count(),
        "report": report,
        "bronze": spark.read.table(bronze).count(),
        "gate": sorted({(r.table_name, r.total_rows, r.passed) for r in gate}),
    }))
    """
)


def test_retried_tasks_write_and_count_once(tmp_path):
    script = tmp_path / "retries.py"
    script.write_text(SCRIPT)
    repo = str(Path(__file__).parent.parent)
    done = subprocess.run(
        [sys.executable, str(script), repo, str(tmp_path / "shared")],
        capture_output=True,
        text=True,
        timeout=300,
        cwd=tmp_path,
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert json.loads(done.stdout.strip().splitlines()[-1]) == {
        "failed": True,
        "rows": 1000,
        "report": {"not_null": [1000, 100], "table_not_empty": [1000, 0]},
        "bronze": 1000,
        "gate": [["daily_trip_summary", 1, True], ["trips_clean", 1000, True]],
    }
