"""Appends that happen once: each batch is a partition, recorded in the table when it is whole."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.sinks.writers import Layout, SchemaConflict, _aligned, _folder, _quoted, _typed, evolve, layout_of

#: The partition column that names the batch of a row.
BATCH = "ingest_batch"
_RECORD = "strata.batch."
_ID = re.compile(r"[A-Za-z0-9_.-]+")


def committed(spark: SparkSession, table: str) -> list[str]:
    """Ids of the batches that ``table`` holds whole, sorted."""
    if not spark.catalog.tableExists(table):
        return []
    rows = spark.sql(f"SHOW TBLPROPERTIES {table}").filter(F.col("key").startswith(_RECORD)).collect()
    return sorted(row.key.removeprefix(_RECORD) for row in rows)


def commit(spark: SparkSession, table: str, batch: str) -> None:
    """Record that ``table`` holds ``batch`` whole; one catalog call."""
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{_RECORD}{batch}' = 'whole')")


def append_batch(
    df: DataFrame, table: str, batch: str, format: str = "parquet", partition_by: tuple[str, ...] = (), done: bool = True
) -> bool:
    """Append ``df`` to ``table`` as batch ``batch``; False, and nothing happens, if it is there.

    The batch has a partition of its own and is recorded once it is written. An append that died
    before is overwritten when it is tried again, so a retry neither doubles nor loses rows, and
    no other batch is touched. New columns and fields are added as ``append_evolving`` does. The
    table is divided further by ``partition_by``. Without ``done`` the record is left to the caller.
    """
    if not _ID.fullmatch(batch):
        raise ValueError(f"a batch id has letters, digits, dots, dashes and underscores only: {batch!r}")
    spark = df.sparkSession
    fold = _folder(spark)
    if fold(BATCH) in map(fold, df.columns):
        raise SchemaConflict(f"{BATCH} is the column that tells batches apart")
    if batch in committed(spark, table):
        return False
    schema = _typed(df.schema) or T.StructType()
    if not spark.catalog.tableExists(table):
        empty = spark.createDataFrame([], schema).withColumn(BATCH, F.lit(batch))
        Layout(partition_by=(BATCH, *partition_by)).apply(empty.write.format(format)).saveAsTable(table)
    divided = layout_of(spark, table).partition_by
    if not divided or fold(divided[0]) != fold(BATCH):
        raise SchemaConflict(f"{table} is not divided by {BATCH}")
    evolve(spark, table, schema)
    fields = [f for f in spark.read.table(table).schema if fold(f.name) != fold(BATCH)]
    inner = "".join(f", `{name}`" for name in divided[1:])
    rows = _aligned(df, fields, fold).select(*(_quoted(f.name) for f in fields))
    spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (`{BATCH}` = '{batch}'{inner}) SELECT * FROM {{rows}}", rows=rows)
    if done:
        commit(spark, table, batch)
    return True
