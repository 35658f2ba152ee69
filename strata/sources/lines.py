"""Records in text files, one a line, with lines that do not parse set aside."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The line as it stands where a record did not parse; null in a good record.
REJECTED = "_rejected"
#: The file that a line comes from.
FILE = "_file"


def read_lines(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str,
    *,
    format: str = "csv",
    options: Mapping[str, str] | None = None,
    header: str | None = None,
) -> DataFrame:
    """The lines of CSV or JSON files as records of ``schema``, with ``_rejected`` and ``_file``.

    A line is rejected if it is cut off, has another number of fields (CSV), or a value that does
    not fit its column; it then stands whole in ``_rejected``. Lines are judged whole, whichever
    columns are read later: a scan by Spark's own readers skips, and so does not check, the columns
    that a query leaves out. Lines equal to ``header`` and empty lines are no records. Files are
    split at any size; records that span lines are not supported.
    """
    if format not in ("csv", "json"):
        raise ValueError(f"lines are csv or json, not {format!r}")
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if clash := {REJECTED, FILE} & set(kind.names):
        raise ValueError(f"{', '.join(sorted(clash))} cannot be a column of lines")
    whole = T.StructType([*kind, T.StructField(REJECTED, T.StringType())])
    told = {**(options or {}), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECTED}
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias(FILE)).filter("trim(value) <> ''")
    if header is not None:
        lines = lines.filter(F.col("value") != header)
    parse = {"csv": F.from_csv, "json": F.from_json}[format]
    record = parse("value", whole.simpleString() if format == "csv" else whole, told)
    return lines.select(record.alias("record"), FILE).select("record.*", FILE)


def accepted(lines: DataFrame) -> DataFrame:
    """The records that parsed, without the columns that tell of lines."""
    return lines.filter(F.col(REJECTED).isNull()).drop(REJECTED, FILE)


def rejected(lines: DataFrame) -> DataFrame:
    """The lines that did not parse, as they stand, with their files."""
    return lines.filter(F.col(REJECTED).isNotNull()).select(F.col(REJECTED).alias("line"), F.col(FILE).alias("file"))
