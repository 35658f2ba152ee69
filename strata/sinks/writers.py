"""Evolving append and full refresh, on catalog tables or on paths."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.sinks import versions
from strata.sources import read_evolved


class SchemaConflict(ValueError):
    """A column of the batch has another type than the stored column."""


@dataclass(frozen=True)
class Layout:
    """How a stored table is divided; kept when the table is refreshed.

    A table bucketed by columns that equal rows share can be grouped by all its columns
    without a shuffle.
    """

    partition_by: tuple[str, ...] = ()
    bucket_by: tuple[str, ...] = ()
    buckets: int = 0

    def apply(self, writer):
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by)
        if self.bucket_by:
            writer = writer.bucketBy(self.buckets, *self.bucket_by)
        return writer


def layout_of(spark: SparkSession, table: str) -> Layout:
    """The layout of a catalog table or of a published version; none if the table does not exist."""
    if not spark.catalog.tableExists(table):
        return Layout()
    table = versions.current(spark, table) or table
    columns = spark.catalog.listColumns(table)
    bucketed = tuple(c.name for c in columns if c.isBucket)
    buckets = 0
    if bucketed:
        details = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Num Buckets'").first()
        buckets = int(details.data_type)
    return Layout(tuple(c.name for c in columns if c.isPartition), bucketed, buckets)


def _folder(spark: SparkSession) -> Callable[[str], str]:
    """How the session compares column names."""
    sensitive = spark.conf.get("spark.sql.caseSensitive", "false").lower() == "true"
    return (lambda name: name) if sensitive else str.lower


def _typed(kind: T.DataType) -> T.DataType | None:
    """``kind`` with everything nullable and without columns of no type; None if nothing is left."""
    if isinstance(kind, T.NullType):
        return None
    if isinstance(kind, T.StructType):
        fields = [(f.name, _typed(f.dataType)) for f in kind]
        kept = [T.StructField(name, inner) for name, inner in fields if inner is not None]
        return T.StructType(kept) if kept or not fields else None
    if isinstance(kind, T.ArrayType):
        inner = _typed(kind.elementType)
        return None if inner is None else T.ArrayType(inner)
    if isinstance(kind, T.MapType):
        key, value = _typed(kind.keyType), _typed(kind.valueType)
        return None if key is None or value is None else T.MapType(key, value)
    return kind


def _untyped(kind: T.DataType) -> bool:
    """Whether a part of ``kind`` has no type."""
    if isinstance(kind, T.StructType):
        return any(_untyped(f.dataType) for f in kind)
    if isinstance(kind, T.MapType):
        return _untyped(kind.keyType) or _untyped(kind.valueType)
    return _untyped(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, T.NullType)


def merged_type(stored: T.DataType, batch: T.DataType, fold: Callable[[str], str], path: str) -> T.DataType:
    """The type that holds both: structs gain fields, at any depth; all else has to be equal.

    A part of the batch without a type (an untyped null) takes the stored one.
    """
    batch = _typed(batch)
    if batch is None:
        return stored
    if isinstance(stored, T.StructType) and isinstance(batch, T.StructType):
        new = {fold(f.name): f for f in batch}
        known = {fold(f.name) for f in stored}
        fields = [
            T.StructField(f.name, merged_type(f.dataType, new[fold(f.name)].dataType, fold, f"{path}.{f.name}"))
            if fold(f.name) in new
            else f
            for f in stored
        ]
        return T.StructType([*fields, *(f for f in batch if fold(f.name) not in known)])
    if isinstance(stored, T.ArrayType) and isinstance(batch, T.ArrayType):
        return T.ArrayType(merged_type(stored.elementType, batch.elementType, fold, f"{path}[]"))
    if isinstance(stored, T.MapType) and isinstance(batch, T.MapType):
        key = merged_type(stored.keyType, batch.keyType, fold, f"{path} key")
        return T.MapType(key, merged_type(stored.valueType, batch.valueType, fold, f"{path} value"))
    if stored != batch:
        raise SchemaConflict(f"{path.strip('.')}: {stored.simpleString()} -> {batch.simpleString()}")
    return stored


def merged_schema(stored: T.StructType, batch: T.StructType, fold: Callable[[str], str] = str.lower) -> T.StructType:
    """``stored`` with what ``batch`` adds; every conflict is named in one error."""
    conflicts, fields = [], []
    stored = _typed(stored) or T.StructType()
    new = {fold(f.name): f for f in batch}
    for field in stored:
        try:
            kind = field.dataType
            if fold(field.name) in new:
                kind = merged_type(kind, new[fold(field.name)].dataType, fold, field.name)
            fields.append(T.StructField(field.name, kind))
        except SchemaConflict as conflict:
            conflicts.append(str(conflict))
    if conflicts:
        raise SchemaConflict("; ".join(conflicts))
    known = {fold(f.name) for f in stored}
    added = _typed(T.StructType([f for f in batch if fold(f.name) not in known])) or T.StructType()
    return T.StructType([*fields, *added])


def added_columns(
    stored: T.StructType, batch: T.StructType, fold: Callable[[str], str] = str.lower
) -> list[T.StructField]:
    """Columns of ``batch`` that ``stored`` lacks and that have a type.

    Raises :class:`SchemaConflict` before anything is written if a shared column changed
    its type otherwise than by gaining fields.
    """
    return list(merged_schema(stored, batch, fold))[len(_typed(stored) or T.StructType()) :]


def _conformed(value: Column, have: T.DataType, want: T.DataType, fold: Callable[[str], str]) -> Column:
    """``value`` as the type ``want``, which ``merged_type`` made; missing fields are null."""
    if _typed(have) == want and not _untyped(have):
        return value
    if isinstance(have, T.NullType):
        return F.lit(None).cast(want)
    if isinstance(want, T.StructType):
        own = {fold(f.name): f for f in have}
        fields = [
            _conformed(value.getField(own[fold(f.name)].name), own[fold(f.name)].dataType, f.dataType, fold).alias(f.name)
            if fold(f.name) in own
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in want
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(want, T.ArrayType):
        return F.transform(value, lambda x: _conformed(x, have.elementType, want.elementType, fold))
    if isinstance(want, T.MapType):
        return F.transform_values(value, lambda _, x: _conformed(x, have.valueType, want.valueType, fold))
    return value.cast(want)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _aligned(df: DataFrame, fields: Sequence[T.StructField], fold: Callable[[str], str]) -> DataFrame:
    """``df`` with exactly these columns in this order; those it lacks are null."""
    present = {fold(f.name): f for f in df.schema}

    def column(field: T.StructField) -> Column:
        kind = _typed(field.dataType)
        if fold(field.name) not in present:
            return F.lit(None).cast(kind).alias(field.name)
        own = present[fold(field.name)]
        return _conformed(_quoted(own.name), own.dataType, kind, fold).alias(field.name)

    return df.select(*(column(field) for field in fields))


def append_evolving(df: DataFrame, table: str, format: str = "parquet", layout: Layout | None = None) -> None:
    """Append ``df`` to ``table``, adding to the table the columns and fields it lacks.

    Rows already stored read null in an added column, and the batch null in a column it
    lacks. Columns without a type are left out until they have one. The merged schema
    lives in the catalog, so neither appends nor reads have to look at the stored files.
    New columns and new fields of structs are one change of the catalog before the rows are
    written: stored files stay as they are, and readers find null for what a file lacks. If
    the job dies in between, the wider table still holds its old rows, and a retry appends.
    ``layout`` holds for a table that is created. Delta tables merge by themselves.
    """
    layout = layout or Layout()
    if format == "delta":
        layout.apply(df.write.format(format).mode("append").option("mergeSchema", "true")).saveAsTable(table)
        return
    spark = df.sparkSession
    fold = _folder(spark)
    df = _aligned(df, _typed(df.schema) or T.StructType(), fold)
    if not spark.catalog.tableExists(table):
        layout.apply(df.write.format(format)).saveAsTable(table)
        return
    evolve(spark, table, df.schema)
    # Partition columns come last whatever was added, so the order is the table's.
    _aligned(df, spark.read.table(table).schema, fold).write.insertInto(table)


def evolve(spark: SparkSession, table: str, schema: T.StructType) -> None:
    """Add to ``table`` the columns, and the fields of structs, that ``schema`` has beyond it."""
    stored, fold = spark.read.table(table).schema, _folder(spark)
    merged = merged_schema(stored, schema, fold)
    if T.StructType(list(merged)[: len(stored)]) != _typed(stored):
        partitions = {fold(c) for c in layout_of(spark, table).partition_by}
        _set_columns(spark, table, T.StructType([f for f in merged if fold(f.name) not in partitions]))
    elif added := list(merged)[len(stored) :]:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in added)
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({columns})")


def _set_columns(spark: SparkSession, table: str, columns: T.StructType) -> None:
    """Give a table wider columns in one catalog call; its files, comment and properties stay.

    SQL can add columns to Spark's own tables, but no fields to a column. The call that serves
    ADD COLUMNS can, and it refuses to lose a column.
    """
    session = getattr(spark, "_jsparkSession", None)
    if session is None:
        raise SchemaConflict(f"{table}: a struct gains a field, which needs a session with access to its catalog")
    state = session.sessionState()
    name = state.sqlParser().parseTableIdentifier(".".join(table.split(".")[-2:]))
    state.catalog().alterTableDataSchema(name, spark._jvm.org.apache.spark.sql.types.DataType.fromJson(columns.json()))
    spark.catalog.refreshTable(table)


def append_evolving_path(
    df: DataFrame, path: str, format: str = "parquet", schema: T.StructType | None = None
) -> None:
    """Append ``df`` to the files at ``path``; read them with ``read_evolved``.

    Type conflicts are checked against ``schema`` if the caller knows the stored
    one; otherwise the footers already there are merged to find it.
    """
    if format == "delta":
        df.write.format(format).mode("append").option("mergeSchema", "true").save(path)
        return
    fold = _folder(df.sparkSession)
    df = _aligned(df, _typed(df.schema) or T.StructType(), fold)
    if schema is None:
        try:
            schema = read_evolved(df.sparkSession, path, format=format).schema
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            schema = T.StructType()
    present = {fold(name) for name in df.columns}
    kept = [f for f in merged_schema(schema, df.schema, fold) if fold(f.name) in present]
    _aligned(df, kept, fold).write.format(format).mode("append").save(path)


def refresh(df: DataFrame, table: str, format: str = "parquet", layout: Layout | None = None) -> None:
    """Replace rows and schema of ``table``; its layout stays unless another is given.

    The rows are stored as a new version, then the view ``table`` is pointed at it (see
    :mod:`strata.sinks.versions`): readers see the old rows until then, a failed refresh
    leaves them, and ``df`` may read the table it replaces. A plain table of that name becomes
    the first version; one divided into partitions is overwritten in place, as not every catalog
    can rename it, and is absent meanwhile. Delta swaps rows by itself.
    """
    writer = df.write.format(format)
    if format == "delta":
        (layout or Layout()).apply(writer.mode("overwrite").option("overwriteSchema", "true")).saveAsTable(table)
        return
    spark = df.sparkSession
    versions.recover(spark, table)
    layout = layout_of(spark, table) if layout is None else layout
    fold = _folder(spark)
    if not {*map(fold, df.columns)} >= {*map(fold, (*layout.partition_by, *layout.bucket_by))}:
        raise SchemaConflict(f"{table} is divided by a column that its new rows lack")
    if not versions.adopt(spark, table):
        layout.apply(writer.mode("overwrite")).saveAsTable(table)
        return
    version = versions.next_version(spark, table)
    layout.apply(writer).saveAsTable(version)
    versions.publish(spark, table, version)


def refresh_path(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Replace the files at ``path``, with the schema of ``df``."""
    writer = df.write.format(format).mode("overwrite")
    if format == "delta":
        writer = writer.option("overwriteSchema", "true")
    writer.save(path)
