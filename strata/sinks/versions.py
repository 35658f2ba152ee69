"""Tables whose rows are replaced as a whole, by versions behind a view.

Each refresh writes a table of its own beside the last one; then one catalog call points the view
of the published name at it. Readers see the old rows or the new ones, never none, and a refresh
that fails leaves the old rows. A query that has begun keeps reading the version it began with,
which stays until ``KEPT`` newer ones have been published.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

#: Versions that stay beside the current one, for readers that have begun.
KEPT = 1
_MARK = "__v"


def _plain(name: str) -> str:
    return name.replace("`", "")


def _parts(table: str) -> tuple[str, str]:
    """The schema with a dot, or nothing, and the table's own name."""
    schema, dot, own = table.rpartition(".")
    return schema + dot, own


def is_view(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table) and spark.catalog.getTable(_plain(table)).tableType == "VIEW"


def versions(spark: SparkSession, table: str) -> dict[int, list[str]]:
    """The stored versions of ``table`` by number, published or not."""
    schema, own = _parts(table)
    place = f" IN {schema[:-1]}" if schema else ""
    pattern = re.compile(re.escape(_plain(own).lower() + _MARK) + r"(\d+)_[0-9a-f]+")
    found: dict[int, list[str]] = {}
    for row in spark.sql(f"SHOW TABLES{place}").select("tableName").collect():
        if match := pattern.fullmatch(row.tableName.lower()):
            found.setdefault(int(match[1]), []).append(schema + row.tableName)
    return found


def current(spark: SparkSession, table: str) -> str | None:
    """The version that ``table`` shows; None if it is a table itself, or nothing."""
    if not is_view(spark, table):
        return None
    text = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'View Text'").first().data_type
    shown = _plain(text.rpartition(" ")[2])
    schema, own = _parts(table)
    if not _parts(shown)[1].lower().startswith(_plain(own).lower() + _MARK):
        raise ValueError(f"{table} is a view of something else, not a published table")
    return schema + _parts(shown)[1]


def next_version(spark: SparkSession, table: str) -> str:
    """A name for the next version; two writers never get the same one."""
    schema, own = _parts(table)
    return f"{schema}{own}{_MARK}{max(versions(spark, table), default=0) + 1:06d}_{uuid.uuid4().hex[:8]}"


def _number(version: str) -> int:
    return int(version.rpartition(_MARK)[2].partition("_")[0])


def recover(spark: SparkSession, table: str) -> None:
    """Show the newest version where a table was taken over and its view is missing."""
    if not spark.catalog.tableExists(table) and (found := versions(spark, table)):
        spark.sql(f"CREATE VIEW {table} AS SELECT * FROM {found[max(found)][0]}")


def adopt(spark: SparkSession, table: str) -> bool:
    """Turn a plain table into the first version of a published one; False if it has partitions.

    Its name is absent between two catalog calls, once in its life; ``recover``, which every
    refresh begins with, mends a loss of the driver in between. Partitions stay behind in some
    catalogs when their table is renamed, so such a table is left as it is.
    """
    if spark.catalog.tableExists(table) and current(spark, table) is None:
        if any(column.isPartition for column in spark.catalog.listColumns(table)):
            return False
        version = next_version(spark, table)
        spark.sql(f"ALTER TABLE {table} RENAME TO {'.'.join(version.split('.')[-2:])}")
        recover(spark, table)
    return True


def publish(spark: SparkSession, table: str, version: str, kept: int = KEPT) -> None:
    """Show ``version`` under the name of ``table``, then drop versions that are older than the kept ones."""
    change = "ALTER VIEW" if spark.catalog.tableExists(table) else "CREATE VIEW"
    spark.sql(f"{change} {table} AS SELECT * FROM {version}")
    older = sorted(n for n in versions(spark, table) if n < _number(version))
    for number in older[: max(len(older) - kept, 0)]:
        for name in versions(spark, table).get(number, ()):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def drop(spark: SparkSession, table: str) -> None:
    """Drop a published or plain table with all its versions."""
    spark.sql(f"DROP {'VIEW' if is_view(spark, table) else 'TABLE'} IF EXISTS {table}")
    for names in versions(spark, table).values():
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
