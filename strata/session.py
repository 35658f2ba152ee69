"""Session settings the results depend on, and the shared scratch folder."""

from __future__ import annotations

import logging
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# The day of a timestamp is cut in the session time zone, so the zone is pinned.
# ANSI mode makes an overflowing sum fail instead of wrapping round.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

_local_folders: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Apply ``SETTINGS`` to a running session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, for written intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    temporary folder is used in local mode only; on a cluster a machine-local
    folder would be invisible to the other executors, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    application = spark.conf.get("spark.app.id")
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="strata-")
    return _local_folders[application]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables under the shared folder that nothing reads any more.

    Where the session has no access to the file system (Spark Connect), they stay.
    """
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        return
    shared = shared_folder(spark)
    for path in paths:
        if not path.startswith(f"{shared}/"):
            raise ValueError(f"{path} is not in the shared folder")
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


_SPLIT = "spark.sql.files.maxPartitionBytes"
_PARTITIONS = "spark.sql.shuffle.partitions"
_MIB = 1024 * 1024
#: Settings of a session for how many tasks a job may have at most, and what holds if unset.
MOST_SCANS = ("spark.strata.mostScanTasks", 100_000)
MOST_PARTITIONS = ("spark.strata.mostShufflePartitions", 50_000)
_log = logging.getLogger(__name__)


def task_sizes(
    total_bytes: int,
    split_bytes: int = 128 * _MIB,
    partition_bytes: int = 256 * _MIB,
    most_scans: int = MOST_SCANS[1],
    most_partitions: int = MOST_PARTITIONS[1],
) -> tuple[int, int]:
    """Bytes per scan task and number of shuffle partitions for an input.

    A shuffle moves one block per pair of scan task and partition, so beyond
    ``most_scans`` and ``most_partitions`` the tasks grow instead of their number. No row
    is left out then; a warning is logged.
    """
    split = max(split_bytes, math.ceil(total_bytes / most_scans))
    partitions = math.ceil(total_bytes / partition_bytes)
    if split > split_bytes or partitions > most_partitions:
        _log.warning(
            "%d bytes: at most %d scan tasks and %d shuffle partitions, so tasks read %d and %d bytes",
            total_bytes, most_scans, most_partitions, split, math.ceil(total_bytes / min(partitions, most_partitions)),
        )
    return split, min(most_partitions, partitions)


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the files that ``df`` reads, from the listing its scan uses anyway; runs no job.

    Holds for tables with or without partitions and statistics; partitions that a filter rules
    out do not count. None if ``df`` reads no files.
    """
    plan = getattr(df, "_jdf", None)
    if plan is None:  # Spark Connect
        return _listed_bytes(df)
    leaves, sizes = plan.queryExecution().optimizedPlan().collectLeaves(), []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() != "LogicalRelation":
            continue
        relation = leaf.relation()
        if relation.getClass().getSimpleName() != "HadoopFsRelation":
            continue
        files = relation.location()
        if files.getClass().getSimpleName() == "CatalogFileIndex":  # it knows no size before it lists its partitions
            nothing = getattr(getattr(df.sparkSession._jvm.scala.collection.immutable, "Nil$"), "MODULE$")
            files = files.filterPartitions(nothing)
        sizes.append(files.sizeInBytes())
    return sum(sizes) if sizes else _listed_bytes(df)


def _listed_bytes(df: DataFrame) -> int | None:
    """Bytes of the files that ``df`` names, by a job that lists their folders."""
    folders = sorted({file.rpartition("/")[0] for file in df.inputFiles()})
    if not folders:
        return None
    listed = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders)
    return listed.agg({"length": "sum"}).first()[0] or 0


def sized_session(df: DataFrame, shuffles: bool = True, partition_bytes: int = 256 * _MIB) -> SparkSession:
    """A session like that of ``df`` with tasks sized for reading and shuffling it whole.

    The number of shuffle partitions in a session is right for one size of input only, and
    adaptive execution merges partitions but never adds any. The session is the job's own,
    with the same catalog: jobs that run beside it keep their numbers. What is read through
    it keeps its numbers even when it runs later. Numbers are only raised. An input of
    unknown size leaves them, with a warning. Without ``shuffles`` only scans are sized. A job that
    shuffles more than it reads names fewer ``partition_bytes`` of input for each partition.
    """
    spark = df.sparkSession
    size = input_bytes(df)
    if size is None:
        _log.warning("the input's size is unknown; the session's number of partitions is used")
    most = [int(spark.conf.get(key, str(default))) for key, default in (MOST_SCANS, MOST_PARTITIONS)]
    split, partitions = task_sizes(size or 0, _bytes(spark.conf.get(_SPLIT)), partition_bytes, *most)
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set(_SPLIT, f"{split}b")
    if shuffles:
        own.conf.set(_PARTITIONS, str(max(partitions, int(spark.conf.get(_PARTITIONS)))))
    return own


def _bytes(size: str) -> int:
    units = {"": 1, "b": 1, "k": 2**10, "kb": 2**10, "m": 2**20, "mb": 2**20}
    units |= {"g": 2**30, "gb": 2**30, "t": 2**40, "tb": 2**40}
    text = size.strip().lower()
    number = text.rstrip("bkmgt")
    return int(number) * units[text[len(number) :]]
