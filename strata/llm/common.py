"""Reading tables, bounded Arrow batches, words and rolling hashes in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import discard, scratch_path, sized_session

#: Bytes of text that one step in a task works on; a longer text is a step by itself.
STEP_BYTES = 2 << 20
#: Bytes of a table's files for each shuffle partition; strings are shuffled with up to 4 times as many.
PARTITION_BYTES = 64 << 20
#: What a null doc_id counts as: it comes after every other document.
NO_ID = 2**63 - 1

U64 = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_sized(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """As ``read``, in a session of its own whose number of shuffle partitions fits the table's files.

    What is derived from it keeps that session, so the operators need no number.
    """
    own = sized_session(read(spark, sf_dir, table), partition_bytes=PARTITION_BYTES)
    return read(own, sf_dir, table)


def steps(batches: Iterable[pa.RecordBatch], column: str, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices whose ``column`` holds about ``size`` bytes at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        before = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(before, before[at] + size, "right")) - 1
            upto = max(at + 1, min(upto, batch.num_rows))
            yield batch.slice(at, upto - at)
            at = upto


def released(run: Callable) -> Callable:
    """``run`` over a task's batches; what it used goes back to the system when it ends.

    Python workers live on between stages, beside the memory that other operators need.
    """

    def whole(batches):
        yield from run(batches)
        _powers.clear()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return whole


def keep_pages() -> None:
    """From now on this process keeps the memory of freed arrays for the next ones.

    Arrays of a few hundred KB otherwise go back to the system each time, and getting their pages
    anew takes as long as the arithmetic. ``released`` gives all back when a task ends.
    """
    tune = getattr(ctypes.CDLL(None), "mallopt", None)  # glibc has it
    if tune is not None:
        for setting, size in ((-3, 32 << 20), (-1, 256 << 20), (-2, 16 << 20)):  # mmap and trim thresholds, top pad
            tune(setting, size)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of ``column`` as one array of bytes, and where each begins; null is empty."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def long_ids(column: pa.Array) -> np.ndarray:
    """Ids as int64; null becomes ``NO_ID``."""
    return pc.fill_null(column.cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)


def lower(data: np.ndarray) -> np.ndarray:
    """``data`` with A-Z as a-z, every other byte as it is."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


#: Bytes that part words: space and tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and the number of words before each text."""
    n = len(data)
    inside = ~gaps[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begins, ends, np.searchsorted(begins, offsets)


def _power(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers.get(which, (np.zeros(0, U64),) * 2)
    if len(up) <= n:
        size = max(n + 1, 1 << 16)
        base = _BASES[which]
        ones = np.full(size, base, U64), np.full(size, pow(base, -1, 2**64), U64)
        for x in ones:
            x[0] = 1
            np.multiply.accumulate(x, out=x)
        up, down = ones
        if size <= STEP_BYTES * 3:
            _powers[which] = ones
    return up, down


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


class Rolling:
    """Hashes of any runs of ``values``, in constant time each, as polynomials modulo 2**64."""

    def __init__(self, values: np.ndarray, which: int = 0):
        self.down = _power(len(values), which)[1]
        spread = _SPREAD[values] if values.dtype == np.uint8 else values
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(spread * _power(len(values), which)[0][: len(values)], out=self.sums[1:])

    def runs(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[begins]) * self.down[begins] + (ends - begins).astype(U64))


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, size: int = 1 << 19) -> np.ndarray:
    """Hashes of spans that follow one another, a slice of ``data`` at a time."""
    out, b = np.empty(len(begins), U64), 0
    while b < len(begins):
        e = max(b + 1, int(np.searchsorted(ends, begins[b] + size, "right")))
        low = begins[b]
        out[b:e] = Rolling(data[low : ends[e - 1]]).runs(begins[b:e] - low, ends[b:e] - low)
        b = e
    return out


_SPREAD = mixed(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def spans_gather(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all elements of the spans, one span after the other."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    if not len(ends):
        return np.zeros(0, np.int64)
    index = np.repeat(begins - (ends - lengths), lengths)
    index += np.arange(ends[-1])
    return index


def spans_slices(lengths: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs [b, e) of spans with about ``size`` elements at most, but at least one span."""
    before = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    b = 0
    while b < len(lengths):
        e = max(b + 1, int(np.searchsorted(before, before[b] + size, "right")) - 1)
        yield b, e
        b = e


def text_key(text: str | Column = "text") -> Column:
    """Tells apart rows that share a doc_id, in 15 bits, as every packed string carries it."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), F.lit(2**15))


def own_ids(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``own_id`` that tells every document apart, and each of them once.

    It is the doc_id where no other row has it. Rows that share a doc_id, or have none, get an id
    from the hash of doc_id and text, above 2**62 and so after most others; repeated rows of one
    doc_id and text are one document.
    """
    key = F.col("doc_id").cast("long")
    shared = docs.groupBy(key.alias("shared_id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or shared_id is null").drop("n")
    if shared.isEmpty():
        return docs.withColumn("own_id", key)
    marked = docs.join(shared, key.eqNullSafe(F.col("shared_id")), "left_semi")
    spread = F.xxhash64(key, F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(2**62 - 1)) + F.lit(2**62)
    alone = docs.join(shared, key.eqNullSafe(F.col("shared_id")), "left_anti").withColumn("own_id", key)
    return alone.unionByName(marked.withColumn("own_id", spread).dropDuplicates(["own_id"]))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written to the shared folder once and read back: its lineage is cut there.

    Inside ``passing`` the table is deleted at the end of the block, unless ``keep`` is set.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    paths = _passing.get()
    if paths is not None and not keep:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are only needed there; what leaves the block must be kept or computed."""
    token = _passing.set([])
    try:
        yield
    finally:
        discard(spark, *_passing.get())
        _passing.reset(token)


def bucket_rows(rows: DataFrame, partitions: int) -> DataFrame:
    """``rows`` dealt out by bucket, each partition sorted by it."""
    return rows.repartition(partitions, "bucket").sortWithinPartitions("bucket")
