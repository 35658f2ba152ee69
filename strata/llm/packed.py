"""Packed strings on their way to buckets, and removal intervals on their way back.

Both substring operators cut texts into overlapping strings, each with a key that equal
windows share. A task packs the strings of one bucket into one compressed row, so that a
shuffle moves few rows. Identical strings are sent once per task step; the others are known
to repeat at once. Keys that a large share of all strings have (``hot_keys``) are not sent as
strings: their windows go one by one, spread by the hash of the whole window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import STEP_BYTES, U64, mixed, passing, released, spans_gather, steps, stored

#: A key is hot if it has more than one in so many of all strings; there are no more than
#: ``HOT_SHARE`` such keys, so the set of them can be broadcast.
HOT_SHARE = 500
#: Buckets for each shuffle partition.
BUCKETS = 8
#: Bytes of strings that a reducing task works on at a time, but at least one bucket.
GROUP_BYTES = 4 << 20
#: Of the compression; strings are moved once and opened once.
LEVEL = 6

ROWS = "bucket int, kind int, body binary"
PACKED = 0  # strings
SINGLE = 1  # hashes of windows
KNOWN = 2  # intervals to remove

INTERVALS = "doc_id long, fp long, body binary"


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(keys ^ U64(0x5851F42D4C957F2D)) % U64(buckets)).astype(np.int32)


def pack(bucket: np.ndarray, kind: int, columns: list[np.ndarray], data: np.ndarray | None, begins=None, lengths=None) -> pa.RecordBatch:
    """One compressed row for each bucket with its elements of ``columns`` and its strings."""
    order = np.argsort(bucket, kind="stable")
    keys, first = np.unique(bucket[order], return_index=True)
    ends = np.append(first, len(order))[1:]
    columns = [np.ascontiguousarray(c[order]) for c in columns]
    if data is not None:
        begins, lengths = begins[order], lengths[order].astype(np.int32)
    squeeze, bodies = zstandard.ZstdCompressor(level=LEVEL), []
    for b, e in zip(first.tolist(), ends.tolist(), strict=True):
        body = np.int64(e - b).tobytes() + b"".join(c[b:e].tobytes() for c in columns)
        if data is not None:
            body += lengths[b:e].tobytes() + data[spans_gather(begins[b:e], lengths[b:e])].tobytes()
        bodies.append(squeeze.compress(body))
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int32()), pa.array(np.full(len(keys), kind, np.int32)), pa.array(bodies, pa.binary())],
        ["bucket", "kind", "body"],
    )


def unpack(bodies: list[bytes], types: list[str], strings: bool):
    """The columns and, if any, the strings' bytes, begins and lengths of several rows."""
    parts = [[] for _ in types]
    sizes, data = [], []
    opener = zstandard.ZstdDecompressor()
    for body in bodies:
        body = opener.decompress(body)
        n, at = int(np.frombuffer(body, np.int64, 1)[0]), 8
        for k, kind in enumerate(types):
            parts[k].append(np.frombuffer(body, kind, n, at))
            at += n * np.dtype(kind).itemsize
        if strings:
            sizes.append(np.frombuffer(body, np.int32, n, at))
            data.append(np.frombuffer(body, np.uint8, -1, at + 4 * n) if at + 4 * n < len(body) else np.zeros(0, np.uint8))
    columns = [np.concatenate(p) if p else np.zeros(0, kind) for p, kind in zip(parts, types, strict=True)]
    if not strings:
        return columns, None, None, None
    lengths = np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)
    return columns, np.concatenate(data) if data else np.zeros(0, np.uint8), np.cumsum(lengths) - lengths, lengths


def bucket_groups(batches) -> Iterator[dict[int, list[bytes]]]:
    """Bodies by kind for a few whole buckets at a time; the rows come sorted by bucket."""
    held: dict[int, list[bytes]] = {}
    size, last = 0, None
    for batch in batches:
        for bucket, kind, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if bucket != last and size > GROUP_BYTES:
                yield held
                held, size = {}, 0
            last = bucket
            held.setdefault(kind, []).append(body)
            size += len(body) * 3
    if held:
        yield held


def intervals_batch(doc_id: np.ndarray, fp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Intervals to remove, one row for each document with them merged."""
    order = np.lexsort((begin, fp, doc_id))
    doc_id, fp, begin, end = doc_id[order], fp[order], begin[order], end[order]
    new = np.ones(len(order), bool)
    new[1:] = (doc_id[1:] != doc_id[:-1]) | (fp[1:] != fp[:-1])
    first = np.flatnonzero(new)
    pairs = np.stack([begin, end], 1).astype(np.int32)
    bodies = [pairs[b:e].tobytes() for b, e in zip(first.tolist(), np.append(first, len(order))[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_id[first]), pa.array(fp[first].astype(np.int64)), pa.array(bodies, pa.binary())], ["doc_id", "fp", "body"]
    )


def merged(doc_id, fp, begin, end):
    """The intervals with those of a document that overlap or touch joined."""
    order = np.lexsort((end, begin, fp, doc_id))
    doc_id, fp, begin, end = doc_id[order], fp[order], begin[order], end[order]
    if not len(order):
        return doc_id, fp, begin, end
    new = np.ones(len(order), bool)
    new[1:] = (doc_id[1:] != doc_id[:-1]) | (fp[1:] != fp[:-1])
    # The furthest end so far in a document, made comparable across documents by a step.
    step = np.cumsum(new).astype(np.int64) << 33
    upto = np.maximum.accumulate(end + step) - step
    new[1:] |= begin[1:] > upto[:-1]
    first = np.flatnonzero(new)
    return doc_id[first], fp[first], begin[first], upto[np.append(first[1:], len(order)) - 1]


def covered(pairs: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` positions lie in one of the [begin, end) pairs."""
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, pairs[:, 0], 1)
    np.add.at(change, np.minimum(pairs[:, 1], size), -1)
    return np.cumsum(change[:-1]) > 0


def hot_keys(docs: DataFrame, keys_of: Callable[[pa.RecordBatch], np.ndarray], steps_of) -> np.ndarray:
    """Keys of more than one in ``HOT_SHARE`` of all strings, sorted.

    A key with that share of all has it in at least one step of a task, so each step reports
    only such keys, with their counts; a lower bound of a key's total would miss none because
    a hot key's count in the steps that leave it out is below the share there.
    """

    def count(batches):
        for part in steps_of(batches):
            keys, counts = np.unique(keys_of(part), return_counts=True)
            often = counts * HOT_SHARE > 0.5 * counts.sum()
            # Key 0 with the number of strings: the total.
            out = np.append(keys[often].view(np.int64), 0), np.append(counts[often], counts.sum())
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1].astype(np.int64))], ["key", "n"])

    with passing(docs.sparkSession):
        found = stored(docs.mapInArrow(released(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "often")
        total = F.max(F.when(F.col("key") == 0, F.col("n")))
        hot = found.filter((F.col("key") != 0) & (F.col("n") * (2 * HOT_SHARE) > found.agg(total).scalar()))
        return np.sort(np.array([r.key for r in hot.select("key").collect()], np.int64).view(U64))


def remove(docs: DataFrame, intervals: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """Join each document with all its intervals; ``finish`` makes the result of a batch.

    ``docs`` has doc_id (null as ``NO_ID``), fp, text and any further columns; ``finish`` gets a
    record batch of these and an array of [begin, end) pairs for each row. Texts are shuffled
    compressed.
    """
    gathered = intervals.groupBy("doc_id", "fp").agg(F.collect_list("body").alias("bodies"))
    names = [c for c in docs.columns if c != "text"]

    def squeeze(batches):
        for part in steps(batches, "text"):
            tool = zstandard.ZstdCompressor(level=LEVEL)
            bodies = [tool.compress(x.encode()) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.select(names).columns, pa.array(bodies, pa.binary())], [*names, "squeezed"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    small = docs.select(*names, "text").mapInArrow(released(squeeze), f"{kinds}, squeezed binary")
    joined = small.join(gathered, ["doc_id", "fp"], "left")

    def opened(batches):
        tool = zstandard.ZstdDecompressor()
        for part in steps(batches, "squeezed", STEP_BYTES // 4):
            texts = pa.array([tool.decompress(x).decode() for x in part.column("squeezed").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*part.select([*names, "bodies"]).columns, texts], [*names, "bodies", "text"])

    def run(batches):
        for part in steps(opened(batches), "text"):
            pairs = [
                np.frombuffer(b"".join(x), np.int32).reshape(-1, 2) if x else np.zeros((0, 2), np.int32)
                for x in part.column("bodies").to_pylist()
            ]
            yield finish(part, pairs)

    return joined.mapInArrow(released(run), schema)
