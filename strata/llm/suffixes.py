"""Repeated byte strings by prefix-free parsing (operator 1).

The rolling hash of every ``trigger`` bytes chooses triggers: of the triggers in a string of
``length`` bytes the one of least hash, the leftmost of equals. Texts are parsed into phrases
that end with a trigger, each followed in the parse by what comes after it. All strings of
``length`` bytes have a first chosen trigger at the same place if they are equal, so a phrase
and the next bytes of the parse go to the bucket of the trigger between them.

There the dictionary (phrases, which all end with the bucket's trigger) and the parse (what
follows them) get suffix arrays: phrases sorted from their ends, so that equal phrase suffixes
are neighbours, and followers sorted from their beginnings, both with the lengths that
neighbours have in common. A string that begins ``a`` bytes before the end of a phrase is a
suffix of length ``a`` and a follower's prefix of length ``length - a``; combining both ranks
puts the strings of a bucket in corpus order with equal ones together, and the first in
(doc_id, start) is the one that stays. Bytes are compared, not hashes, but for hot triggers and
for phrases that a task sees twice, which go by 128-bit hashes; see ``packed``.

A byte is removed if a string of ``length`` bytes over it also starts earlier, in a smaller
doc_id or in the same document. Texts are UTF-8 bytes, null is empty; shorter texts lose
nothing. A null doc_id comes after all others; rows that share a doc_id count as one document,
so equal starts in them are not earlier. Further columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strata.llm import packed
from strata.llm.common import NO_ID, U64, Rolling, bucket_rows, long_ids, released, shuffle_partitions, steps, text_bytes
from strata.llm.substrings import keyed, sliding_least

LENGTH, TRIGGER = 100, 12


class _Parse:
    """The phrases of one step of documents, each with its followers."""

    def __init__(self, part: pa.RecordBatch, length: int, trigger: int):
        self.data, self.offsets = text_bytes(part.column("text"))
        self.length, n = length, len(self.data)
        self.first = np.zeros(0, np.int64)
        self.key = np.zeros(0, U64)
        sizes = np.diff(self.offsets)
        if not (sizes >= length).any():
            return
        self.hashes = Rolling(self.data)
        grams = (self.hashes.sums[trigger:] - self.hashes.sums[:-trigger]) * self.hashes.down[: n - trigger + 1]
        least = sliding_least(grams, length - trigger + 1)
        inside = np.zeros(n + 1, np.int32)  # starts of strings that end in the same text
        long = sizes >= length
        np.add.at(inside, self.offsets[:-1][long], 1)
        np.add.at(inside, self.offsets[1:][long] - length + 1, -1)
        valid = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        at = least[valid]
        new = np.ones(len(valid), bool)
        new[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1)
        run = np.flatnonzero(new)
        self.first = valid[run]
        self.last = valid[np.append(run[1:], len(valid)) - 1]
        self.before = at[run] + trigger - self.first  # bytes to the end of the trigger
        self.key = grams[at[run]]
        self.owner = np.searchsorted(self.offsets, self.first, "right") - 1


def _later(doc: np.ndarray, at: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Which elements have an equal one earlier in (doc, at)."""
    order = np.lexsort((at, doc, *keys))
    new = np.ones(len(order), bool)
    new[1:] = False
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
    later = np.zeros(len(order), bool)
    later[order] = (doc[order] != doc[first]) | (at[order] != at[first])
    return later


def _suffix_array(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the rows, and how many bytes each has in common with the one before."""
    order = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
    common = np.zeros(len(rows), np.int64)
    for b in range(1, len(rows), 1 << 16):
        e = min(len(rows), b + (1 << 16))
        differ = rows[order[b:e]] != rows[order[b - 1 : e - 1]]
        common[b:e] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return order, common


def _ranks(order: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """Numbers of the classes that agree in the first ``least`` bytes."""
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(common < least)
    return number


def repeated(doc, start, before, data, first, lengths, length: int, trigger: int):
    """Runs (row, begin, end) of bytes covered by strings that start earlier in the bucket."""
    order = np.lexsort((start + before, doc))
    doc, start, before, first, lengths = (x[order].astype(np.int64) for x in (doc, start, before, first, lengths))
    after = lengths - before
    n, width = len(doc), length - trigger
    data = np.append(data, np.uint8(0))
    phrases, followers = np.zeros((n, length), np.uint8), np.zeros((n, width), np.uint8)
    back, ahead = np.arange(length, dtype=np.int32), np.arange(width, dtype=np.int32)
    for b in range(0, n, 4096):
        e = min(n, b + 4096)
        middle = (first[b:e] + before[b:e])[:, None]
        phrases[b:e] = np.where(back < before[b:e, None], data[np.maximum(middle - 1 - back, 0)], 0)
        followers[b:e] = np.where(ahead < after[b:e, None], data[np.minimum(middle + ahead, len(data) - 1)], 0)
    dictionary, parse = _suffix_array(phrases), _suffix_array(followers)
    # Strings can repeat only where the best agreements on both sides reach the length.
    best = np.zeros(n, np.int64)
    for rank, common in (dictionary, parse):
        near = common.copy()
        near[:-1] = np.maximum(near[:-1], common[1:])
        best[rank] += near
    alive = best >= length
    flags = np.zeros((n, length + 2), bool)
    for a in range(trigger, length + 1):
        rows = np.flatnonzero(alive & (before >= a) & (after >= length - a))
        if len(rows) < 2:
            continue
        key = _ranks(*dictionary, a)[rows] * (n + 1) + _ranks(*parse, length - a)[rows]
        _, earliest, back = np.unique(key, return_index=True, return_inverse=True)
        other = rows[earliest[back]]
        flags[rows, a] = (doc[rows] != doc[other]) | ((start + before)[rows] != (start + before)[other])
    change = np.diff(flags.astype(np.int8), axis=1)
    row, low = np.nonzero(change == 1)
    _, high = np.nonzero(change == -1)
    stop = start[row] + before[row]
    return order[row], stop - high, stop - (low + 1) + length


def intervals(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER) -> DataFrame:
    """Intervals of bytes to remove for each (doc_id, fp) of ``docs``."""
    partitions = shuffle_partitions(docs.sparkSession)
    buckets = partitions * packed.BUCKETS
    hot = packed.hot_keys(docs, lambda part: _Parse(part, length, trigger).key, lambda batches: steps(batches, "text"))

    def send(batches):
        for part in steps(batches, "text"):
            parse = _Parse(part, length, trigger)
            if not len(parse.first):
                continue
            ids, fps = long_ids(part.column("doc_id")), part.column("fp").to_numpy().astype(np.int16)
            doc, fp = ids[parse.owner], fps[parse.owner]
            base = parse.offsets[parse.owner]
            start, ends = parse.first - base, parse.last + length
            second = Rolling(parse.data, 1)
            h1, h2 = parse.hashes.runs(parse.first, ends), second.runs(parse.first, ends)
            known = _later(doc, start, h2, h1)
            alone = np.isin(parse.key, hot) & ~known
            sent = ~known & ~alone
            columns = [doc[sent], fp[sent], start[sent].astype(np.int32), parse.before[sent].astype(np.int32)]
            yield packed.pack(packed.bucket_of(parse.key[sent], buckets), packed.PACKED, columns, parse.data, parse.first[sent], (ends - parse.first)[sent])
            begin, end, of = parse.first[known], ends[known], np.flatnonzero(known)
            if alone.any():
                count = (parse.last - parse.first + 1)[alone]
                each = np.repeat(np.flatnonzero(alone), count)
                at = np.repeat(parse.first[alone] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                w1, w2 = parse.hashes.runs(at, at + length), second.runs(at, at + length)
                again = _later(doc[each], at - base[each], w2, w1)
                columns = [doc[each], fp[each], (at - base[each]).astype(np.int32), w1, w2]
                yield packed.pack(packed.bucket_of(w1[~again], buckets), packed.SINGLE, [c[~again] for c in columns], None)
                of = np.concatenate([of, each[again]])
                begin, end = np.concatenate([begin, at[again]]), np.concatenate([end, at[again] + length])
            gone = packed.merged(doc[of], fp[of], begin - base[of], end - base[of])
            columns = [gone[0], gone[1], gone[2].astype(np.int32), gone[3].astype(np.int32)]
            yield packed.pack(packed.bucket_of(gone[0].astype(U64), buckets), packed.KNOWN, columns, None)

    def meet(batches):
        for held in packed.bucket_groups(batches):
            found = []
            if packed.PACKED in held:
                (doc, fp, start, before), data, first, lengths = packed.unpack(held[packed.PACKED], ["i8", "i2", "i4", "i4"], True)
                row, begin, end = repeated(doc, start, before, data, first, lengths, length, trigger)
                found.append((doc[row], fp[row], begin, end))
            if packed.SINGLE in held:
                (doc, fp, start, w1, w2), *_ = packed.unpack(held[packed.SINGLE], ["i8", "i2", "i4", "u8", "u8"], False)
                later = _later(doc, start, w2, w1)
                found.append((doc[later], fp[later], start[later], start[later] + length))
            if packed.KNOWN in held:
                found.append(packed.unpack(held[packed.KNOWN], ["i8", "i2", "i4", "i4"], False)[0])
            yield packed.intervals_batch(*packed.merged(*(np.concatenate(c) for c in zip(*found, strict=True))))

    return bucket_rows(docs.mapInArrow(released(send), packed.ROWS), partitions).mapInArrow(released(meet), packed.INTERVALS)


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def suffix_dedup(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER) -> DataFrame:
    """Bytes, bytes removed, removed runs and the remaining bytes' hash of every document."""
    docs = keyed(docs)

    def finish(part, pairs):
        data, offsets = text_bytes(part.column("text"))
        rows = []
        for i, own in enumerate(pairs):
            text = data[offsets[i] : offsets[i + 1]]
            gone = packed.covered(own, len(text))
            spans = int((gone[1:] & ~gone[:-1]).sum()) + bool(len(gone) and gone[0])
            rows.append((len(text), int(gone.sum()), spans, hashlib.sha256(text[~gone].tobytes()).hexdigest()))
        ids = part.column("doc_id").to_numpy()
        kinds = [pa.int64()] * 3 + [pa.string()]
        arrays = [pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=ids == NO_ID), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        )

    return packed.remove(docs, intervals(docs, length, trigger), finish, SCHEMA)


def whole_characters(text: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Of the bytes to remove those whose whole character goes."""
    first = np.flatnonzero((text & 0xC0) != 0x80)
    if not len(first):
        return gone
    all_gone = np.logical_and.reduceat(gone, first)
    return np.repeat(all_gone, np.diff(np.append(first, len(text))))


def without_repeats(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER) -> DataFrame:
    """``documents`` without their repeated strings, cut at whole characters.

    Texts stay UTF-8: a character goes only with all its bytes. A document of which nothing is
    left goes; one that was empty before stays.
    """
    docs = keyed(docs, "lang", "source")

    def finish(part, pairs):
        data, offsets = text_bytes(part.column("text"))
        texts, keep = [], []
        for i, own in enumerate(pairs):
            text = data[offsets[i] : offsets[i + 1]]
            if len(own):
                text = text[~whole_characters(text, packed.covered(own, len(text)))]
            texts.append(text.tobytes().decode())
            keep.append(len(text) > 0 or offsets[i + 1] == offsets[i])
        ids = part.column("doc_id").to_numpy()
        arrays = [pa.array(ids, mask=ids == NO_ID), pa.array(texts, pa.string()), part.column("lang"), part.column("source"), pa.array([len(t) for t in texts], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "text", "lang", "source", "n_chars"]).filter(pa.array(keep, pa.bool_()))

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return packed.remove(docs, intervals(docs, length, trigger), finish, schema)


def query(spark, sf_dir):
    from strata.llm.common import read_sized

    return suffix_dedup(read_sized(spark, sf_dir, "documents"))


ORACLE = """
WITH texts AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits FROM documents
), strings AS (
    SELECT doc_id, pos, substr(digits, 2 * pos + 1, 200) AS key
    FROM (SELECT doc_id, digits, unnest(range(0, length(digits) // 2 - 99)) AS pos FROM texts)
), later AS (
    SELECT doc_id, pos FROM strings
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) > 1
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(pos, pos + 100)) AS pos FROM later
), spans AS (
    SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE before IS NULL OR before < pos - 1) AS spans
    FROM (SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM gone) GROUP BY doc_id
), kept AS (
    SELECT doc_id, string_agg(substr(digits, 2 * pos + 1, 2), '' ORDER BY pos) AS digits
    FROM (SELECT doc_id, digits, unnest(range(0, length(digits) // 2)) AS pos FROM texts SEMI JOIN gone USING (doc_id)) t
    ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, (length(t.digits) // 2)::BIGINT AS n_bytes, coalesce(s.n, 0)::BIGINT AS n_removed,
    coalesce(s.spans, 0)::BIGINT AS n_spans,
    sha256(unhex(CASE WHEN s.n IS NULL THEN t.digits ELSE coalesce(k.digits, '') END)) AS kept_sha256
FROM texts t LEFT JOIN spans s USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
