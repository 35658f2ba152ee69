"""Repeated word windows by super-k-mer partitioning (operator 7).

Every ``window`` consecutive words hold a minimiser: of the ``m``-word runs in it, the one of
least hash, the leftmost of equals. Consecutive windows with the same minimiser make one
super-k-mer, which travels as one packed string to the minimiser's bucket. Equal windows have
equal minimisers and meet there, where sorting their hashes (128 bits) counts them exactly
and finds the smallest document of each. Windows of hot minimisers travel alone, spread by
their own hash; see ``packed``.

A word is removed if a window over it also starts in a document with a smaller doc_id.
Null and empty texts have no words and lose nothing. A null doc_id comes after all others.
Rows that share a doc_id are one document's: they do not remove words of each other.
Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import packed
from strata.llm.common import NO_ID, U64, Rolling, bucket_rows, long_ids, mixed, released, shuffle_partitions, spans_slices, steps, text_bytes, text_key, word_spans

WINDOW, MINIMISER = 13, 3


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of each ``width`` neighbouring keys, the leftmost of equals."""
    n = len(keys)
    bits = max(1, int(n).bit_length())
    best = (keys >> U64(bits) << U64(bits)) | np.arange(n, dtype=U64)
    done = 1
    while done * 2 <= width:
        best = np.minimum(best[:-done], best[done:])
        done *= 2
    if done < width:
        best = np.minimum(best[: n - width + 1], best[width - done : width - done + n - width + 1])
    return (best & U64((1 << bits) - 1)).astype(np.int64)


class _Cut:
    """The super-k-mers of one step of documents."""

    def __init__(self, part: pa.RecordBatch, window: int, m: int):
        data, offsets = text_bytes(part.column("text"))
        begins, ends, self.counts = word_spans(data, offsets)
        lengths = ends - begins
        # All words, each followed by one space.
        self.begins = np.cumsum(lengths + 1) - (lengths + 1)
        self.ends = self.begins + lengths
        self.data = np.full(int((lengths + 1).sum()), 0x20, np.uint8)
        inside = np.ones(len(self.data), bool)
        inside[self.ends] = False
        covers = np.zeros(len(data) + 1, np.int8)
        covers[begins] += 1
        covers[ends] -= 1
        self.data[inside] = data[np.cumsum(covers[:-1], dtype=np.int8) > 0]
        self.window = window
        n = len(begins)
        self.first = np.zeros(0, np.int64)
        if n < window:
            return
        grams = Rolling(self.data).runs(self.begins[: n - m + 1], self.ends[m - 1 :])
        least = sliding_least(mixed(grams), window - m + 1)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(self.counts))
        valid = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
        if not len(valid):
            return
        at = least[valid]
        new = np.ones(len(valid), bool)
        new[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1)
        run = np.flatnonzero(new)
        self.first = valid[run]  # first window of each super-k-mer
        self.last = valid[np.append(run[1:], len(valid)) - 1]
        self.key = grams[at[run]]
        self.owner = owner[self.first]

    def keys(self) -> np.ndarray:
        return self.key if len(self.first) else np.zeros(0, U64)


def _window_hashes(data, begins, ends, window):
    n = len(begins) - window + 1
    return tuple(Rolling(data, which).runs(begins[:n], ends[window - 1 :]) for which in (0, 1))


def _string_windows(data, first, lengths, b: int, e: int, window: int):
    """Of strings b to e: the string and number of each window, and its hashes."""
    low, high = first[b], first[e - 1] + lengths[e - 1]
    begins, ends, counts = word_spans(data[low:high], np.append(first[b:e], high) - low)
    h1, h2 = _window_hashes(data[low:high], begins, ends, window)
    windows = np.diff(counts) - window + 1
    of = np.repeat(np.arange(e - b), windows)
    number = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = counts[of] + number
    return of + b, number, h1[at], h2[at]


def _later(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which windows also start in a smaller document."""
    order = np.lexsort((doc, h2, h1))
    new = np.ones(len(order), bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    least = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    later = np.zeros(len(order), bool)
    later[order] = doc[order] > least
    return later


def intervals(docs: DataFrame, window: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """Intervals of words to remove for each (doc_id, fp) of ``docs``."""
    spark = docs.sparkSession
    partitions = shuffle_partitions(spark)
    buckets = partitions * packed.BUCKETS
    hot = packed.hot_keys(docs, lambda part: _Cut(part, window, m).keys(), lambda batches: steps(batches, "text"))

    def send(batches):
        for part in steps(batches, "text"):
            cut = _Cut(part, window, m)
            if not len(cut.first):
                continue
            ids, fps = long_ids(part.column("doc_id")), part.column("fp").to_numpy().astype(np.int16)
            doc, fp = ids[cut.owner], fps[cut.owner]
            start = cut.first - cut.counts[cut.owner]
            begins, ends = cut.begins[cut.first], cut.ends[cut.last + window - 1]
            # Identical strings: one of the smallest document stands for the larger ones' too.
            h1, h2 = Rolling(cut.data).runs(begins, ends), Rolling(cut.data, 1).runs(begins, ends)
            known = _later(h1, h2, doc)
            alone = np.isin(cut.key, hot) & ~known
            sent = ~known & ~alone
            yield packed.pack(
                packed.bucket_of(cut.key[sent], buckets), packed.PACKED, [doc[sent], fp[sent], start[sent].astype(np.int32)],
                cut.data, begins[sent], (ends - begins)[sent],
            )
            if alone.any():
                w1, w2 = _window_hashes(cut.data, cut.begins, cut.ends, window)
                count = (cut.last - cut.first + 1)[alone]
                of = np.repeat(np.flatnonzero(alone), count)
                at = np.repeat(cut.first[alone] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                again = _later(w1[at], w2[at], doc[of])
                columns = [doc[of], fp[of], (at - cut.counts[cut.owner[of]]).astype(np.int32), w1[at], w2[at]]
                yield packed.pack(packed.bucket_of(w1[at][~again], buckets), packed.SINGLE, [c[~again] for c in columns], None)
                of, at = of[again], at[again]
                known = np.concatenate([np.flatnonzero(known), of])
                begin = np.concatenate([cut.first[known[: len(known) - len(of)]], at])
                end = np.concatenate([cut.last[known[: len(known) - len(of)]], at]) + window
            else:
                known = np.flatnonzero(known)
                begin, end = cut.first[known], cut.last[known] + window
            base = cut.counts[cut.owner[known]]
            columns = [doc[known], fp[known], (begin - base).astype(np.int32), (end - base).astype(np.int32)]
            yield packed.pack(packed.bucket_of(doc[known].astype(U64), buckets), packed.KNOWN, columns, None)

    def meet(batches):
        for held in packed.bucket_groups(batches):
            found = []
            if packed.PACKED in held:
                (doc, fp, start), data, first, lengths = packed.unpack(held[packed.PACKED], ["i8", "i2", "i4"], True)
                parts = [_string_windows(data, first, lengths, b, e, window) for b, e in spans_slices(lengths)]
                of, number, h1, h2 = (np.concatenate(c) for c in zip(*parts, strict=True))
                later = _later(h1, h2, doc[of])
                of, number = of[later], number[later]
                found.append((doc[of], fp[of], start[of] + number, start[of] + number + window))
            if packed.SINGLE in held:
                (doc, fp, start, h1, h2), *_ = packed.unpack(held[packed.SINGLE], ["i8", "i2", "i4", "u8", "u8"], False)
                later = _later(h1, h2, doc)
                found.append((doc[later], fp[later], start[later], start[later] + window))
            if packed.KNOWN in held:
                found.append(packed.unpack(held[packed.KNOWN], ["i8", "i2", "i4", "i4"], False)[0])
            yield packed.intervals_batch(*packed.merged(*(np.concatenate(c) for c in zip(*found, strict=True))))

    return bucket_rows(docs.mapInArrow(released(send), packed.ROWS), partitions).mapInArrow(released(meet), packed.INTERVALS)


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def keyed(docs: DataFrame, *further: str) -> DataFrame:
    """doc_id with null as ``NO_ID``, a fingerprint that parts rows sharing it, and the text."""
    return docs.select(
        *further,
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        text_key().alias("fp"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def substring_dedup(docs: DataFrame, window: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """Words, words removed and the kept words' hash of every document."""
    docs = keyed(docs)

    def finish(part, pairs):
        data, offsets = text_bytes(part.column("text"))
        begins, ends, counts = word_spans(data, offsets)
        raw, removed, hashes = data.tobytes(), [], []
        for i, own in enumerate(pairs):
            gone = packed.covered(own, int(counts[i + 1] - counts[i]))
            keep = np.flatnonzero(~gone) + counts[i]
            removed.append(int(gone.sum()))
            words = b" ".join(raw[b:e] for b, e in zip(begins[keep].tolist(), ends[keep].tolist(), strict=True))
            hashes.append(hashlib.sha256(words).hexdigest())
        ids = part.column("doc_id").to_numpy()
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=ids == NO_ID), pa.array(np.diff(counts)), pa.array(removed, pa.int64()), pa.array(hashes, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )

    return packed.remove(docs, intervals(docs, window, m), finish, SCHEMA)


def query(spark, sf_dir):
    from strata.llm.common import read_sized

    return substring_dedup(read_sized(spark, sf_dir, "documents"))


ORACLE = r"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0b\f\r]+') AS words FROM documents
), each AS (
    SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM texts
), windows AS (
    SELECT doc_id, pos, string_agg(word, ' ') OVER frame AS key, count(*) OVER frame AS n FROM each
    WINDOW frame AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
), later AS (
    SELECT doc_id, pos FROM windows WHERE n = 13 QUALIFY min(doc_id) OVER (PARTITION BY key) < doc_id
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos FROM later
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS words, count(*) AS n
    FROM each ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, len(t.words)::BIGINT AS n_words, (len(t.words) - coalesce(n, 0))::BIGINT AS n_removed,
    sha256(coalesce(k.words, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (doc_id)
"""
