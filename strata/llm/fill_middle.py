"""Fill-in-middle: texts cut at two token boundaries and put together in another order.

The ends of all tokens of a task's step are held as one set of byte positions, in containers of
2**16 positions each. A container is an array of its positions, a bitmap or a list of runs,
whichever is smallest, and the set keeps how many positions lie before each container. The cut
after k tokens of a text is the position of rank (positions before the text) + k - 1: a search
among the cumulative cardinalities finds its container, and a select inside gives the offset.

A null text is empty, an empty one is plain. A null doc_id hashes like an empty one. Rows are
handled one by one, so repeated rows give repeated results; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import read, released, steps, text_bytes

# The marks before each part, and the shares of plain and of suffix-first texts.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = "<[PSM]>"
PLAIN_FROM = 90
SPM_BELOW = 20

#: Positions of one container.
SPAN = 1 << 16
ARRAY, BITMAP, RUNS = range(3)

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True


class Container:
    """Up to 2**16 sorted positions below ``SPAN`` in the form that takes fewest bytes."""

    def __init__(self, lows: np.ndarray):
        first = np.flatnonzero(np.append(True, np.diff(lows) != 1))
        sizes = {ARRAY: 2 * len(lows), BITMAP: SPAN // 8, RUNS: 4 * len(first)}
        self.kind = min(sizes, key=sizes.get)
        self.size = len(lows)
        if self.kind == ARRAY:
            self.lows = lows.astype(np.uint16)
        elif self.kind == BITMAP:
            bits = np.zeros(SPAN, np.uint8)
            bits[lows] = 1
            self.words = np.packbits(bits, bitorder="little").view(np.uint64)
            self.before = _counted(np.bitwise_count(self.words))
        else:
            self.begins = lows[first].astype(np.uint16)
            self.before = np.append(first, len(lows))

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """The positions of these ranks, counted from 0."""
        if self.kind == ARRAY:
            return self.lows[ranks].astype(np.int64)
        at = np.searchsorted(self.before, ranks, "right") - 1
        inside = ranks - self.before[at]
        if self.kind == RUNS:
            return self.begins[at] + inside
        bits = np.unpackbits(self.words[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return at * 64 + (np.cumsum(bits, axis=1) > inside[:, None]).argmax(axis=1)

    def rank(self, lows: np.ndarray) -> np.ndarray:
        """How many positions are not above these."""
        if self.kind == ARRAY:
            return np.searchsorted(self.lows, lows, "right")
        if self.kind == RUNS:
            at = np.searchsorted(self.begins, lows, "right") - 1
            known = np.maximum(at, 0)
            inside = np.minimum(lows - self.begins[known].astype(np.int64) + 1, np.diff(self.before)[known])
            return np.where(at < 0, 0, self.before[known] + inside)
        word, bit = lows >> 6, (lows & 63).astype(np.uint64)
        upto = self.words[word] << (np.uint64(63) - bit)
        return self.before[word] + np.bitwise_count(upto)


class BoundarySet:
    """Sorted distinct positions by container, with the number of positions before each."""

    def __init__(self, positions: np.ndarray):
        highs = positions >> 16
        first = np.flatnonzero(np.append(True, np.diff(highs) != 0)) if len(positions) else np.zeros(0, np.int64)
        self.highs = highs[first]
        self.before = np.append(first, len(positions))
        self.containers = [
            Container(positions[b:e] & (SPAN - 1)) for b, e in zip(self.before[:-1].tolist(), self.before[1:].tolist(), strict=True)
        ]

    def __len__(self) -> int:
        return int(self.before[-1])

    def _each(self, at: np.ndarray, values: np.ndarray, ask) -> np.ndarray:
        """``ask(container, values)`` for the values that belong to each container."""
        out = np.zeros(len(values), np.int64)
        order = np.argsort(at, kind="stable")
        edges = np.flatnonzero(np.append(True, np.diff(at[order]) != 0)) if len(at) else np.zeros(0, np.int64)
        for b, e in zip(edges.tolist(), np.append(edges, len(at))[1:].tolist(), strict=True):
            rows = order[b:e]
            out[rows] = ask(self.containers[at[rows[0]]], values[rows])
        return out

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """The positions of these ranks, counted from 0."""
        at = np.searchsorted(self.before, ranks, "right") - 1
        return (self.highs[at] << 16) + self._each(at, ranks - self.before[at], Container.select)

    def rank(self, positions: np.ndarray) -> np.ndarray:
        """How many positions of the set are not above these."""
        at = np.searchsorted(self.highs, positions >> 16, "right") - 1
        out = np.zeros(len(positions), np.int64)
        inside = np.flatnonzero((at >= 0) & (self.highs[np.maximum(at, 0)] == positions >> 16)) if len(self) else []
        beyond = at >= 0
        out[beyond] = self.before[at[beyond] + 1]
        if len(inside):
            found = self._each(at[inside], positions[inside] & (SPAN - 1), Container.rank)
            out[inside] = self.before[at[inside]] + found
        return out


def _counted(sizes: np.ndarray) -> np.ndarray:
    """How many lie before each, and at the end how many in all."""
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def token_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions behind each token: a run of letters A-Z, a-z, or any other character."""
    letter = _LETTERS[data]
    ends = np.zeros(len(data) + 1, bool)
    ends[1:-1] = ((data[1:] & 0xC0) != 0x80) & ~(letter[:-1] & letter[1:]) if len(data) else False
    ends[offsets] = True
    ends[0] = False
    return np.flatnonzero(ends)


def _rearranged(part: pa.RecordBatch) -> pa.RecordBatch:
    column = part.column("text")
    data, offsets = text_bytes(column)
    raw = data.tobytes()
    begins, stops = offsets[:-1], offsets[1:]
    bounds = BoundarySet(token_ends(data, offsets))
    before = bounds.rank(offsets)
    n = np.diff(before)

    marked = pc.fill_null(pc.match_substring_regex(column, MARKS), False).to_numpy(zero_copy_only=False)
    h1, h2, h3, h4 = (part.column(f"h{i}").to_numpy() for i in range(1, 5))
    plain = (n == 0) | marked | (h3 % 100 >= PLAIN_FROM)
    spm = ~plain & (h4 % 100 < SPM_BELOW)
    cuts = []
    for units in (np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))):
        found = begins.copy()
        some = np.flatnonzero(units)
        found[some] = bounds.select(before[some] + units[some] - 1)
        cuts.append(found)

    characters = _counted((data & 0xC0) != 0x80)
    prefix_chars = characters[cuts[0]] - characters[begins]
    middle_chars = characters[cuts[1]] - characters[cuts[0]]
    outputs = []
    for a, b, c, d, whole, last in zip(
        begins.tolist(), cuts[0].tolist(), cuts[1].tolist(), stops.tolist(), plain.tolist(), spm.tolist(), strict=True
    ):
        if whole:
            outputs.append(raw[a:d])
        elif last:
            outputs.append(b"".join((SUFFIX, raw[c:d], PREFIX, raw[a:b], MIDDLE, raw[b:c])))
        else:
            outputs.append(b"".join((PREFIX, raw[a:b], SUFFIX, raw[c:d], MIDDLE, raw[b:c])))
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    return pa.RecordBatch.from_arrays(
        [
            part.column("doc_id"),
            pa.array(n),
            pa.array(form.tolist(), pa.string()),
            pa.array(prefix_chars, mask=plain),
            pa.array(middle_chars, mask=plain),
            pa.array(outputs, pa.binary()).cast(pa.string()),
        ],
        ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def fill_in_middle(docs: DataFrame, seed: str = "1") -> DataFrame:
    """Every document as ``output``, in the ``form`` that the hash of seed and doc_id picks."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    groups = [F.conv(F.substring(key, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]

    def run(batches):
        for part in steps(batches, "text"):
            yield _rearranged(part)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *groups).mapInArrow(released(run), SCHEMA)


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text that ``fill_in_middle`` made ``output`` of."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, MARKS, -1)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )


def query(spark, sf_dir):
    made = fill_in_middle(read(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(), 256).alias("restored_sha256"),
    )


ORACLE = """
    WITH hashed AS (
        SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
        FROM documents
    ), cut AS (
        SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS tokens,
            CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
            CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
        FROM hashed
    ), chosen AS (
        SELECT doc_id, text, tokens, CAST(len(tokens) AS BIGINT) AS n,
            least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a,
            greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b,
            CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain'
                WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM cut
    ), parts AS (
        SELECT doc_id, text, n, form, array_to_string(list_slice(tokens, 1, a), '') AS prefix,
            array_to_string(list_slice(tokens, a + 1, b), '') AS middle,
            array_to_string(list_slice(tokens, b + 1, n), '') AS suffix
        FROM chosen
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
        sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
            WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
        sha256(text) AS restored_sha256
    FROM parts
"""
