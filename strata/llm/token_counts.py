"""Token counts by a compiled finite-state transducer (operator 3).

A pair of neighbouring characters that no vocabulary piece holds is never merged, so the
text falls apart there. The transducer compiled from a vocabulary has the open segment as
its state: a symbol that can join the one before it extends the segment and emits nothing,
any other symbol closes it, emits the tokens of the closed segment and opens the next. The
emission of a segment is compiled once, with the tokenizer's library, and kept.

A text is read in chunks of ``CHUNK`` symbols without knowing the state it begins in. Such a
chunk is a map from the open segment to (tokens, open segment): where its first segment
opens, what it emits between, and where its last segment opens. Two neighbouring maps
compose to one by closing the segment across their seam; a parallel prefix scan, halving the
number of maps at each level, composes all chunks of a text.

Null and empty texts have 0 bytes and 0 tokens. Rows are answered one by one: repeated rows
and ids, null ids and further columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strata.llm.common import Rolling, mixed, released, steps, text_bytes

CHUNK = 1 << 16
#: Compiled emissions a task keeps; beyond that it starts anew.
KEPT = 2_000_000
MARK = 0x2581


class Transducer:
    """Deterministic transducer of a SentencePiece BPE vocabulary, transitions annotated with tokens."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [
            self.library.id_to_piece(i)
            for i in range(self.library.vocab_size())
            if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))
        ]
        self.width = [len(self.library.id_to_piece(i)) for i in range(self.library.vocab_size())]
        alphabet = sorted({ord(c) for p in pieces if len(p) > 1 for c in p} | {MARK})
        self.classes = np.zeros(0x110001, np.uint16)  # one more for a symbol outside Unicode
        self.classes[alphabet] = np.arange(1, len(alphabet) + 1)
        self.joins = np.zeros((len(alphabet) + 1,) * 2, bool)
        for piece in pieces:
            codes = self.classes[[ord(c) for c in piece]]
            self.joins[codes[:-1], codes[1:]] = True
        # A character of class 0 shields a segment from the mark put before every text.
        self.shield = next(c for c in "\n\x01\x02\x03" if not self.classes[ord(c)])
        self.shielded = len(self.library.encode(self.shield))
        probe = f" a  b{self.shield}{self.shield} c "
        if self.library.decode(self.library.encode(probe)) != probe:
            raise ValueError("the vocabulary changes texts before it splits them")
        self.known, self.emits = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def symbols(self, column: pa.Array, literal: int = MARK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points with a mark before each text and for each space, where texts begin, and their bytes.

        A mark in the text itself becomes ``literal``.
        """
        data, offsets = text_bytes(column)
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        if literal != MARK:
            codes = np.where(codes == MARK, np.uint32(literal), codes)
        leads = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=leads[1:])
        at = leads[offsets]
        filled = np.diff(offsets) > 0
        codes = np.insert(codes, at[:-1][filled], MARK)
        codes[codes == 0x20] = MARK
        begins = at + np.concatenate([[0], np.cumsum(filled)])
        return codes, begins, np.diff(offsets)

    def opens(self, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Whether the transition on each symbol closes the open segment."""
        classes = self.classes[codes]
        new = np.ones(len(codes) + 1, bool)
        new[1:-1] = ~self.joins[classes[:-1], classes[1:]]
        new[begins] = True
        return new[:-1]

    def emitted(self, codes: np.ndarray, hashes: Rolling, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens emitted when each of these segments closes."""
        if not len(begins):
            return np.zeros(0, np.int64)
        keys, first, back = np.unique(hashes.runs(begins, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, keys), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[at] != keys) if len(self.known) else np.arange(len(keys))
        if len(new):
            texts = [
                self.shield + codes[b:e].tobytes().decode("utf-32-le").replace(chr(MARK), " ")
                for b, e in zip(begins[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            ]
            tokens = [len(x) - self.shielded for x in self.library.encode(texts, num_threads=1)]
            if len(self.known) > KEPT:
                keep = np.isin(self.known, keys)
                self.known, self.emits = self.known[keep], self.emits[keep]
            merged = np.concatenate([self.known, keys[new]])
            order = np.argsort(merged)
            self.known, self.emits = merged[order], np.concatenate([self.emits, tokens])[order]
            at = np.searchsorted(self.known, keys)
        return self.emits[at][back]

    def count(self, column: pa.Array, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of each text."""
        codes, begins, sizes = self.symbols(column)
        if not len(codes):
            return sizes, np.zeros(len(sizes), np.int64)
        hashes = Rolling(mixed(codes.astype(np.uint64) + np.uint64(1)))
        opened = np.flatnonzero(self.opens(codes, begins))

        # A map for each chunk of each text: first and last segment it opens, tokens between.
        lengths = np.diff(begins)
        chunks = -(-lengths // chunk)
        owner = np.repeat(np.arange(len(lengths)), chunks)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        left = begins[owner] + number * chunk
        right = np.minimum(left + chunk, begins[owner + 1])
        low, high = np.searchsorted(opened, left), np.searchsorted(opened, right)
        some = high > low
        last = np.maximum(high - 1, 0)
        closed = np.zeros(len(opened), bool)  # closed within the chunk that opened it
        closed[:-1] = True
        closed[last[some]] = False
        inner = np.flatnonzero(closed)
        sums = np.zeros(len(opened) + 1, np.int64)
        tokens = np.zeros(len(opened), np.int64)
        tokens[inner] = self.emitted(codes, hashes, opened[inner], opened[inner + 1])
        np.cumsum(tokens, out=sums[1:])
        first = np.where(some, opened[np.minimum(low, len(opened) - 1)], -1)
        final = np.where(some, opened[last], -1)
        total = np.where(some, sums[last] - sums[np.minimum(low, len(opened))], 0)

        while len(owner) > len(np.unique(owner)):  # one level of the scan
            rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
            head = np.flatnonzero(rank % 2 == 0)
            pair = head[(head + 1 < len(owner))]
            pair = pair[owner[pair + 1] == owner[pair]]
            seam = pair[(final[pair] >= 0) & (first[pair + 1] >= 0)]
            total[seam] += self.emitted(codes, hashes, final[seam], first[seam + 1])
            total[pair] += total[pair + 1]
            first[pair] = np.where(first[pair] >= 0, first[pair], first[pair + 1])
            final[pair] = np.where(final[pair + 1] >= 0, final[pair + 1], final[pair])
            owner, first, final, total = owner[head], first[head], final[head], total[head]

        result = np.zeros(len(lengths), np.int64)
        result[owner] = total + self.emitted(codes, hashes, final, begins[owner + 1])
        return sizes, result


def token_counts(docs: DataFrame, model: str, limit: int) -> DataFrame:
    """``doc_id``, bytes, tokens and whether they exceed ``limit``, for every whole text."""

    def run(batches):
        transducer = Transducer(model)
        for part in steps(batches, "text"):
            sizes, tokens = transducer.count(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        released(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )


def query(spark, sf_dir):
    import public_tokenizers

    from strata.llm.common import read

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)
