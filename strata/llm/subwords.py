"""SentencePiece encoding with seeded merge-dropout, and decoding (operator 2).

Encoding merges symbols of a segment (see ``token_counts``: text between two characters that
no piece joins) as the model's ranks say: an agenda holds all neighbouring pairs that make a
piece, the best rank first, the leftmost of equals. With dropout every candidate merge is
skipped with probability ``dropout``, decided by a hash of the seed, the document, the segment's
number in it and the candidate, so the same key gives the same segmentation on any machine and
in any order, and every occurrence of a word has decisions of its own. A task keeps each
segment's merging without dropout and its candidates; an occurrence that skips none of them has
these ids, every other one is merged by itself. Many segments are merged all at once: each round
takes the best candidate of every open segment.

Characters without a piece, and U+2581 itself, become byte pieces, so decoding gives back the
text exactly, whatever was skipped. Without dropout the ids are those of the model's library,
but for U+2581, which the library reads as a space. Null and empty texts have no ids. A null
doc_id draws as an id of its own; rows are answered one by one, so repeated rows and ids and
further columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strata.llm.common import U64, Rolling, long_ids, mixed, released, spans_gather, spans_slices, steps, text_bytes
from strata.llm.token_counts import KEPT, MARK, Transducer

SEED, DROPOUT = 20, 0.1
#: Segments of more symbols use the agenda one by one.
LONG = 64
#: Symbols or candidates worked on together.
SLICE = 1 << 18
_NONE = np.int64(2**62)
#: Stands for U+2581 in a text, which is no space.
LITERAL = 0x110000


class Codec:
    """A model's merges as sorted tables, and its pieces as bytes."""

    def __init__(self, model: str, dropout: float = DROPOUT, seed: int = SEED):
        self.cutter = Transducer(model)
        library = self.cutter.library
        self.size = library.vocab_size()
        self.skip = U64(min(int(dropout * 2.0**64), 2**64 - 1))
        self.seed = U64((seed * 0x9E3779B97F4A7C15 + 1) % 2**64)
        pieces = [library.id_to_piece(i) for i in range(self.size)]
        byte = {int(p[3:5], 16): i for i, p in enumerate(pieces) if library.is_byte(i)}
        self.byte = np.array([byte[b] for b in range(256)], np.int32)
        plain = [i for i in range(self.size) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))]
        ids = {pieces[i]: i for i in plain}
        # Characters that pieces hold but are no pieces themselves get symbols beyond the ids.
        extra = sorted({c for p in ids for c in p} - ids.keys())
        symbols = ids | {c: self.size + k for k, c in enumerate(extra)}
        self.char = np.full(LITERAL + 1, -1, np.int32)
        for c in symbols:
            if len(c) == 1:
                self.char[ord(c)] = symbols[c]
        self.span = self.size + len(extra) + 1
        merges = {}
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                a, b = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if a is not None and b is not None:
                    merges[a * self.span + b] = i
        self.pairs = np.array(sorted(merges), np.int64)
        self.merged = np.array([merges[k] for k in self.pairs.tolist()], np.int64)
        scores = np.array([library.get_score(i) for i in range(self.size)])
        self.rank = np.zeros(self.size, np.int64)
        self.rank[np.argsort(-scores, kind="stable")] = np.arange(self.size)
        # Bytes of each piece, for decoding; symbols without an id are spelt by their bytes.
        spelt = set(plain)
        bodies = [
            bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode() if i in spelt else b""
            for i, p in enumerate(pieces)
        ]
        self.lengths = np.array([len(b) for b in bodies], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bodies = np.frombuffer(b"".join(bodies), np.uint8)
        self._forget()

    def _forget(self) -> None:
        """Segments' hashes, sorted; where their plain ids and candidates are; these."""
        self.keys, self.spans = np.zeros(0, U64), np.zeros((0, 4), np.int64)
        self.ids, self.candidates = np.zeros(0, np.int32), np.zeros(0, U64)

    def _merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        key = np.where((left >= 0) & (right >= 0), left * np.int64(self.span) + right, -1)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], -1)

    @staticmethod
    def _candidate(left: np.ndarray, right: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """A candidate as one number: symbols at ``left`` and ``right`` of a segment make ``piece``."""
        return (left.astype(U64) << U64(42)) ^ (right.astype(U64) << U64(21)) ^ piece.astype(U64)

    def _skipped(self, key: np.ndarray, candidate: np.ndarray) -> np.ndarray:
        """Whether the keyed hash skips a candidate."""
        return mixed(mixed(key ^ self.seed ^ candidate)) < self.skip

    def agenda(self, symbols: list[int], key: int, found: list | None = None) -> list[int]:
        """The symbols of one segment merged from a heap of candidates.

        With ``found`` no candidate is skipped and all are added to it.
        """
        n = len(symbols)
        symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple] = []

        def propose(lefts, rights):
            a, b = np.array([symbols[i] for i in lefts], np.int64), np.array([symbols[i] for i in rights], np.int64)
            made = self._merge(a, b)
            lefts, rights = np.array(lefts), np.array(rights)
            candidate = self._candidate(lefts, rights, made)
            if found is None:
                skipped = self._skipped(np.full(len(made), key, U64), candidate)
            else:
                skipped = np.zeros(len(made), bool)
                found.extend(candidate[made >= 0].tolist())
            for k in np.flatnonzero((made >= 0) & ~skipped).tolist():
                item = int(made[k])
                heapq.heappush(heap, (int(self.rank[item]), int(lefts[k]), int(rights[k]), symbols[lefts[k]], symbols[rights[k]], item))

        if n > 1:
            propose(range(n - 1), range(1, n))
        while heap:
            _, left, right, a, b, item = heapq.heappop(heap)
            if symbols[left] != a or symbols[right] != b or after[left] != right:
                continue
            symbols[left], symbols[right] = item, None
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            near = [(before[left], left)] * (before[left] >= 0) + [(left, after[left])] * (after[left] < n)
            if near:
                propose(*zip(*near, strict=True))
        return [s for s in symbols if s is not None]

    def _rounds(self, codes: np.ndarray, begins: np.ndarray, ends: np.ndarray, keys: np.ndarray, found: list | None = None):
        """Symbols of many segments, merged round by round; the source position and count too.

        With ``found`` no candidate is skipped and all are added to it, with their segments.
        """
        lengths = ends - begins
        index = spans_gather(begins, lengths)
        symbol = self.char[codes[index]].astype(np.int64)
        total, first = len(symbol), np.cumsum(lengths) - lengths
        local = np.arange(total) - np.repeat(first, lengths)
        key = np.repeat(keys if found is None else np.arange(len(keys)), lengths)
        after, before = np.arange(1, total + 1), np.arange(-1, total - 1)
        after[first + lengths - 1], before[first] = -1, -1
        made, order = np.full(total, -1, np.int64), np.full(total, _NONE)
        alive = np.ones(total, bool)

        def propose(at):
            at = at[after[at] >= 0]
            made[at] = self._merge(symbol[at], symbol[after[at]])
            at = at[made[at] >= 0]
            candidate = self._candidate(local[at], local[after[at]], made[at])
            if found is None:
                at = at[~self._skipped(key[at], candidate)]
            else:
                found.append((key[at], candidate))
            order[at] = self.rank[made[at]] << np.int64(32) | at

        everything = np.arange(total)
        propose(everything)
        members, starts = everything, first
        while len(starts):
            best = np.minimum.reduceat(order[members], starts)
            going = best < _NONE
            left = best[going] & np.int64(2**32 - 1)
            right = after[left]
            symbol[left] = made[left]
            alive[right] = False
            order[right] = order[left] = _NONE
            after[left] = after[right]
            tail = left[after[left] >= 0]
            before[after[tail]] = tail
            head = before[left]
            head = head[head >= 0]
            order[head] = _NONE
            propose(np.concatenate([left, head]))
            sizes = np.diff(np.append(starts, len(members)))
            members = members[np.repeat(going, sizes)]
            starts = np.cumsum(sizes[going]) - sizes[going]
        counts = np.add.reduceat(alive.astype(np.int64), first) if total else np.zeros(0, np.int64)
        return symbol[alive], index[alive], counts

    def encode_segments(self, codes, begins, ends, keys, found: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments, one after the other, and how many each has; see ``_rounds`` for ``found``."""
        lengths = ends - begins
        short = np.flatnonzero(lengths <= LONG)
        own = None if found is None else []
        symbol, index, counts = self._rounds(codes, begins[short], ends[short], keys[short], own)
        if found is not None:
            found.extend((short[segment], candidate) for segment, candidate in own)
        of = np.repeat(short, counts)
        for i in np.flatnonzero(lengths > LONG).tolist():
            own = None if found is None else []
            part = self.agenda(self.char[codes[begins[i] : ends[i]]].tolist(), int(keys[i]), own)
            if found is not None:
                found.append((np.full(len(own), i), np.array(own, U64)))
            widths = np.array([1 if s < 0 or s >= self.size else self.cutter.width[s] for s in part])
            symbol = np.append(symbol, part)
            index = np.append(index, begins[i] + np.cumsum(widths) - widths)
            of = np.append(of, np.full(len(part), i))
        order = np.argsort(of, kind="stable")
        symbol, index, of = symbol[order], index[order], of[order]
        # A symbol without an id is one character: its bytes.
        strange = (symbol < 0) | (symbol >= self.size)
        if strange.any():
            chars = codes[index[strange]]
            chars = np.where(chars == LITERAL, MARK, chars).astype(np.uint32)
            raw, at = text_bytes(pa.array(list(chars.tobytes().decode("utf-32-le"))))
            width = np.ones(len(symbol), np.int64)
            width[strange] = np.diff(at)
            spread = np.repeat(symbol, width)
            spread[np.repeat(strange, width)] = self.byte[raw]
            symbol, of = spread, np.repeat(of, width)
        return symbol.astype(np.int32), np.bincount(of, minlength=len(begins))

    def _learn(self, codes, begins, ends, keys) -> None:
        """Keep the plain ids and the candidates of segments not seen before."""
        found: list = []
        ids, counts = self.encode_segments(codes, begins, ends, keys, found)
        of = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        candidates = np.concatenate([f[1] for f in found]) if found else np.zeros(0, U64)
        number = np.bincount(of, minlength=len(begins))
        spans = [len(self.ids) + np.cumsum(counts) - counts, counts, len(self.candidates) + np.cumsum(number) - number, number]
        joined = np.concatenate([self.keys, keys])
        order = np.argsort(joined)
        self.keys, self.spans = joined[order], np.concatenate([self.spans, np.stack(spans, 1)])[order]
        self.ids = np.concatenate([self.ids, ids])
        self.candidates = np.concatenate([self.candidates, candidates[np.argsort(of, kind="stable")]])

    def encode(self, column: pa.Array, doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and where each text's begin."""
        codes, begins, _ = self.cutter.symbols(column, literal=LITERAL)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(begins), np.int64)
        opened = np.flatnonzero(self.cutter.opens(codes, begins))
        ends = np.append(opened[1:], len(codes))
        before = np.searchsorted(opened, begins)
        number = np.arange(len(opened)) - np.repeat(before[:-1], np.diff(before))
        doc = np.repeat(doc_ids, np.diff(before)).astype(U64)
        keys = mixed(mixed(doc + self.seed) + number.astype(U64))
        unique, first, back = np.unique(Rolling(mixed(codes.astype(U64) + U64(1))).runs(opened, ends), return_index=True, return_inverse=True)
        if len(self.keys) > KEPT:
            self._forget()
        new = np.flatnonzero(~np.isin(unique, self.keys))
        if len(new):
            self._learn(codes, opened[first[new]], ends[first[new]], unique[new])
        spans = self.spans[np.searchsorted(self.keys, unique)][back]
        # Occurrences that skip a candidate of the plain merging are merged by themselves.
        varied = np.zeros(len(opened), bool)
        for b, e in spans_slices(spans[:, 3], SLICE):
            own = spans_gather(spans[b:e, 2], spans[b:e, 3])
            of = np.repeat(np.arange(b, e), spans[b:e, 3])
            varied[of[self._skipped(keys[of], self.candidates[own])]] = True
        varied = np.flatnonzero(varied)
        source, begin, counts = [self.ids], spans[:, 0].copy(), spans[:, 1].copy()
        upto = len(self.ids)
        for b, e in spans_slices((ends - opened)[varied], SLICE):
            some = varied[b:e]
            ids, counts[some] = self.encode_segments(codes, opened[some], ends[some], keys[some])
            begin[some] = upto + np.cumsum(counts[some]) - counts[some]
            source.append(ids)
            upto += len(ids)
        tokens = np.concatenate([[0], np.cumsum(counts)])
        return np.concatenate(source)[spans_gather(begin, counts)], tokens[before]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts, and where each begins; the mark before each text is left out."""
        sizes = self.lengths[ids]
        data = self.bodies[spans_gather(self.begins[ids], sizes)]
        upto = np.concatenate([[0], np.cumsum(sizes)])[offsets]
        marks = upto[:-1][np.diff(upto) > 0]
        keep = np.ones(len(data), bool)
        keep[marks] = False
        return data[keep], upto - np.concatenate([[0], np.cumsum(np.diff(upto) > 0)])


SCHEMA = "doc_id long, n_bytes long, n_tokens long, round_trip boolean, ids array<int>"


def encode(docs: DataFrame, model: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """Token ids of every whole text, and whether they decode to exactly its bytes."""

    def run(batches):
        codec = Codec(model, dropout, seed)
        for part in steps(batches, "text"):
            column = part.column("text")
            ids, offsets = codec.encode(column, long_ids(part.column("doc_id")))
            data, at = text_bytes(column)
            back, ends = codec.decode(ids, offsets)
            same = np.diff(ends) == np.diff(at)
            if len(back) == len(data) and same.all():
                wrong = np.flatnonzero(back != data)
                same[np.searchsorted(at, wrong, "right") - 1] = False
            else:
                same = np.array([data[at[i] : at[i + 1]].tobytes() == back[ends[i] : ends[i + 1]].tobytes() for i in range(len(same))])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(at)), pa.array(np.diff(offsets)), pa.array(same), lists],
                ["doc_id", "n_bytes", "n_tokens", "round_trip", "ids"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(released(run), SCHEMA)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id`` and ``text`` of rows with token ids; ids of other seeds decode alike."""

    def run(batches):
        codec = Codec(model)
        for batch in batches:
            column = batch.column("ids").fill_null([]) if batch.column("ids").null_count else batch.column("ids")
            offsets = np.asarray(column.offsets).astype(np.int64)
            ids = column.values.to_numpy()[offsets[0] : offsets[-1]]
            data, at = codec.decode(ids, offsets - offsets[0])
            raw = data.tobytes()
            texts = [raw[b:e].decode("utf-8", "replace") for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(released(run), "doc_id long, text string")


def query(spark, sf_dir):
    import public_tokenizers

    from strata.llm.common import read

    return encode(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
