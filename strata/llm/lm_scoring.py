"""Scores of all texts under a causal self-attention model of subword ids (operator 8).

The model (see ``attention``) is learnt from the documents that are not held out:

1. Each task step lower-cases its texts, splits them to words, cuts each distinct word to
   subword ids once and writes the step as one packed row, a *chunk*, beside its word counts.
2. Word counts are summed by word and each chunk gets its words' counts back.
3. Subword frequencies choose the inputs that get a row of their own in a table of what follows
   them; the rows are counted over all training tokens. Their size is bounded by the vocabulary.
4. Weights are trained in one pass over all training tokens: documents are dealt by the hash of
   their id to ``TURNS`` turns; the gradients of a turn's windows are summed over all tasks, then
   Adam takes one step. Each token is predicted once, and it does not matter how documents are
   dealt to tasks.
5. Every token of every text is scored once, in overlapping windows of masked attention that begin
   with its text.

A text is its words joined by single spaces and one end, so white space does not matter, and
``score`` is the log10 probability of the subword ids and the end. The base score is that of a
word unigram with one added to each count.

Null and empty texts are an end alone. A null doc_id is not held out. Rows are scored one by
one: repeated rows and ids count as documents of their own, further columns are ignored. An
empty table gives no rows; without training documents all counts are 0 and the model is
uniform within what its tables give. Equal words are found by 64-bit hashes.
"""

from __future__ import annotations

import math
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import attention, packed
from strata.llm.common import NO_ID, U64, bucket_rows, keep_pages, long_ids, lower, mixed, released, shuffle_partitions, spans_gather, steps, text_bytes, word_hashes, word_spans
from strata.session import discard, scratch_path

MODULUS, REMAINDER = 7, 2
#: Inputs with a row of their own, and one for all others.
ROWS = 1024
#: Steps of training, their rate, and blocks whose gradient is computed at a time.
TURNS, LEARNING, MINIBATCH = 8, 0.05, 128
CHUNK_BYTES = 2 << 20
CHUNK, WORDS, COUNTS = 0, 1, 2
#: Words whose ids a task keeps.
KEPT = 500_000
#: Input rows of a bucket of pairs, and pairs that a task sums before it sends them.
GROUP, SUMMED = 8, 1 << 20


def held_out(doc_id: int) -> bool:
    return doc_id != NO_ID and zlib.crc32(str(doc_id).encode()) % MODULUS == REMAINDER


class _Chunk:
    """One packed row: documents as sequences of words, words as subword ids."""

    FIELDS = (("doc", "i8"), ("held", "?"), ("words", "i4"), ("word", "u4"), ("width", "u4"), ("ids", "u2"))

    def __init__(self, **fields):
        self.__dict__.update(fields)

    def pack(self) -> bytes:
        parts = [np.ascontiguousarray(getattr(self, name).astype(kind)) for name, kind in self.FIELDS]
        head = np.array([len(p) for p in parts], np.int64).tobytes()
        return zstandard.ZstdCompressor(level=3).compress(head + b"".join(p.tobytes() for p in parts))

    @classmethod
    def unpack(cls, body: bytes) -> _Chunk:
        body = zstandard.ZstdDecompressor().decompress(body)
        sizes, at, fields = np.frombuffer(body, np.int64, len(cls.FIELDS)), 8 * len(cls.FIELDS), {}
        for (name, kind), n in zip(cls.FIELDS, sizes.tolist(), strict=True):
            fields[name] = np.frombuffer(body, kind, n, at)
            at += n * np.dtype(kind).itemsize
        return cls(**fields)

    def only(self, kept: np.ndarray) -> _Chunk:
        """The chunk with some of its documents."""
        fields = {"doc": self.doc[kept], "held": self.held[kept], "words": self.words[kept], "word": self.word[np.repeat(kept, self.words)]}
        return _Chunk(**fields, width=self.width, ids=self.ids)

    def tokens(self, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids with ``end`` after each document, their document, and ids in each document."""
        width = np.append(self.width, 1).astype(np.int64)
        begins = np.cumsum(width) - width
        ids = np.append(self.ids, end).astype(np.int64)
        sequence = np.insert(self.word.astype(np.int64), np.cumsum(self.words), len(self.width))
        own = width[sequence]
        tokens = ids[spans_gather(begins[sequence], own)]
        first = np.cumsum(self.words + 1) - (self.words + 1)
        lengths = np.add.reduceat(own, first) if len(first) else np.zeros(0, np.int64)
        return tokens, np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), lengths


def prepare(docs: DataFrame, model: str) -> tuple[DataFrame, str]:
    """Rows of chunks, word counts and subword counts; and the folder of the word counts."""
    buckets = shuffle_partitions(docs.sparkSession) * packed.BUCKETS

    def run(batches):
        import sentencepiece

        attention.forget()
        keep_pages()
        library = sentencepiece.SentencePieceProcessor(model_file=model)
        known, spans, kept = np.zeros(0, U64), np.zeros((0, 2), np.int64), np.zeros(0, np.uint16)
        context = TaskContext.get()
        chunk = (context.partitionId() if context else 0) << 32
        for part in steps(batches, "text", CHUNK_BYTES):
            data, offsets = text_bytes(part.column("text"))
            data = lower(data)
            begins, ends, counts = word_spans(data, offsets)
            words, first, word = _distinct(word_hashes(data, begins, ends))
            at = np.minimum(np.searchsorted(known, words), max(0, len(known) - 1))
            new = np.flatnonzero(known[at] != words) if len(known) else np.arange(len(words))
            if len(known) > KEPT:
                known, spans, kept, new = known[:0], spans[:0], kept[:0], np.arange(len(words))
            if len(new):
                raw = data.tobytes()
                width, ids = np.empty(len(new), np.int64), [kept]
                for b in range(0, len(new), 20_000):
                    some = first[new[b : b + 20_000]]
                    cut = library.encode([raw[x:y].decode() for x, y in zip(begins[some].tolist(), ends[some].tolist(), strict=True)], num_threads=1)
                    width[b : b + len(some)] = [len(x) for x in cut]
                    ids.append(np.fromiter(chain.from_iterable(cut), np.uint16))
                begin = len(kept) + np.cumsum(width) - width
                kept = np.concatenate(ids)
                known = np.concatenate([known, words[new]])
                order = np.argsort(known)
                known, spans = known[order], np.concatenate([spans, np.stack([begin, width], 1)])[order]
                at = np.searchsorted(known, words)
            own = spans[at] if len(words) else np.zeros((0, 2), np.int64)
            # Frequent words get small numbers, which pack better.
            order = np.argsort(-np.bincount(word, minlength=len(words)), kind="stable")
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            words, own, word = words[order], own[order], number[word]
            ids = long_ids(part.column("doc_id"))
            held = np.array([held_out(i) for i in ids.tolist()], bool)
            made = _Chunk(doc=ids, held=held, words=np.diff(counts), word=word, width=own[:, 1], ids=kept[spans_gather(own[:, 0], own[:, 1])])
            yield _rows(CHUNK, [0], [chunk], [made.pack()])
            learnt = np.bincount(word[np.repeat(~held, np.diff(counts))], minlength=len(words))
            columns = [words, np.full(len(words), chunk), np.arange(len(words), dtype=np.uint32), learnt.astype(np.uint32)]
            sent = packed.pack(packed.bucket_of(words, buckets), WORDS, columns, None)
            yield _rows(WORDS, sent.column("bucket"), np.zeros(len(sent), np.int64), sent.column("body"))
            often = np.bincount(made.ids, np.repeat(learnt, own[:, 1]), library.vocab_size()).astype(np.int64)
            often[library.eos_id()] += (~held).sum()
            yield _rows(COUNTS, [0], [0], [zstandard.compress(often.tobytes())])
            chunk += 1

    path = scratch_path(docs.sparkSession, "chunks")
    schema = "kind int, bucket int, chunk long, body binary"
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), schema).write.partitionBy("kind").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path), f"{path}/kind={WORDS}"


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, where each stands first, and the number of each position's.

    As ``np.unique`` gives them; only distinct hashes are sorted, which are few beside all.
    """
    coded = pa.array(hashes).dictionary_encode()
    found, number = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(found)
    rank, first = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    first[number[::-1]] = np.arange(len(hashes))[::-1]  # of equal positions the last one stays
    return found[order], first[order], rank[number]


def _rows(kind: int, bucket, chunk, body) -> pa.RecordBatch:
    n = len(body)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.array(bucket, pa.int32()), pa.array(chunk, pa.int64()), pa.array(body, pa.binary())],
        ["kind", "bucket", "chunk", "body"],
    )


def word_totals(prepared: DataFrame) -> tuple[DataFrame, int, int]:
    """(chunk, packed counts of its words), and the training corpus's words and distinct words."""
    spark = prepared.sparkSession
    rows = prepared.filter(f"kind = {WORDS}").select("bucket", "kind", "body")

    def total(batches):
        for held in packed.bucket_groups(batches):
            (words, chunk, index, count), *_ = packed.unpack(held[WORDS], ["u8", "i8", "u4", "u4"], False)
            distinct, back = np.unique(words, return_inverse=True)
            sums = np.bincount(back, count, len(distinct)).astype(np.int64)
            yield _rows(COUNTS, [0], [0], [zstandard.compress(np.array([sums.sum(), (sums > 0).sum()], np.int64).tobytes())])
            order = np.argsort(chunk, kind="stable")
            chunks, first = np.unique(chunk[order], return_index=True)
            bodies = []
            for own in np.split(order, first[1:]):
                bodies.append(zstandard.compress(np.int64(len(own)).tobytes() + index[own].tobytes() + sums[back[own]].tobytes()))
            yield _rows(WORDS, np.zeros(len(chunks), np.int32), chunks, bodies)

    path = scratch_path(spark, "totals")
    schema = "kind int, bucket int, chunk long, body binary"
    bucket_rows(rows, shuffle_partitions(spark)).mapInArrow(released(total), schema).write.partitionBy("kind").parquet(path)
    found = spark.read.schema(schema).parquet(path)
    sums = _summed(found.filter(f"kind = {COUNTS}"), 2)
    return found.filter(f"kind = {WORDS}").groupBy("chunk").agg(F.collect_list("body").alias("counts")), int(sums[0]), int(sums[1])


def _summed(rows: DataFrame, size: int, kind: type = np.int64, one_a_task: bool = False) -> np.ndarray:
    """The sum of vectors, one a row: in each task, then in 32 tasks, then of their sums.

    Where a task makes one row only, no second worker process stands beside it to sum that.
    """

    def add(batches):
        sums, opener = np.zeros(size, kind), zstandard.ZstdDecompressor()
        for batch in batches:
            for body in batch.column("body").to_pylist():
                sums += np.frombuffer(opener.decompress(body), kind)
        yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(sums.tobytes())], pa.binary())], ["body"])

    rows = rows.select("body")
    inner = rows if one_a_task else rows.mapInArrow(released(add), "body binary")
    partial = inner.repartition(32).mapInArrow(released(add), "body binary").collect()
    return sum((np.frombuffer(zstandard.decompress(r.body), kind) for r in partial), np.zeros(size, kind))


def counted_tables(prepared: DataFrame, unigrams: np.ndarray, end: int) -> attention.Tables:
    """What follows each frequent input, over all training tokens."""
    spark, size = prepared.sparkSession, len(unigrams)
    row_of = np.full(size, ROWS - 1, np.int64)
    often = np.argsort(-unigrams, kind="stable")[: ROWS - 1]
    row_of[often] = np.arange(len(often))
    groups = -(-ROWS // GROUP)
    # As many buckets as there are partitions, so that more tasks are dealt out to more of them.
    salts = max(1, shuffle_partitions(spark) // groups)

    def send(batches):
        context = TaskContext.get()
        salt = (context.partitionId() if context else 0) % salts

        def sums(parts):
            keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(back, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)

        def rows(keys, counts):
            bucket = (keys // size // GROUP + groups * salt).astype(np.int32)
            return packed.pack(bucket, 0, [keys.astype(np.uint32), counts], None)

        parts, waiting = [], 0
        for batch in batches:
            for body in batch.column("body").to_pylist():
                tokens, docs, _ = (chunk := _Chunk.unpack(body)).tokens(end)
                inputs = np.concatenate([[end], tokens[:-1]])
                parts.append(np.unique((row_of[inputs] * size + tokens)[~chunk.held[docs]], return_counts=True))
                waiting += len(parts[-1][0])
                if waiting > SUMMED:
                    parts = [sums(parts)]
                    waiting = len(parts[0][0])
                    if 2 * waiting > SUMMED:
                        yield rows(*parts[0])
                        parts, waiting = [], 0
        if parts:
            yield rows(*sums(parts))

    def add(batches):
        """The dense rows of one bucket at a time; bodies are added to them one by one."""
        opener, at, dense = zstandard.ZstdDecompressor(), None, np.zeros((GROUP, size), np.int64)

        def full():
            first = at % groups * GROUP
            own = np.flatnonzero(dense.any(1))
            bodies = [zstandard.compress(dense[r].tobytes()) for r in own.tolist()]
            return pa.RecordBatch.from_arrays([pa.array(first + own), pa.array(bodies, pa.binary())], ["row", "body"])

        for batch in batches:
            for bucket, body in zip(batch.column("bucket").to_pylist(), batch.column("body"), strict=True):
                if bucket != at:
                    if at is not None:
                        yield full()
                    at = bucket
                    dense[:] = 0
                body = opener.decompress(body.as_buffer())
                n = int(np.frombuffer(body, np.int64, 1)[0])
                # A body holds a pair once.
                dense.ravel()[np.frombuffer(body, np.uint32, n, 8).astype(np.int64) - at % groups * GROUP * size] += np.frombuffer(body, np.int64, n, 8 + 4 * n)
        if at is not None:
            yield full()

    def fold(batches):
        """The sum of each row's bodies, which come one after the other."""
        opener, at, dense = zstandard.ZstdDecompressor(), None, np.zeros(size, np.int64)

        def full():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([zstandard.compress(dense.tobytes())], pa.binary())], ["row", "body"])

        for batch in batches:
            for row, body in zip(batch.column("row").to_pylist(), batch.column("body"), strict=True):
                if row != at:
                    if at is not None:
                        yield full()
                    at = row
                    dense[:] = 0
                dense += np.frombuffer(opener.decompress(body.as_buffer()), np.int64)
        if at is not None:
            yield full()

    partitions, schema = shuffle_partitions(spark), "row long, body binary"
    sent = prepared.filter(f"kind = {CHUNK}").select("body").mapInArrow(released(send), packed.ROWS)
    added = bucket_rows(sent, partitions).mapInArrow(released(add), schema)
    summed = added.repartition(min(partitions, ROWS), "row").sortWithinPartitions("row").mapInArrow(released(fold), schema)
    counts = [zstandard.compress(bytes(8 * size))] * ROWS
    for row in summed.toLocalIterator():
        counts[row.row] = bytes(row.body)
    return attention.Tables(counts, unigrams, row_of)


class _Small:
    """The tables that training needs."""

    def __init__(self, tables: attention.Tables):
        self.vectors, self.classes, self.prior, self.row_of = tables.vectors, tables.classes, tables.prior, tables.row_of


def turn_of(doc: np.ndarray) -> np.ndarray:
    """The turn in which documents are learnt from."""
    return (mixed(doc.astype(U64)) % U64(TURNS)).astype(np.int64)


def windows(chunk: _Chunk, end: int, turn: int):
    """A turn's blocks of a chunk's training texts: inputs with a block before, targets, and where texts begin.

    Each token is predicted once; what fills a text's last block is no target.
    """
    width = attention.STRIDE
    tokens, _, lengths = chunk.only(~chunk.held & (turn_of(chunk.doc) == turn)).tokens(end)
    at, first = attention.slots(lengths)
    inputs = np.full(width * (len(first) + 1), end, np.int64)
    inputs[width + at] = np.concatenate([[end], tokens[:-1]]) if len(tokens) else tokens
    targets = np.full(width * len(first), -1, np.int64)
    targets[at] = tokens
    for b in range(0, len(first), MINIBATCH):
        e = min(len(first), b + MINIBATCH)
        yield inputs[b * width : (e + 1) * width], targets[b * width : e * width], first[b:e]


def train(prepared: DataFrame, tables: attention.Tables, end: int) -> np.ndarray:
    """Weights after one step for each turn, along the gradient of all its documents."""
    chunks = prepared.filter(f"kind = {CHUNK}").select("body")
    small, weights = _Small(tables), attention.start()
    optimiser = attention.Adam(len(weights), LEARNING)
    for turn in range(TURNS):

        def run(batches, weights=weights, turn=turn):
            keep_pages()
            sums = np.zeros(len(weights) + 1)
            for batch in batches:
                for body in batch.column("body").to_pylist():
                    for inputs, targets, first in windows(_Chunk.unpack(body), end, turn):
                        sums[:-1] += attention.loss_gradient(small, weights, inputs, targets, first)[1]
                        sums[-1] += np.count_nonzero(targets >= 0)
            yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(sums.tobytes())], pa.binary())], ["body"])

        sums = _summed(chunks.mapInArrow(released(run), "body binary"), len(weights) + 1, np.float64, one_a_task=True)
        if sums[-1]:
            weights = optimiser.step(weights, (sums[:-1] / sums[-1]).astype(np.float32))
    return weights


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, model: str) -> DataFrame:
    """Base score and model's score of every document."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    end = library.eos_id()
    prepared, word_rows = prepare(docs, model)
    counts, words, distinct = word_totals(prepared)
    discard(docs.sparkSession, word_rows)
    unigrams = _summed(prepared.filter(f"kind = {COUNTS}"), library.vocab_size())
    tables = counted_tables(prepared, unigrams, end)
    weights = train(prepared, tables, end)
    ends = int(unigrams[end])  # no word holds it, so there is one for each training document
    total, kinds = words + ends, distinct + (ends > 0)

    def run(batches):
        keep_pages()
        for batch in batches:
            for body, bodies in zip(batch.column("body").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                chunk = _Chunk.unpack(body)
                known = np.zeros(len(chunk.width) + 1, np.int64)
                known[-1] = ends
                for part in bodies or []:
                    part = zstandard.decompress(part)
                    n = int(np.frombuffer(part, np.int64, 1)[0])
                    known[np.frombuffer(part, np.uint32, n, 8)] = np.frombuffer(part, np.int64, n, 8 + 4 * n)
                tokens, _, lengths = chunk.tokens(end)
                sequence = np.insert(chunk.word.astype(np.int64), np.cumsum(chunk.words), len(chunk.width))
                first = np.cumsum(chunk.words + 1) - (chunk.words + 1)
                each = np.log10((known + 1) / (total + kinds + 1))
                base = np.add.reduceat(each[sequence], first) if len(first) else np.zeros(0)
                seen = np.add.reduceat((known > 0)[sequence].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
                own = attention.token_scores(tables, weights, tokens, lengths, end).astype(np.float64)
                begin = np.cumsum(lengths) - lengths
                scores = np.add.reduceat(own, begin) / math.log(10) if len(begin) else np.zeros(0)
                n = len(chunk.doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(chunk.doc, mask=chunk.doc == NO_ID), pa.array(chunk.held), pa.array(chunk.words.astype(np.int64) + 1),
                        pa.array(seen), pa.array(np.full(n, total, np.int64)), pa.array(base), pa.array(scores),
                    ],
                    [c.split()[0] for c in SCHEMA.split(", ")],
                )

    return prepared.filter(f"kind = {CHUNK}").select("chunk", "body").join(counts, "chunk", "left").mapInArrow(released(run), SCHEMA)


def query(spark, sf_dir):
    import public_tokenizers

    from strata.llm.common import read_sized

    return score(read_sized(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
