"""Benchmark decontamination with BM25 and block-max WAND (operator 5).

Spark builds the index: term counts over all items, BM25 weights, and for every block of about
``BLOCK`` items and term the largest weight with its postings. Items fall into classes by length;
those of class k have up to 2**k words, and a text is cut for them into passages of 2**(k + 1)
words that overlap by half, so any item lies whole in a passage. Every passage is a query.

A block has a least threshold: ``SHARE`` of the score an item has with itself. Its terms of the
smallest maxima, as many as stay below that together, cannot lift a passage there; the others are
essential, and only passages with an essential term meet the block at all. It is opened if the
maxima of all the passage's terms can reach the threshold; then the postings give exact scores, and
every item at or above its own threshold is retrieved, without a limit on their number.

A retrieved item is confirmed if enough of its question and of its answer stands in the
passage: the shares of their word runs (``QUESTION_RUN`` and ``ANSWER_RUN`` words) that occur
there must reach ``OVERLAP``. The answer is the last quarter of an item's words.

What is found of an item depends on its own length and on the counts of the whole benchmark, not
on the items that share its block or shard. Items are dealt by hash to shards of about
``SHARD_WORDS`` words; the driver holds and sends one shard at a time, and the documents are read
once for each shard.

Null and empty texts and items match nothing; repeated items match each by its own id; rows
sharing a doc_id answer as one document; rows or items without an id cannot be named and give
no pair. Further columns are ignored; an empty benchmark or an empty table gives no pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import U64, Rolling, lower, passing, read, released, steps, stored, text_bytes, word_spans
from strata.llm.licenses import GAPS
from strata.session import scratch_path

K1, B = 1.2, 0.75
BLOCK = 8
#: Words of the items that one job searches for.
SHARD_WORDS = 1 << 20
SHARE, OVERLAP = 0.5, 0.6
QUESTION_RUN, ANSWER_RUN = 5, 3
#: Pairs of blocks or postings and passages that are looked up at a time.
PAIRS = 1 << 19

SCHEMA = "doc_id long, item_id long, score double, question_share double, answer_share double"


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and the words before each."""
    data, offsets = text_bytes(column)
    data = lower(data)
    begins, ends, counts = word_spans(data, offsets, GAPS)
    return Rolling(data).runs(begins, ends), counts


def _runs(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the distinct runs of ``length`` words."""
    out = words[: len(words) - length + 1].copy()
    for k in range(1, length):
        out = out * U64(0x9E3779B97F4A7C15) + words[k : len(words) - length + 1 + k]
    return np.unique(out)


def _spread(begins: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For spans of ``counts`` elements from ``begins``: the span of each element, and its index."""
    span = np.repeat(np.arange(len(counts)), counts)
    return span, np.arange(len(span)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begins, counts)


def items_of(benchmark: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row for each item that has an id and words: its key, class, shard, and its words' hashes."""

    def run(batches):
        for part in steps(batches, "text"):
            codes, counts = _codes(part.column("text"))
            sizes = np.diff(counts)
            some = np.flatnonzero(sizes)
            words = [codes[counts[i] : counts[i + 1]].tobytes() for i in some.tolist()]
            kept = part.take(pa.array(some))
            yield pa.RecordBatch.from_arrays(
                [kept.column("item_id"), kept.column("key"), pa.array(sizes[some]), pa.array(words, pa.binary())], ["item_id", "key", "n", "words"]
            )

    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = named.filter("item_id is not null").distinct().withColumn("key", F.xxhash64("item_id", "text"))
    found = stored(rows.mapInArrow(released(run), "item_id long, key long, n long, words binary"), "items")
    words = found.agg(F.sum("n")).first()[0] or 0
    return found.withColumn("shard", F.pmod("key", F.lit(max(1, -(-words // shard_words)))).cast("int")).withColumn(
        "klass", F.ceil(F.log2("n")).cast("int")
    )


def postings_of(items: DataFrame) -> DataFrame:
    """(item, term, BM25 weight) with counts over all items."""

    def run(batches):
        for batch in batches:
            words = [np.frombuffer(w, U64) for w in batch.column("words").to_pylist()]
            found = [np.unique(w, return_counts=True) for w in words]
            owner = pa.array(np.repeat(np.arange(len(found)), [len(t) for t, _ in found]))
            terms = np.concatenate([t for t, _ in found] or [np.zeros(0, U64)]).view(np.int64)
            often = np.concatenate([c for _, c in found] or [np.zeros(0, np.int64)]).astype(np.int64)
            kept = [batch.column(c).take(owner) for c in ("shard", "klass", "key", "n")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(terms), pa.array(often)], ["shard", "klass", "key", "n", "term", "tf"])

    rows = items.select("shard", "klass", "key", "n", "words").mapInArrow(
        released(run), "shard int, klass int, key long, n long, term long, tf long"
    )
    total, mean = items.agg(F.count(F.lit(1)), F.avg("n")).first()
    often = rows.groupBy("term").agg(F.count(F.lit(1)).alias("often"))
    idf = F.log1p((total - F.col("often") + 0.5) / (F.col("often") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / (mean or 1.0)))
    return rows.join(often, "term").select("shard", "klass", "key", "term", weight.alias("weight"))


def index_tables(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The items with block and own score, and (block, term) with maximum and postings; stored by shard."""
    spark = items.sparkSession
    postings = stored(postings_of(items), "postings")
    sizes = items.groupBy("shard", "klass").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("key", F.lit("block")), F.col("blocks")).alias("block")
    placed = items.join(sizes, ["shard", "klass"]).select("shard", "klass", block, "key", "item_id", "words")
    own = postings.groupBy("key").agg(F.sum("weight").alias("own"))
    tables = []
    for name, df in (
        ("blocks", placed.join(own, "key")),
        (
            "terms",
            postings.join(placed.select("key", "block"), "key")
            .groupBy("shard", "klass", "block", "term")
            .agg(F.max("weight").alias("maximum"), F.collect_list(F.struct("key", "weight")).alias("postings")),
        ),
    ):
        path = scratch_path(spark, name)
        df.write.partitionBy("shard").parquet(path)
        tables.append(spark.read.schema(df.schema).parquet(path))
    return tables[0], tables[1]


class Index:
    """One shard's items of one class: its terms' blocks with maxima and postings."""

    def __init__(self, klass: int, items: pa.Table, terms: pa.Table):
        self.half = 1 << klass
        order = np.lexsort((items["key"].to_numpy(), items["block"].to_numpy()))
        keys = items["key"].to_numpy()[order]
        self.ids = items["item_id"].to_numpy()[order]
        self.words = [np.frombuffer(items["words"][int(i)].as_py(), U64) for i in order]
        self.least = SHARE * items["own"].to_numpy()[order]
        named, first = np.unique(items["block"].to_numpy()[order], return_index=True)
        self.block_least = np.minimum.reduceat(self.least, first) * 0.999
        # (words in a run, its hashes) of each item's question and answer.
        cuts = [len(w) - max(1, len(w) // 4) for w in self.words]
        self.questions = [self._part(w[:c], QUESTION_RUN) for w, c in zip(self.words, cuts, strict=True)]
        self.answers = [self._part(w[c:], ANSWER_RUN) for w, c in zip(self.words, cuts, strict=True)]

        # Entries: (term, block) in order, with the maximum, and where its postings are.
        codes = terms["term"].to_numpy().view(U64)
        self.terms, term = np.unique(codes, return_inverse=True)
        block = np.searchsorted(named, terms["block"].to_numpy())
        order = np.lexsort((block, term))
        self.entry_term, self.entry_block = term[order], block[order]
        self.blocks = len(named)
        self.entry = self.entry_term * self.blocks + self.entry_block
        self.maximum = terms["maximum"].to_numpy()[order]
        lists = terms["postings"].combine_chunks().take(pa.array(order))
        offsets = lists.offsets.to_numpy()
        self.begin, self.count = offsets[:-1] - offsets[0], np.diff(offsets)
        flat = lists.flatten()
        by_key = np.argsort(keys)
        self.item = by_key[np.searchsorted(keys[by_key], flat.field("key").to_numpy())]
        self.weight = flat.field("weight").to_numpy()
        self._essential()

    def _essential(self) -> None:
        """Entries that a passage needs one of, if it is to reach the block's threshold, by term."""
        order = np.lexsort((self.maximum, self.entry_block))
        sums = np.cumsum(self.maximum[order])
        first = np.searchsorted(self.entry_block[order], np.arange(self.blocks))
        sums -= np.concatenate([[0.0], sums])[first][self.entry_block[order]]
        needed = np.zeros(len(order), bool)
        needed[order] = sums >= self.block_least[self.entry_block[order]]
        own = np.flatnonzero(needed)
        self.essential_block = self.entry_block[own]
        self.essential = np.searchsorted(self.entry_term[own], np.arange(len(self.terms) + 1))

    @staticmethod
    def _part(words: np.ndarray, run: int) -> tuple[int, np.ndarray]:
        run = min(run, len(words))
        return run, _runs(words, run) if run else words

    @staticmethod
    def _share(part: tuple[int, np.ndarray], passage: np.ndarray) -> float:
        run, hashes = part
        if not len(hashes):
            return 1.0
        return float(np.isin(hashes, _runs(passage, run)).mean()) if len(passage) >= run else 0.0

    def passages(self, codes: np.ndarray, counts: np.ndarray):
        """(begin, end, text) of the passages, and the distinct (passage, term) pairs in order."""
        sizes = np.diff(counts)
        halves = -(-sizes // self.half)
        many = np.where(sizes > 0, np.maximum(halves - 1, 1), 0)  # the last half is part of the one before
        before = np.cumsum(many) - many
        text = np.repeat(np.arange(len(many)), many)
        begin = counts[text] + (np.arange(len(text)) - before[text]) * self.half
        end = np.minimum(begin + 2 * self.half, counts[text + 1])
        at = np.minimum(np.searchsorted(self.terms, codes), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[at] == codes)
        term, owner = at[known], np.searchsorted(counts, known, "right") - 1
        half = (known - counts[owner]) // self.half
        first = before[owner] + np.minimum(half, many[owner] - 1)
        both = np.flatnonzero((half > 0) & (half < many[owner]))
        size = len(self.terms)
        pairs = np.unique(np.concatenate([first * size + term, (first[both] - 1) * size + term[both]]))
        return begin, end, text, pairs // size, pairs % size

    def retrieved(self, codes: np.ndarray, counts: np.ndarray):
        """(passage, item, score) of every item at its threshold, and the passages."""
        begin, end, text, passage, term = self.passages(codes, counts)
        many = np.searchsorted(passage, np.arange(len(begin) + 1))  # where a passage's terms begin
        found = []
        self.met = self.opened = 0
        needs = self.essential[term + 1] - self.essential[term]
        # Whole passages at a time, so that a pair of passage and block is met once.
        work = np.concatenate([[0], np.cumsum(needs)])[many]
        b = 0
        while b < len(begin):
            e = max(b + 1, int(np.searchsorted(work, work[b] + PAIRS, "right")) - 1)
            lo, hi = many[b], many[e]
            pair, at = _spread(self.essential[term[lo:hi]], needs[lo:hi])
            met = np.unique(passage[lo + pair] * self.blocks + self.essential_block[at])
            self.met += len(met)
            for s in range(0, len(met), 1 << 14):
                found += self._open(met[s : s + (1 << 14)], many, term)
            b = e
        rows = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return rows, (begin, end, text)

    def _open(self, met: np.ndarray, many: np.ndarray, term: np.ndarray):
        """Scores of the blocks whose maxima can reach their threshold."""
        passage, block = met // self.blocks, met % self.blocks
        pair, at = _spread(many[passage], many[passage + 1] - many[passage])
        key = term[at] * self.blocks + block[pair]
        entry = np.minimum(np.searchsorted(self.entry, key), len(self.entry) - 1)
        held = self.entry[entry] == key
        pair, entry = pair[held], entry[held]
        bound = np.bincount(pair, self.maximum[entry], len(met))
        going = bound >= self.block_least[block]
        self.opened += int(going.sum())
        pair, entry = pair[going[pair]], entry[going[pair]]
        which, posting = _spread(self.begin[entry], self.count[entry])
        key, back = np.unique(passage[pair[which]] * len(self.ids) + self.item[posting], return_inverse=True)
        score = np.bincount(back, self.weight[posting], len(key))
        item = key % max(len(self.ids), 1)
        enough = score >= self.least[item] * (1 - 1e-9)
        return [(key[enough] // len(self.ids), item[enough], score[enough])]

    def search(self, codes: np.ndarray, counts: np.ndarray):
        """(text, item, score, question and answer shares) of every confirmed pair."""
        if not len(codes) or not len(self.terms):
            return
        (passage, item, score), (begin, end, text) = self.retrieved(codes, counts)
        for p, k, s in zip(passage.tolist(), item.tolist(), score.tolist(), strict=True):
            words = codes[begin[p] : end[p]]
            question, answer = self._share(self.questions[k], words), self._share(self.answers[k], words)
            if question >= OVERLAP and answer >= OVERLAP:
                yield text[p], k, s, question, answer


def indexes(items: pa.Table, terms: pa.Table) -> list[Index]:
    """The indexes of a shard's classes."""
    found = []
    for klass in np.unique(items["klass"].to_numpy()).tolist():
        own = [t.filter(pa.array(t["klass"].to_numpy() == klass)) for t in (items, terms)]
        found.append(Index(klass, *own))
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Every document that holds an item of the benchmark, with the item and the evidence."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")

    def searched(own: list[Index]) -> DataFrame:
        def run(batches):
            for part in steps(batches, "text"):
                codes, counts = _codes(part.column("text"))
                for index in own:
                    rows = list(index.search(codes, counts))
                    if rows:
                        of, items, *rest = (np.array(c) for c in zip(*rows, strict=True))
                        arrays = [part.column("doc_id").take(pa.array(of)), pa.array(index.ids[items]), *map(pa.array, rest)]
                        yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in SCHEMA.split(", ")])

        return docs.mapInArrow(released(run), SCHEMA)

    with passing(spark):
        blocks, terms = index_tables(items_of(benchmark, shard_words))
        shards = sorted(row.shard for row in blocks.select("shard").distinct().collect())
        path = scratch_path(spark, "leaks")
        for shard in shards:
            own = indexes(*(t.filter(F.col("shard") == shard).toArrow() for t in (blocks, terms)))
            searched(own).write.mode("append").parquet(path)
    if not shards:
        return spark.createDataFrame([], SCHEMA)
    best = F.max(F.struct("score", "question_share", "answer_share")).alias("best")
    return spark.read.schema(SCHEMA).parquet(path).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def query(spark, sf_dir):
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
