"""Toxicity of whole texts by a convolutional classifier, with a threshold for each language.

The classifier sees words only. It learns from every labelled row. These are dealt by the hash of
their id to parts of about ``PART_ROWS`` documents and ``PART_BYTES`` bytes, and each part is stored
as one packed row. In each of the classifier's epochs every part is trained on in a task of its own,
from the weights that the last epoch left, and the weights are averaged over the parts; the counts
that choose features and weigh labels are those of all parts. A single part is trained on as it is.
Parts and their order follow from the ids alone, so scores do not depend on the layout. Every fifth
document of a part is left out of the training and sets the thresholds: for each language with
``LEAST`` documents of either label the one that parts them best, and one over all for the others.
Thresholds are a matter of ``threshold`` and ``flagged``; ``score`` and ``predicted`` do not depend
on the language.

Labels are learned from rows whose crc32 of the doc_id modulo ``FOLDS`` is not 0. A null doc_id
counts as an empty text, whose remainder is 0, so it is held out. Of documents that share an id, the
smallest text is learned from; an id with both labels is toxic; labels other than 0 and 1 and null
ids do not count. Without documents of both labels every score is 0. A null text is empty, and
empty ones have a score like any other. Repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import passing, read, read_sized, released, steps, stored
from strata.llm.convolution import EPOCHS, LEAST_TEXTS, Classifier, Texts

#: Documents and bytes of a part of the labelled rows, about; a part is trained on in one task.
PART_ROWS = 6000
PART_BYTES = 32 << 20
#: Vectors that are added up in one task.
ADDED = 8
#: One in so many of a part's documents sets thresholds.
ASIDE = 5
#: Different scores of a language that a threshold is looked for among; of more, scores are rounded.
CUTS = 10**6
#: Documents of either label that a language needs for a threshold of its own.
LEAST = 15
FOLDS = 5
DECIDES = 0.5
#: Scores are rounded, so that the order of a sum does not show.
PLACES = 6

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, threshold double, flagged int"


def _held_out() -> Column:
    text = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS == 0


def known_labels(labels: DataFrame) -> DataFrame:
    """``doc_id``, ``toxic`` and ``rank`` of every id that labels are learned from, once."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~_held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("rank", F.xxhash64("doc_id"))
    )


def labelled_texts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``rank``, ``doc_id``, ``text``, ``lang`` and ``toxic`` of every document with a known label."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    found = texts.filter(~_held_out()).join(known, "doc_id").groupBy("rank", "doc_id", "toxic")
    return found.agg(F.min(F.struct("text", "lang")).alias("kept")).select("rank", "doc_id", "kept.text", "kept.lang", "toxic")


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """``labelled_texts`` of at most ``size`` documents of each label, to look at; nothing is learned from it."""
    known, order = known_labels(labels), ["rank", "doc_id"]
    chosen = (known.filter(F.col("toxic") == k).orderBy(*order).limit(size) for k in (0, 1))
    return labelled_texts(docs, next(chosen).unionAll(next(chosen)))


def best_threshold(scores: np.ndarray, labels: np.ndarray, times: np.ndarray | None = None) -> float:
    """Between the scores of two documents, where recall less false alarms is greatest; nearest to a half in a tie.

    A row stands for ``times`` documents.
    """
    cuts = np.unique(np.concatenate([[DECIDES], (np.unique(scores)[1:] + np.unique(scores)[:-1]) / 2]))
    times = np.ones(len(scores), np.int64) if times is None else times

    def above(label: int) -> np.ndarray:
        order = np.argsort(scores[labels == label])
        before = np.concatenate([[0], np.cumsum(times[labels == label][order])])
        return 1 - before[np.searchsorted(scores[labels == label][order], cuts)] / max(before[-1], 1)

    gain = np.round(above(1) - above(0), 9)
    return float(min(cuts[gain == gain.max()], key=lambda cut: abs(cut - DECIDES)))


def _aside(n: int) -> np.ndarray:
    return np.arange(n) % ASIDE == ASIDE - 1


def _vectors(part: int, vector: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "body": pa.array([zstandard.compress(vector.tobytes())], pa.binary())})


def _added(rows: DataFrame, parts: int) -> np.ndarray | None:
    """The sum of one vector for each part, ``ADDED`` in a task at a time and in the order of the parts."""

    def add(batches):
        at, sums = None, None
        for batch in batches:
            for group, body in zip(batch.column("group").to_pylist(), batch.column("body"), strict=True):
                vector = np.frombuffer(zstandard.decompress(body.as_py()), float)
                if group != at and at is not None:
                    yield _vectors(at, sums)
                at, sums = group, vector if group != at else sums + vector
        if at is not None:
            yield _vectors(at, sums)

    while True:
        parts = -(-parts // ADDED)
        grouped = rows.select(F.floor(F.col("part") / ADDED).alias("group"), "part", "body").repartition(parts, "group")
        rows = grouped.sortWithinPartitions("group", "part").select("group", "body").mapInArrow(released(add), VECTORS)
        if parts == 1:
            found = rows.collect()
            return np.frombuffer(zstandard.decompress(found[0].body), float) if found else None


VECTORS = "part long, body binary"
PACKED = "part long, body binary, holders binary"


def packed_parts(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int, int]:
    """Every labelled row, one packed row for each part, stored; the number of parts, and of rows."""
    known = known_labels(labels)
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    sizes = sizes.filter(~_held_out()).join(known.select("doc_id"), "doc_id").groupBy("doc_id").agg(F.min("size").cast("long").alias("size"))
    found = sizes.agg(F.count("size").alias("n"), F.sum("size").alias("bytes")).first()
    parts = max(1, -(-found.n // PART_ROWS), -(-(found.bytes or 0) // PART_BYTES))

    def pack(batches):
        at, held = None, []

        def whole():
            table = pa.Table.from_batches(held)
            texts, toxic = table.column("text").combine_chunks(), table.column("toxic").to_numpy()
            learnt = ~_aside(len(toxic))
            holders = Texts(texts.filter(pa.array(learnt))).holders()
            counts = np.concatenate([holders, np.bincount(toxic[learnt], minlength=2)]).astype(float)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            fields = {"part": pa.array([at], pa.int64()), "body": pa.array([sink.getvalue().to_pybytes()], pa.binary())}
            return pa.RecordBatch.from_pydict(fields | {"holders": pa.array([zstandard.compress(counts.tobytes())], pa.binary())})

        for batch in batches:
            numbers = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if low == high:
                    continue
                if numbers[low] != at and held:
                    yield whole()
                    held = []
                at = int(numbers[low])
                some = batch.slice(low, high - low)
                held.append(
                    pa.RecordBatch.from_arrays(
                        [some.column("text").cast(pa.large_string()), some.column("lang").cast(pa.string()), some.column("toxic").cast(pa.int64())],
                        ["text", "lang", "toxic"],
                    )
                )
        if held:
            yield whole()

    rows = labelled_texts(docs, known).select(F.pmod("rank", F.lit(parts)).alias("part"), "rank", "doc_id", "text", F.col("lang").cast("string").alias("lang"), "toxic")
    rows = rows.repartition(parts, "part").sortWithinPartitions("part", "rank", "doc_id").select("part", "text", "lang", "toxic")
    return stored(rows.mapInArrow(released(pack), PACKED), "labelled"), parts, found.n


def _opened(batches):
    """Number, texts, languages and labels of each part."""
    for batch in batches:
        for part, body in zip(batch.column("part").to_pylist(), batch.column("body"), strict=True):
            table = pa.ipc.open_stream(body.as_buffer()).read_all()
            yield part, table.column("text").combine_chunks(), table.column("lang").combine_chunks(), table.column("toxic").to_numpy()


def fit(docs: DataFrame, labels: DataFrame) -> tuple[bytes, dict[str, float]]:
    """Weights, and thresholds by language, that of all under ''; learned from every labelled row."""
    with passing(docs.sparkSession):
        packs, parts, n = packed_parts(docs, labels)
        sums = _added(packs.select("part", F.col("holders").alias("body")), parts)
        if sums is None or not sums[-2:].all():
            return b"", {"": DECIDES}
        common, counts = sums[:-2] >= LEAST_TEXTS, sums[-2:]
        bodies = packs.select("part", "body")
        model = Classifier()
        for epoch in range(1, 1 + (EPOCHS if parts > 1 else 1)):

            def learn(batches, body=model.packed(), epoch=epoch):
                for part, texts, _, toxic in _opened(batches):
                    learnt, start, own = ~_aside(len(toxic)), Classifier.opened(body), Classifier()
                    for name in own.NAMES:
                        setattr(own, name, getattr(start, name).copy())
                    # One part alone goes through its epochs at once.
                    own.fit(texts.filter(pa.array(learnt)), toxic[learnt], 1 if parts > 1 else None, seed=epoch + part * EPOCHS, common=common, counts=counts)
                    yield _vectors(part, own.share(start, int(learnt.sum())))

            model = model.average(_added(bodies.mapInArrow(released(learn), VECTORS), parts))
        model.table[~common] = 0
        body = model.packed()

        def score(batches):
            own = Classifier.opened(body)
            for _, texts, langs, toxic in _opened(batches):
                aside = _aside(len(toxic))
                kept = pa.array(aside)
                scores = own.scores(Texts(texts.filter(kept)))
                yield pa.RecordBatch.from_arrays([langs.filter(kept).fill_null(""), pa.array(toxic[aside]), pa.array(scores)], ["lang", "toxic", "score"])

        scored = bodies.mapInArrow(released(score), "lang string, toxic long, score double")
        return body, thresholds(scored if n // ASIDE <= CUTS else scored.withColumn("score", F.round("score", PLACES)))


def thresholds(scored: DataFrame) -> dict[str, float]:
    """The best threshold for each language that has enough documents, and that of all under ''."""
    counted = stored(scored.groupBy("lang", "toxic", "score").agg(F.count(F.lit(1)).alias("times")), "scored")
    spoken = counted.groupBy("lang").agg(*(F.sum(F.when(F.col("toxic") == k, F.col("times")).otherwise(0)).alias(f"of{k}") for k in (0, 1)))
    spoken = spoken.filter((F.col("lang") != "") & (F.col("of0") >= LEAST) & (F.col("of1") >= LEAST)).select("lang")
    every = counted.groupBy("toxic", "score").agg(F.sum("times").alias("times")).withColumn("lang", F.lit(""))

    def best(rows: pa.Table) -> pa.Table:
        scores, toxic, times = (rows.column(c).to_numpy() for c in ("score", "toxic", "times"))
        cut = best_threshold(scores, toxic, times) if len(np.unique(toxic)) == 2 else DECIDES
        return pa.table({"lang": [rows.column("lang")[0].as_py()], "cut": [cut]})

    # A language has at most ``CUTS`` different scores of either label.
    rows = counted.join(spoken, "lang").unionByName(every).groupBy("lang").applyInArrow(best, "lang string, cut double").collect()
    return {"": DECIDES} | {row.lang: row.cut for row in sorted(rows)}


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score, prediction, and threshold and flag of its language, for every document."""
    body, cuts_of = fit(docs, labels)

    def run(batches):
        model = Classifier.opened(body) if body else None
        for part in steps(batches, "text"):
            texts = Texts(part.column("text"))
            scores = np.round(model.scores(texts), PLACES) if model else np.zeros(len(texts))
            langs = part.column("lang").to_pylist()
            cuts = np.array([cuts_of.get(x or "", cuts_of[""]) for x in langs])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("held_out"),
                    pa.array(scores),
                    pa.array((scores >= DECIDES).astype(np.int32)),
                    pa.array(cuts),
                    pa.array((scores >= cuts).astype(np.int32)),
                ],
                ["doc_id", "held_out", "score", "predicted", "threshold", "flagged"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"), "text", F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(released(run), SCHEMA)


def query(spark, sf_dir):
    docs = read_sized(spark, sf_dir, "documents")
    return toxicity(docs, read(docs.sparkSession, sf_dir, "labels"))
