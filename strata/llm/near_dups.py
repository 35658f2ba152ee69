"""MinHash near-duplicates with tensored banding (operator 6).

A document's set holds its distinct shingles of ``words`` lower-cased words; with fewer words
the whole sequence is its only shingle. Two small collections of minhash pairs are computed,
``SIDE`` pairs each, and every pair of one collection is combined with every pair of the other
to a table key: ``SIDE ** 2`` tables from ``4 * SIDE`` minhashes. Texts of similarity 0.75 share
no key with probability below 2 * (1 - 0.75 ** 2) ** SIDE, 0.0001 for 12.

Documents with equal sets are one class. The classes of a key meet in its bucket: a small
bucket gives all its pairs, a larger one a star around its smallest class. A key that is hot in
a task step sends only its smallest class from there; its members are written aside and meet
the key's hub in a join. Pairs are verified on full sets, and links become components. Where a
larger bucket still holds several components, its
classes get an exact join: any two sets of the similarity share one of the first shingles of
each, rarest first, with enough shingles left behind it in both, so classes that only share a
frequent passage do not meet. No pair of a
bucket is lost.

Null and empty texts, and texts without words, have an empty set, are linked with nothing and
kept. Repeated rows are one class. Rows that share a doc_id are told apart by their sets, but
if both stand for their sets they count as one document. Rows without a doc_id cannot be named
in a link: they are returned as components of their own, with null as component_id, and kept.
Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import packed
from strata.llm.common import U64, Rolling, bucket_rows, lower, mixed, passing, released, shuffle_partitions, steps, stored, text_bytes, word_spans
from strata.llm.components import components

WORDS, PERCENT, SIDE = 5, 75, 12
#: Classes up to which a bucket gives all its pairs.
SMALL = 8
EDGE, MEMBER, HUB = 1, 2, 3

_rng = np.random.default_rng(6)
_FACTORS = _rng.integers(0, 2**63, 4 * SIDE, dtype=U64) * U64(2) + U64(1)
_SHIFTS = _rng.integers(0, 2**63, 4 * SIDE, dtype=U64)


def shingle_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = text_bytes(column)
    begins, ends, counts = word_spans(data, offsets)
    lengths = ends - begins
    ends = np.cumsum(lengths + 1) - 1
    line = np.full(int((lengths + 1).sum()), 0x20, np.uint8)
    inside = np.ones(len(line), bool)
    inside[ends] = False
    cover = np.zeros(len(data) + 1, np.int8)
    cover[begins] += 1
    cover[begins + lengths] -= 1
    line[inside] = lower(data[np.cumsum(cover[:-1], dtype=np.int8) > 0])
    begins = ends - lengths
    hashes, sets = Rolling(line), []
    whole = hashes.runs(begins[: max(0, len(begins) - words + 1)], ends[words - 1 :])
    for b, e in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True):
        if e - b >= words:
            sets.append(np.unique(whole[b : e - words + 1]))
        elif e > b:
            sets.append(hashes.runs(begins[b : b + 1], ends[e - 1 : e]))
        else:
            sets.append(np.zeros(0, U64))
    return sets


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Minhash pairs of each set, ``2 * SIDE`` numbers; sets must not be empty."""
    flat = np.concatenate(sets) if sets else np.zeros(0, U64)
    first = np.cumsum([0, *map(len, sets)])[:-1]
    least = np.empty((len(sets), 4 * SIDE), U64)
    for k in range(4 * SIDE):
        least[:, k] = np.minimum.reduceat(flat * _FACTORS[k] + _SHIFTS[k], first) if len(sets) else 0
    return mixed(mixed(least[:, 0::2]) * U64(3) + least[:, 1::2])


def table_keys(halves: np.ndarray) -> np.ndarray:
    """A row of ``SIDE ** 2`` keys for each row of minhash pairs."""
    left, right = halves[:, :SIDE, None], halves[:, None, SIDE:]
    table = np.arange(SIDE**2, dtype=U64).reshape(1, SIDE, SIDE)
    return mixed(mixed(left + table) * U64(5) + right).reshape(len(halves), -1)


def _sketch_table(docs: DataFrame) -> DataFrame:
    def run(batches):
        for part in steps(batches, "text"):
            sets = shingle_sets(part.column("text"))
            some = np.flatnonzero([len(x) > 0 for x in sets])
            first = np.cumsum([0, *(len(sets[i]) for i in some)])[:-1]
            flat = np.concatenate([sets[i] for i in some]) if len(some) else np.zeros(0, U64)
            names = [np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)]
            halves: list[bytes | None] = [None] * len(sets)
            if len(some):
                names[0][some] = np.add.reduceat(mixed(flat), first).view(np.int64)
                names[1][some] = np.add.reduceat(mixed(flat ^ U64(0xA5A5A5A5A5A5A5A5)), first).view(np.int64)
                for i, row in zip(some.tolist(), sketches([sets[i] for i in some]), strict=True):
                    halves[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), *map(pa.array, names), pa.array(halves, pa.binary())],
                ["doc_id", "n", "s1", "s2", "halves"],
            )

    return docs.mapInArrow(released(run), "doc_id long, n long, s1 long, s2 long, halves binary")


def _groups(keys: np.ndarray, nodes: np.ndarray):
    """Distinct (key, node) in order, the smallest node of each key, and how many it has."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes = keys[new], nodes[new]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(keys)))
    return keys, nodes, np.repeat(nodes[first], sizes), np.repeat(sizes, sizes)


def candidates(classes: DataFrame) -> DataFrame:
    """``kind``, ``a``, ``b``: pairs of small buckets; members and hubs of larger ones by key."""
    partitions = shuffle_partitions(classes.sparkSession)
    buckets = partitions * packed.BUCKETS

    def send(batches):
        for part in steps(batches, "halves", 1 << 20):
            nodes = part.column("node").to_numpy()
            halves = np.frombuffer(b"".join(part.column("halves").to_pylist()), U64).reshape(len(nodes), -1)
            keys = table_keys(halves)
            keys, nodes, hub, size = _groups(keys.ravel(), np.repeat(nodes, keys.shape[1]))
            large = size > SMALL
            sent = ~large | (nodes == hub)
            yield packed.pack(packed.bucket_of(keys[sent], buckets), 0, [keys[sent], nodes[sent], large[sent]], None)
            aside = large & ~sent
            yield packed.pack(packed.bucket_of(keys[aside] + nodes[aside].astype(U64), buckets), MEMBER, [keys[aside], nodes[aside]], None)

    def rows(kind, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["kind", "a", "b"])

    def meet(batches):
        for held in packed.bucket_groups(batches):
            if MEMBER in held:
                yield rows(MEMBER, *packed.unpack(held[MEMBER], ["u8", "i8"], False)[0])
            if 0 not in held:
                continue
            (keys, nodes, flags), *_ = packed.unpack(held[0], ["u8", "i8", "?"], False)
            hot = keys[flags]
            keys, nodes, hub, size = _groups(keys, nodes)
            large = (size > SMALL) | np.isin(keys, hot)
            pairs = [(nodes[:0], nodes[:0])]
            for step in range(1, SMALL):
                near = ~large[step:] & (keys[step:] == keys[:-step])
                pairs.append((nodes[:-step][near], nodes[step:][near]))
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            yield rows(EDGE, a[new], b[new])
            yield rows(MEMBER, keys[large], nodes[large])
            top = large & (nodes == hub)
            yield rows(HUB, keys[top], nodes[top])

    return bucket_rows(classes.select("node", "halves").mapInArrow(released(send), packed.ROWS), partitions).mapInArrow(released(meet), "kind int, a long, b long")


def full_sets(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id`` and the full set of every end of a pair; the texts are shuffled once.

    The joins here are sort-merge joins at any size: what they meet grows with the corpus.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()

    def sets(batches):
        for part in steps(batches, "text"):
            bodies = [x.tobytes() for x in shingle_sets(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(bodies, pa.binary())], ["doc_id", "body"])

    found = docs.join(ids.hint("merge"), "doc_id", "left_semi")
    return stored(found.mapInArrow(released(sets), "doc_id long, body binary"), "sets")


def verified(pairs: DataFrame, bodies: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``a``, ``b`` whose full sets have the similarity."""

    def compare(batches):
        for batch in batches:
            links = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    links.append(False)
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                links.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(links, pa.bool_()))

    a = bodies.select(F.col("doc_id").alias("a"), F.col("body").alias("x"))
    b = bodies.select(F.col("doc_id").alias("b"), F.col("body").alias("y"))
    return pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").mapInArrow(released(compare), "a long, b long")


def _rest(members: DataFrame, labels: DataFrame, bodies: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs of different components in larger buckets, by an exact prefix-filter join."""
    of = members.join(labels, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    several = of.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
    nodes = stored(of.join(several, "key", "left_semi").select("node", "comp").distinct(), "open")
    if nodes.isEmpty():
        return nodes.select(F.col("node").alias("a"), F.col("comp").alias("b"))

    def explode(batches):
        for part in steps(batches, "body"):
            flat, at = text_bytes(part.column("body"))
            sizes = np.diff(at) // 8
            of = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            columns = [part.column("node").take(of), part.column("comp").take(of), pa.array(np.repeat(sizes, sizes)), pa.array(flat.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "comp", "n", "shingle"])

    own = bodies.withColumnRenamed("doc_id", "node").join(nodes, "node").select("node", "comp", "body")
    rows = stored(own.mapInArrow(released(explode), "node long, comp long, n long, shingle long"), "shingles")
    often = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"))
    ranked = rows.join(often, "shingle").groupBy("node", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("order"))
    first = stored(
        ranked.select("node", "comp", "n", F.posexplode(F.expr(f"slice(order, 1, cast(n - ceil(n * {percent} / 100) + 1 as int)).shingle")).alias("at", "shingle")),
        "prefixes",
    )
    other = first.select("shingle", F.col("node").alias("b"), F.col("comp").alias("comp_b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
    # At the first shingle that two sets share, what is left of each has to hold all they share.
    left = F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b"))
    fits = (F.col("comp") < F.col("comp_b")) & ((100 + percent) * left >= percent * (F.col("n") + F.col("n_b")))
    return first.join(other, "shingle").filter(fits).select(F.col("node").alias("a"), "b").distinct()


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with passing(docs.sparkSession):
        return stored(_near_classes(docs), "near", keep=True)


def _near_classes(docs: DataFrame) -> DataFrame:
    rows = stored(_sketch_table(docs), "sketches")
    named = rows.filter("doc_id is not null and n > 0")
    classes = stored(named.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("node"), F.first("halves").alias("halves")), "classes")
    found = stored(candidates(classes), "candidates")
    texts = docs.filter("doc_id is not null")
    members = found.filter(f"kind = {MEMBER}").select(F.col("a").alias("key"), F.col("b").alias("node"))
    hubs = found.filter(f"kind = {HUB}").select(F.col("a").alias("key"), F.col("b").alias("hub"))
    stars = members.join(hubs, "key").filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    pairs = stored(found.filter(f"kind = {EDGE}").select("a", "b").unionByName(stars).distinct(), "pairs")
    bodies = full_sets(pairs, texts)
    links = stored(verified(pairs, bodies), "verified")
    labels = components(links)
    # A larger bucket's members all stand in a pair with its hub, so their sets are at hand.
    more = stored(_rest(members, labels, bodies), "pairs")
    if not more.isEmpty():
        labels = components(links.unionByName(stored(verified(more, bodies), "verified")))
    names = classes.join(labels, "node", "left").select("s1", "s2", "n", F.coalesce("comp", "node").alias("component_id"))
    # Equal sets can be a third of all rows: their documents are joined by the row, and adaptive
    # execution splits such a partition.
    joined = named.select("doc_id", "s1", "s2", "n").join(names, ["s1", "s2", "n"]).select("doc_id", "n", "component_id")
    rest = rows.filter("doc_id is null or n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return joined.unionByName(rest).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def query(spark, sf_dir):
    from strata.llm.common import read_sized

    return near_classes(read_sized(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^ \t\n\x0b\f\r]+') AS words
    FROM documents
), each AS (
    SELECT doc_id, len(words) AS total, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM texts
), shingles AS (
    SELECT DISTINCT doc_id, key FROM (
        SELECT doc_id, pos, total, string_agg(word, ' ') OVER frame AS key, count(*) OVER frame AS n FROM each
        WINDOW frame AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)
    ) WHERE n = least(5, total) AND (total >= 5 OR pos = 1)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
    FROM shingles x JOIN shingles y ON x.key = y.key AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * common >= 75 * (x.n + y.n - common)
), directed AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT r.doc_id, l.b FROM reached r JOIN directed l ON r.other = l.a
), smallest AS (
    SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM smallest LEFT JOIN sizes USING (doc_id)
"""
