"""The convolutional classifier against plain loops, and toxicity on held-out documents."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from strata.llm import common, convolution, toxicity
from strata.llm.convolution import BUCKETS, DIMS, FILTERS, PREFIXES, WIDTHS, Classifier, Texts

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType()), T.StructField("text", T.StringType())])
ODD = [None, "", "1 2 3", "one", "One, two! three", "é日本 ab", "a b a b", "word " * 50]


def plain_pooled(model, texts, t):
    """Greatest filter values of text ``t``, place by place."""
    numbers = texts.places[texts.begins[t] : texts.begins[t] + texts.words[t]].tolist()
    vectors = [model.table[texts.features[i]].sum(0) for i in numbers] + [np.zeros(DIMS)] * max(WIDTHS)
    out = np.zeros((len(WIDTHS), FILTERS))
    for w, size in enumerate(WIDTHS):
        for i in range(max(len(numbers), 1)):
            offset = sum(WIDTHS[:w])
            value = model.bias[w] + sum(vectors[i + k] @ model.filters[offset + k] for k in range(size))
            out[w] = np.maximum(out[w], value)
    return out


@pytest.mark.parametrize("places", [1 << 15, 7, 1])
def test_pooling_equals_plain_loops(monkeypatch, places):
    monkeypatch.setattr(convolution, "PLACES", places)
    model = Classifier(5)
    model.bias += np.random.default_rng(0).normal(0, 0.1, model.bias.shape).astype(np.float32)
    texts = Texts(pa.array(ODD))
    expected = np.array([plain_pooled(model, texts, t) for t in range(len(ODD))])
    assert np.allclose(model.pooled(texts), expected, atol=1e-5)


def test_features_are_the_word_and_its_prefixes():
    texts = Texts(pa.array(["Idiots idiots ab", "idiot"]))
    numbers = texts.places[texts.begins[0] : texts.begins[0] + 3]
    same, other = texts.features[numbers[0]], texts.features[texts.places[texts.begins[1]]]
    assert numbers[0] == numbers[1] and (same < BUCKETS).sum() == 1 + sum(p <= 6 for p in PREFIXES)
    assert same[0] != other[0] and same[1:4].tolist() == other[1:4].tolist() and other[4] == BUCKETS
    assert (texts.features[numbers[2]] < BUCKETS).sum() == 1


def test_gradients_equal_differences():
    texts, labels = Texts(pa.array(["some bad words here", "good words", "", "bad"])), np.array([1, 0, 0, 1])
    model, chosen, weights = Classifier(3), np.array([0, 1, 3, 2]), np.full(4, 0.25)
    for name in Classifier.NAMES:
        setattr(model, name, getattr(model, name).astype(float))
    model.bias += np.random.default_rng(4).normal(0, 0.1, model.bias.shape)  # away from the kink at 0
    _, found = model.gradients(texts, chosen, labels[chosen], weights)

    def loss():
        return model.gradients(texts, chosen, labels[chosen], weights)[0]

    rows, table = found.pop("table")
    found["table"] = np.zeros(model.table.shape)
    found["table"][rows] = table
    rng, step = np.random.default_rng(1), 1e-4
    for name, slope in found.items():
        own = getattr(model, name)
        places = np.argwhere(np.abs(slope) > 1e-6)
        for at in map(tuple, places[rng.permutation(len(places))[:8]]):
            kept = own[at]
            own[at] = kept + step
            up = loss()
            own[at] = kept - step
            down = loss()
            own[at] = kept
            assert (up - down) / (2 * step) == pytest.approx(slope[at], rel=2e-2, abs=3e-5)


def test_weights_pack_and_open():
    model = Classifier(2)
    again = Classifier.opened(model.packed())
    assert all(np.array_equal(getattr(model, n), getattr(again, n)) for n in Classifier.NAMES)


def test_thresholds_part_the_labels_best():
    scores, labels = np.array([0.1, 0.2, 0.3, 0.35, 0.9]), np.array([0, 0, 1, 1, 1])
    assert toxicity.best_threshold(scores, labels) == pytest.approx(0.25)
    assert toxicity.best_threshold(np.array([0.2, 0.8]), np.array([0, 1])) == 0.5
    assert toxicity.best_threshold(np.array([0.4, 0.4]), np.array([0, 1])) == 0.5


def _rows(n=400):
    """Documents in two languages, toxic ones with one of a few words somewhere."""
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(n):
        own = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in rng.integers(0, 200, 30)]
        bad = i % 4 == 0
        if bad:
            own.insert(int(rng.integers(0, 30)), ["vile", "nasty", "awful"][int(rng.integers(0, 3))])
        rows.append((i, " ".join(own)))
        labels.append((i, int(bad), "clash"))
    return rows, labels


def test_held_out_documents_and_odd_rows(spark, documents):
    rows, labels = _rows()
    odd = [(None, "vile words"), (None, None), (3, rows[3][1]), (3, rows[3][1]), (5000, ""), (5001, None), (5002, "nasty " * 200_000), (5003, "12 34 !!")]
    docs = documents(rows + odd).selectExpr("*", "1 as score", "'x' as held_out", "0 as toxic")
    told = spark.createDataFrame([*labels, (3, 0, ""), (3, None, ""), (None, 1, ""), (9000, 1, ""), (7, 5, "")], LABELS)
    got = toxicity.toxicity(docs, told)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    found = got.collect()
    assert len(found) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in found}
    for r in found:
        name = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (zlib.crc32(name.encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.flagged == int(r.score >= r.threshold)
    held = [by_id[i] for i, _ in rows if by_id[i].held_out]
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.95
    assert by_id[5002].predicted == 1
    assert by_id[5000].score == by_id[5001].score == by_id[5003].score


def test_scores_do_not_depend_on_layout_or_language(spark, documents):
    rows, labels = _rows(200)
    told = spark.createDataFrame(labels, LABELS)
    docs = documents(rows)
    first = {r.doc_id: r.score for r in toxicity.toxicity(docs.repartition(7), told).collect()}
    second = {r.doc_id: r.score for r in toxicity.toxicity(docs.coalesce(1).selectExpr("doc_id", "text", "'zz' as lang"), told.repartition(3)).collect()}
    assert first == second


def test_sample_is_bounded_and_learns_no_held_out_row(spark, documents):
    rows, labels = _rows(100)
    sample = toxicity.labelled_sample(documents(rows * 3), spark.createDataFrame(labels * 2, LABELS), 10).collect()
    assert len(sample) == 20 and sum(r.toxic for r in sample) == 10
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in sample)


@pytest.mark.parametrize("labels", [[], [(1, 0, "")], [(1, 1, ""), (2, 1, "")]])
def test_without_both_labels_scores_are_zero(spark, documents, labels):
    got = toxicity.toxicity(documents([(1, "a"), (2, "b"), (3, None)]), spark.createDataFrame(labels, LABELS))
    assert {(r.score, r.predicted) for r in got.collect()} == {(0.0, 0)}
    assert toxicity.toxicity(documents([]), spark.createDataFrame(labels, LABELS)).count() == 0


def test_held_out_accuracy_on_the_sample_tables(spark, sf_dir):
    got = toxicity.query(spark, sf_dir).join(common.read(spark, sf_dir, "labels"), "doc_id").filter("held_out").collect()
    clean = [r.predicted for r in got if r.toxic == 0]
    assert np.mean(clean) < 0.1


def _many(n_toxic, n_clean):
    """Ids that may be learned from, toxic ones first and in the order of their hashes, and some held-out ids."""
    known = [i for i in range(2 * (n_toxic + n_clean)) if zlib.crc32(str(i).encode()) % 5]
    held = [i for i in range(n_toxic + n_clean) if not zlib.crc32(str(i).encode()) % 5]
    return known[:n_toxic], known[n_toxic : n_toxic + n_clean], held[:60]


def test_words_of_late_labelled_documents_are_learned(spark, documents, monkeypatch):
    monkeypatch.setattr(toxicity, "PART_ROWS", 1000, raising=False)
    toxic, clean, held = _many(3300, 600)
    ranks = {r.id: r.rank for r in spark.createDataFrame([(i,) for i in toxic], "id long").selectExpr("id", "xxhash64(id) AS rank").collect()}
    late = set(sorted(toxic, key=ranks.get)[3000:])  # behind the 3,000 smallest hashes
    rows = [(i, "some plain words hidden" if i in late else "some plain words vile") for i in toxic]
    rows += [(i, "some plain words") for i in clean]
    rows += [(i, "some plain words hidden" if k % 2 else "some plain words") for k, i in enumerate(held)]
    told = spark.createDataFrame([(i, 1, "") for i in toxic] + [(i, 0, "") for i in clean], LABELS)
    found = {r.doc_id: r.predicted for r in toxicity.toxicity(documents(rows), told).filter("held_out").collect()}
    assert [found[i] for i in held] == [k % 2 for k in range(len(held))]


def test_parts_hold_every_labelled_row_once_and_agree_in_any_layout(spark, documents, monkeypatch):
    monkeypatch.setattr(toxicity, "PART_ROWS", 40)
    monkeypatch.setattr(toxicity, "ADDED", 2)
    rows, labels = _rows(200)
    told = spark.createDataFrame(labels, LABELS)
    docs = documents([*rows, rows[3]])
    packs, parts, n = toxicity.packed_parts(docs, told)
    found = sorted((t, k) for r in packs.collect() for _, texts, _, toxic in toxicity._opened(_batch(r)) for t, k in zip(texts.to_pylist(), toxic.tolist(), strict=True))
    expected = sorted((text, int(i % 4 == 0)) for i, text in rows if zlib.crc32(str(i).encode()) % 5)
    assert found == expected and n == len(expected) and parts == -(-n // 40) == packs.count()
    first = toxicity.toxicity(docs.repartition(7), told).distinct().collect()
    second = toxicity.toxicity(docs.coalesce(1), told.repartition(3)).distinct().collect()
    assert set(first) == set(second) and len(first) == len(rows)


def _batch(row):
    return [pa.RecordBatch.from_pydict({"part": [row.part], "body": pa.array([bytes(row.body)], pa.binary())})]


def test_shares_average_to_the_weights_that_moved():
    start, first, second = Classifier(1), Classifier(1), Classifier(1)
    first.table[5] += 1
    second.table[5] += 3
    second.table[9] += 2
    second.base += 4
    found = start.average(first.share(start, 30) + second.share(start, 10))
    assert np.allclose(found.table[5], start.table[5] + 1.5) and np.allclose(found.table[9], start.table[9] + 2)
    assert np.array_equal(found.table[6], start.table[6]) and found.base[0] == 1 and np.allclose(found.filters, start.filters)
    alone = start.average(second.share(start, 7))
    assert all(np.array_equal(getattr(alone, n), getattr(second, n)) for n in Classifier.NAMES)


def test_thresholds_of_counted_scores_equal_those_of_rows():
    rng = np.random.default_rng(2)
    scores, labels = np.round(rng.random(300), 1), rng.integers(0, 2, 300)
    cells, times = np.unique(np.stack([scores, labels]), axis=1, return_counts=True)
    assert toxicity.best_threshold(scores, labels) == toxicity.best_threshold(cells[0], cells[1].astype(int), times)
