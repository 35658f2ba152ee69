"""Suffix, window and near-duplicate operators against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from strata.llm import common, near_dups, packed, substrings, suffixes
from strata.llm.components import components
from strata.session import input_bytes

from . import brute

PIECES = ["alpha", "beta", "gamma", "delta", "épée", "日本", "omega", "x"]


def corpus(seed, n=40):
    """Texts that share long passages, whole and cut, repeat themselves or hold nothing."""
    rng = random.Random(seed)

    def prose(k):
        return " ".join(rng.choice(PIECES) + str(rng.randrange(30)) for _ in range(k))

    passages = [prose(25) for _ in range(3)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "a" * 700), (4, "ab" * 300), (5, "one two three")]
    for i in range(6, n):
        parts = [prose(rng.randrange(1, 40))]
        if rng.random() < 0.6:
            parts.append(rng.choice(passages)[rng.randrange(20) :])
        if rng.random() < 0.2:
            parts *= 2
        rows.append((i * 3, "\n".join(parts)))
    rows += [(200 + i, rows[8][1]) for i in range(4)]  # copies
    rows += [(300, rows[9][1]), (300, rows[9][1]), (None, rows[10][1]), (None, None)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_matches_brute_force(documents, seed):
    rows = corpus(seed)
    got = suffixes.suffix_dedup(documents(rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute.suffix_rows(rows)))


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_matches_brute_force(documents, seed):
    rows = corpus(seed)
    got = substrings.substring_dedup(documents(rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute.window_rows(rows)))


def test_hot_keys_travel_alone_with_the_same_result(documents, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(packed, "hot_keys", lambda docs, keys_of, steps_of: _all_keys(docs, keys_of, steps_of))
    got = suffixes.suffix_dedup(documents(rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute.suffix_rows(rows)))
    got = substrings.substring_dedup(documents(rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute.window_rows(rows)))


def _all_keys(docs, keys_of, steps_of):
    keys = [keys_of(part) for part in steps_of(docs.toArrow().to_batches())]
    return np.unique(np.concatenate(keys))[::2]  # every other key is hot


def test_hot_keys_finds_frequent_keys(documents):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60)) + " the one line that all of these many documents have in common for good") for i in range(60)]
    docs = substrings.keyed(documents(rows))
    hot = packed.hot_keys(docs, lambda part: substrings._Cut(part, 13, 3).keys(), lambda b: common.steps(b, "text"))
    assert 1 <= len(hot) <= 2 * packed.HOT_SHARE


def test_whole_characters_only():
    text = np.frombuffer("aé日b".encode(), np.uint8)
    gone = np.array([0, 0, 1, 1, 1, 1, 1], bool)  # half of é, all of 日, b
    assert text[~suffixes.whole_characters(text, gone)].tobytes().decode() == "aé"


def test_without_repeats_keeps_columns_and_drops_what_is_all_repeat(documents):
    passage = " ".join(f"word{i}" for i in range(40))
    rows = [(1, passage), (2, "before " + passage + " after"), (3, passage), (4, ""), (None, "alone")]
    got = {r.doc_id: r for r in suffixes.without_repeats(documents(rows)).collect()}
    assert set(got) == {1, 2, 4, None}
    assert got[1].text == passage and got[2].text == "before  after" and got[2].n_chars == 13


def near_corpus(seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    rows = [(0, None), (1, "  "), (2, "two words"), (3, "Two WORDS"), (4, "other words here")]
    for i in range(5, 45):  # edits of one text around the threshold
        own = list(base)
        for _ in range(rng.randrange(6)):
            own[rng.randrange(len(own))] = f"new{rng.randrange(1000)}"
        rows.append((i, " ".join(own)))
    line = " ".join(f"common{k}" for k in range(12))
    rows += [(100 + i, line + f" own{i} " + " ".join(f"t{i}x{k}" for k in range(i % 4))) for i in range(40)]
    rows += [(200 + i, " ".join(f"r{i}x{k}" for k in range(50))) for i in range(10)]
    rows += [(300 + i, rows[20][1].upper()) for i in range(12)]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_classes_match_all_pairs(documents, seed):
    rows = near_corpus(seed)
    got = sorted(map(tuple, near_dups.near_classes(documents(rows)).collect()))
    assert got == sorted(brute.near_rows(rows))


def test_near_classes_without_an_id_and_repeated_rows(documents):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(None, text), (None, text), (7, text), (7, text), (9, text)]
    got = sorted(map(repr, map(tuple, near_dups.near_classes(documents(rows)).collect())))
    n = len(brute.shingles(text))
    assert got == sorted(map(repr, [(7, n, 7, True)] * 2 + [(9, n, 7, False)] + [(None, n, None, True)] * 2))


def test_tensored_keys_find_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    found = 0
    for _ in range(200):
        pool = rng.integers(0, 2**63, 700, dtype=np.uint64)
        a, b = np.unique(pool[:600]), np.unique(np.concatenate([pool[:514], pool[600:686]]))  # 514 / 686 = 0.749
        keys = near_dups.table_keys(near_dups.sketches([a, b]))
        found += bool((keys[0] == keys[1]).any())
    assert found == 200


def test_exact_join_finds_links_that_stars_miss(documents):
    rows = near_corpus(1)[5:45]
    docs = documents(rows)
    members = docs.sparkSession.createDataFrame([(1, d) for d, _ in rows], "key long, node long")
    none = docs.sparkSession.createDataFrame([], "node long, comp long")
    everyone = members.selectExpr("node as a", "node as b")
    bodies = near_dups.full_sets(everyone, docs.select("doc_id", "text"))
    pairs = near_dups._rest(members, none, bodies)
    links = {(r.a, r.b) for r in near_dups.verified(pairs, bodies).collect()}
    sets = {d: brute.shingles(t) for d, t in rows}
    expected = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert {tuple(sorted(x)) for x in links} == expected


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)] + [(500, 500)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(20)}


@pytest.mark.parametrize("operator", [suffixes.suffix_dedup, substrings.substring_dedup, near_dups.near_classes])
def test_empty_table_and_clashing_columns(documents, operator):
    assert operator(documents([])).count() == 0
    docs = documents([(1, "some text"), (2, "other text")])
    for name in ("fp", "bucket", "n", "key", "node", "kept", "body"):
        docs = docs.selectExpr("*", f"'x' as {name}")
    assert operator(docs).count() == 2


def test_sliding_least_is_leftmost():
    keys = np.array([5, 3, 3, 9, 1, 1, 7], np.uint64) << np.uint64(40)
    assert substrings.sliding_least(keys, 3).tolist() == [1, 1, 4, 4, 4]


def test_steps_cover_all_rows_within_their_size():
    texts = ["a" * n for n in (10, 0, 500, 20, 20, 20)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["id", "text"])
    parts = list(common.steps([batch], "text", 50))
    assert [x for p in parts for x in p.column("id").to_pylist()] == list(range(7))
    assert max(p.num_rows for p in parts) > 1


def test_shuffles_follow_the_size_of_the_table(spark, documents, tmp_path, monkeypatch):
    """The session's number holds for small tables only, and stays what it was."""
    documents(corpus(3)).write.parquet(f"{tmp_path}/documents.parquet")
    before = common.shuffle_partitions(spark)
    small = common.read_sized(spark, str(tmp_path), "documents")
    assert common.shuffle_partitions(small.sparkSession) == before
    expected = sorted(map(repr, suffixes.query(spark, str(tmp_path)).collect()))
    size = input_bytes(small)
    monkeypatch.setattr(common, "PARTITION_BYTES", -(-size // 23))
    large = common.read_sized(spark, str(tmp_path), "documents")
    assert common.shuffle_partitions(large.sparkSession) == 23
    assert "hashpartitioning(bucket#" in (plan := large_plan(suffixes.query(spark, str(tmp_path)))) and ", 23)" in plan
    assert sorted(map(repr, suffixes.query(spark, str(tmp_path)).collect())) == expected
    assert common.shuffle_partitions(spark) == before


def large_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
