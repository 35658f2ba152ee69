"""Cuts at token boundaries, from the containers up."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from strata.llm import fill_middle
from strata.llm.fill_middle import ARRAY, BITMAP, RUNS, BoundarySet, Container

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")


def plain_answer(doc_id, text):
    """What the contract says, token by token."""
    text, digest = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    tokens, h = TOKEN.findall(text), [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    spm = h[3] % 100 < 20
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, "spm" if spm else "psm", len(prefix), len(middle), out


@pytest.mark.parametrize(
    ("kind", "lows"),
    [
        (ARRAY, np.array([0, 5, 63, 64, 65535])),
        (BITMAP, np.flatnonzero(np.random.default_rng(1).random(1 << 16) < 0.4)),
        (RUNS, np.concatenate([np.arange(10, 4000), np.arange(5000, 5001), np.arange(60000, 65536)])),
        (RUNS, np.arange(1 << 16)),
    ],
)
def test_containers_select_and_rank(kind, lows):
    box = Container(lows.astype(np.int64))
    assert box.kind == kind
    assert box.select(np.arange(len(lows))).tolist() == lows.tolist()
    assert box.rank(np.arange(1 << 16)).tolist() == np.searchsorted(lows, np.arange(1 << 16), "right").tolist()


def test_sets_of_several_containers():
    rng = np.random.default_rng(2)
    mixed = [rng.choice(1 << 16, 30, False), np.flatnonzero(rng.random(1 << 16) < 0.5), np.arange(100, 60000)]
    positions = np.concatenate([np.sort(x) + (high << 16) for high, x in zip((1, 2, 7), mixed, strict=True)])
    bounds = BoundarySet(positions)
    assert [c.kind for c in bounds.containers] == [ARRAY, BITMAP, RUNS]
    ranks = rng.permutation(len(positions))
    assert bounds.select(ranks).tolist() == positions[ranks].tolist()
    at = rng.integers(0, 9 << 16, 5000)
    assert bounds.rank(at).tolist() == np.searchsorted(positions, at, "right").tolist()
    assert len(BoundarySet(np.zeros(0, np.int64))) == 0
    assert BoundarySet(np.zeros(0, np.int64)).rank(np.arange(3)).tolist() == [0, 0, 0]


def test_ends_are_those_of_the_pattern():
    rng = random.Random(3)
    texts = [None, "", "x", "ab", "日本", "a日b", "\n\r\n ", *("".join(rng.choice("abZ 1é日😀\n") for _ in range(40)) for _ in range(200))]
    data, offsets = fill_middle.text_bytes(pa.array(texts))
    found = fill_middle.token_ends(data, offsets)
    expected = []
    for text, base in zip(texts, offsets.tolist(), strict=False):
        at = base
        for token in TOKEN.findall(text or ""):
            at += len(token.encode())
            expected.append(at)
    assert found.tolist() == expected


def test_rows_equal_the_plain_answer(documents):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(["word", " ", "é", "日", "1", ".\n", "😀"]) for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [(None, "no id here"), (None, None), (7, "again and again"), (7, "again and again"), (8, "has <S> inside"), (9, "<P"), (10, "S>")]
    rows += [(-5, "minus"), (2**62, "large id"), (11, "ab " * 100_000), (12, "日" * 70_000), (13, "x" * 200_000)]
    docs = documents(rows).selectExpr("*", "1 as n", "'x' as form", "2 as h1", "'y' as output")
    made = fill_middle.fill_in_middle(docs)
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(repr(plain_answer(*r)) for r in rows)
    back = made.select("doc_id", fill_middle.restored().alias("text")).collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(repr((d, t or "")) for d, t in rows)


def test_ties_of_both_cuts_and_empty_tables(documents):
    made = [plain_answer(i, "a") for i in range(200)]
    assert any(r[3] == 0 and r[4] == 0 for r in made) and any(r[4] == 1 for r in made)
    got = fill_middle.fill_in_middle(documents([(i, "a") for i in range(200)])).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == made
    empty = fill_middle.fill_in_middle(documents([]))
    assert empty.count() == 0 and empty.columns[:3] == ["doc_id", "n", "form"]
