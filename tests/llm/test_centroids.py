"""Clustering in integers, and the search among centroids by mean and deviation."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from strata.llm import centroids
from strata.llm.centroids import Search

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("cluster", T.LongType())])


def nearest(x, all_):
    return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(all_))


def plain_answer(rows, clusters=16, rounds=3, dims=64):
    """(vec_id, cluster, distance) by comparing everything with everything."""
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x):
            key = hashlib.sha256(f"1:{'' if vec_id is None else vec_id}".encode()).hexdigest()
            kept.append((key, [math.floor(64 * float(np.float32(v))) for v in x], vec_id))
    centers = [x for _, x, _ in sorted(kept, key=lambda r: r[:2])[:clusters]]
    for _ in range(rounds):
        groups = {}
        for _, x, _ in kept:
            groups.setdefault(nearest(x, centers)[1], []).append(x)
        centers = [[sum(col) // len(groups[k]) for col in zip(*groups[k], strict=True)] if k in groups else c for k, c in enumerate(centers)]
    found = [(vec_id, *reversed(nearest(x, centers))) for _, x, vec_id in kept]
    return found, centers


@pytest.mark.parametrize("spread", [0, 3, 40, 1 << 26])
def test_search_is_exact_with_ties(spread):
    rng = np.random.default_rng(spread)
    centers = rng.integers(-spread, spread + 1, (16, 64))
    centers[5] = centers[2]  # a tie goes to the smaller number
    centers[9] = -centers[3]
    x = np.concatenate([rng.integers(-spread, spread + 1, (300, 64)), centers, np.zeros((2, 64), np.int64)])
    number, distance = Search(centers).nearest(x)
    full = ((x[:, None, :].astype(object) - centers[None].astype(object)) ** 2).sum(2)
    assert distance.tolist() == full.min(1).tolist()
    assert number.tolist() == [row.index(min(row)) for row in full.tolist()]


def test_most_centroids_are_rejected_by_the_bounds():
    rng = np.random.default_rng(1)
    centers = rng.integers(-5, 6, (16, 64)) + np.arange(16)[:, None] * 50
    x = centers[rng.integers(0, 16, 1000)] + rng.integers(-3, 4, (1000, 64))
    search = Search(centers)
    search.nearest(x)
    assert search.compared < 3 * len(x)


def test_deviation_alone_rejects():
    rng = np.random.default_rng(2)
    signs = rng.choice([-1, 1], (16, 64))
    signs[:, 32:] = -signs[:, :32]  # every mean is 0
    centers = signs * (np.arange(16)[:, None] * 40 + 1)
    search = Search(centers)
    number, _ = search.nearest(centers)
    assert number.tolist() == list(range(16)) and search.compared < 16 * 16


def test_vectors_that_are_kept():
    good = [0.5] * 64
    column = pa.array([good, None, [], good[:63], [*good, 1.0], [None, *good[1:]], [math.nan, *good[1:]], [math.inf, *good[1:]], [-0.01] * 64], pa.list_(pa.float32()))
    rows, x = centroids.integers(column.slice(0))
    assert rows.tolist() == [0, 8] and x[0].tolist() == [32] * 64 and x[1].tolist() == [-1] * 64
    rows, x = centroids.integers(column.slice(4))
    assert rows.tolist() == [4]
    with pytest.raises(OverflowError):
        centroids.integers(pa.array([[1e30] * 64], pa.list_(pa.float32())))


def test_rows_equal_the_plain_answer(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(120, 64)).astype(np.float32)
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    rows += [(3, points[3].tolist())] * 5 + [(4, points[5].tolist()), (None, points[6].tolist()), (None, points[7].tolist())]
    rows += [(200, None), (201, []), (202, [1.0]), (203, [math.nan] * 64), (204, [None] * 64)]
    table = spark.createDataFrame([(*r, 9) for r in rows], SCHEMA).repartition(5)
    found, centers = centroids.clustered(table)
    expected, by_hand = plain_answer(rows)
    assert centers.tolist() == by_hand
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected))


def test_few_equal_and_no_vectors(spark):
    same = [(i, [0.25] * 64, 0) for i in range(40)]
    got, centers = centroids.clustered(spark.createDataFrame(same, SCHEMA))
    assert {tuple(r)[1:] for r in got.collect()} == {(0, 0)} and len(centers) == 16
    got, centers = centroids.clustered(spark.createDataFrame(same[:3], SCHEMA))
    assert got.count() == 3 and len(centers) == 3
    got, centers = centroids.clustered(spark.createDataFrame([], SCHEMA))
    assert got.collect() == [] and got.columns == ["vec_id", "cluster", "distance"]


def test_query_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = centroids.query(spark, str(tmp_path))
    assert got.count() == 0
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
