"""Centroid clustering of integer vectors with an equal-average equal-variance search.

For vectors x and centroids c of d components, with sums S and deviations V (the root of the
summed squared distance from the mean), d * (S_x/d - S_c/d)^2 + (V_x - V_c)^2 never exceeds their
squared distance. Centroids are sorted by their sums, and every vector scans them outward from its
own. It stops where the first term alone exceeds its best distance, skips centroids where both do,
and computes the others in integers. A centroid is rejected only where the bound is above the best
distance by more than rounding can explain, so the result is exact, ties included.

A vector is kept if it has exactly ``DIMS`` components, none null or non-finite; others, and null
vectors, have no row. A null vec_id hashes like an empty one. Repeated rows are vectors of their
own; those that share a vec_id and thus a hash start as centroids in the order of their components.
Fewer vectors than ``CLUSTERS`` start fewer centroids, and no vectors give no rows. Integers beyond
2**27 have squared distances that a long cannot hold; they are an error.

Each round reads the vectors, sums them per task and cluster, and adds the sums in Spark. The driver
sees ``CLUSTERS`` rows a round.
"""

from __future__ import annotations

import hashlib
import heapq
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.common import long_ids, read, released, stored

DIMS = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
#: Vectors that are compared at a time.
BLOCK = 4096
#: Beyond this a squared distance could exceed a long.
LARGEST = 1 << 27


def integers(column: pa.Array, dims: int = DIMS, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``column`` that are kept, and floor(scale * x) of their components."""
    right = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    rows = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    values = column.take(pa.array(rows)).flatten()
    full = values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)  # a null becomes NaN
    finite = np.isfinite(full).all(axis=1)
    if not finite.all():
        rows, full = rows[finite], full[finite]
    whole = np.floor(full * scale)
    if len(whole) and np.abs(whole).max() > LARGEST:
        raise OverflowError(f"a component times {scale} is beyond {LARGEST}; its squared distance does not fit a long")
    return rows, whole.astype(np.int64)


def _moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of each row, and its deviation from its mean."""
    sums = x.sum(axis=1)
    off = x - (sums / x.shape[1])[:, None]
    return sums, np.sqrt(np.einsum("ij,ij->i", off, off))


class Search:
    """Nearest of a few centroids, the smaller number where several are."""

    def __init__(self, centroids: np.ndarray):
        sums, deviations = _moments(centroids)
        self.number = np.lexsort((np.arange(len(sums)), sums))
        self.centroids = centroids[self.number]
        self.sums, self.deviations = sums[self.number], deviations[self.number]
        self.compared = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each row."""
        found = [self._block(x[b : b + BLOCK]) for b in range(0, len(x), BLOCK)]
        empty = np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found] or [empty]), np.concatenate([f[1] for f in found] or [empty])

    def _block(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        many, dims = len(self.sums), x.shape[1]
        sums, deviations = _moments(x)
        # Rounding of the bounds is far below this share of the squared lengths.
        slack = 1e-9 * (sums.astype(float) ** 2 / dims + deviations**2 + self._energy(dims)) + 1
        best, number = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), many)
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        rows = np.arange(len(x))
        while len(rows):
            own, low, high = sums[rows], left[rows], right[rows]
            below = np.where(low >= 0, own - self.sums[np.maximum(low, 0)], np.inf)
            above = np.where(high < many, self.sums[np.minimum(high, many - 1)] - own, np.inf)
            bound = np.minimum(below, above) ** 2 / dims - slack[rows]
            going = bound <= best[rows]  # all further centroids have other means still
            rows, low, high, bound, down = rows[going], low[going], high[going], bound[going], (below <= above)[going]
            at = np.where(down, low, high)
            left[rows[down]] -= 1
            right[rows[~down]] += 1
            near = bound + (deviations[rows] - self.deviations[at]) ** 2 <= best[rows]
            close, at = rows[near], at[near]
            off = x[close] - self.centroids[at]
            distance = np.einsum("ij,ij->i", off, off)
            self.compared += len(close)
            named = self.number[at]
            better = (distance < best[close]) | ((distance == best[close]) & (named < number[close]))
            best[close[better]], number[close[better]] = distance[better], named[better]
        return number, best

    def _energy(self, dims: int) -> float:
        return float(np.max(self.sums.astype(float) ** 2 / dims + self.deviations**2))


def _vectors(table: DataFrame) -> DataFrame:
    kind = table.schema["embedding"].dataType
    vector = F.col("embedding")
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))):
        vector = vector.cast("array<double>")
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, dims: int = DIMS, seed: str = "1") -> np.ndarray:
    """The vectors with the smallest hashes of seed and vec_id, in the order of these."""

    def run(batches):
        for batch in batches:
            rows, x = integers(batch.column("embedding"), dims)
            ids = batch.column("vec_id").take(pa.array(rows)).to_pylist()
            hashes = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest() for i in ids]
            last = heapq.nsmallest(clusters, set(hashes))[-1:]
            may = [i for i, h in enumerate(hashes) if h <= last[0]]
            kept = heapq.nsmallest(clusters, may, key=lambda i: (hashes[i], x[i].tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashes[i] for i in kept], pa.string()), pa.array([x[i].tolist() for i in kept], pa.list_(pa.int64()))],
                ["hash", "vector"],
            )

    found = vectors.mapInArrow(released(run), "hash string, vector array<long>").orderBy("hash", "vector").limit(clusters)
    return np.array([r.vector for r in found.collect()], np.int64).reshape(-1, dims)


def next_centroids(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid that has vectors replaced by the floor of their mean."""
    dims = centroids.shape[1]

    def run(batches):
        search = Search(centroids)
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            _, x = integers(batch.column("embedding"), dims)
            cluster, _ = search.nearest(x)
            order = np.argsort(cluster, kind="stable")
            own, first = np.unique(cluster[order], return_index=True)
            if len(own):
                sums[own] += np.add.reduceat(x[order], first, axis=0)
                counts += np.bincount(cluster, minlength=len(centroids))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))],
            ["cluster", "n", "sums"],
        )

    partial = vectors.mapInArrow(released(run), "cluster int, n long, sums array<long>")
    totals = [F.sum(F.col("sums")[j].cast("decimal(38, 0)")).alias(f"s{j}") for j in range(dims)]
    changed = centroids.copy()
    for row in partial.groupBy("cluster").agg(F.sum("n").alias("n"), *totals).collect():
        changed[row.cluster] = [int(row[f"s{j}"]) // row.n for j in range(dims)]
    return changed


def clustered(table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS) -> tuple[DataFrame, np.ndarray]:
    """``vec_id``, ``cluster`` and squared ``distance`` of every kept vector, and the centroids."""
    vectors = _vectors(table)
    centroids = first_centroids(vectors, clusters, dims)
    if not len(centroids):
        return table.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    for _ in range(rounds):
        centroids = next_centroids(vectors, centroids)

    def run(batches):
        search = Search(centroids)
        for batch in batches:
            rows, x = integers(batch.column("embedding"), dims)
            cluster, distance = search.nearest(x)
            ids = long_ids(batch.column("vec_id").take(pa.array(rows)))
            absent = batch.column("vec_id").take(pa.array(rows)).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=absent), pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"]
            )

    return vectors.mapInArrow(released(run), "vec_id long, cluster int, distance long"), centroids


def query(spark, sf_dir):
    found, centroids = clustered(read(spark, sf_dir, "embeddings"))
    found = stored(found, "clusters", keep=True)
    exact = F.sum(F.col("distance").cast("decimal(38, 0)"))
    inertia = {r.cluster: r.d for r in found.groupBy("cluster").agg(exact.alias("d")).collect()}
    total = sum(inertia.values(), Decimal(0))
    rows = [
        (c, int(d), int(total), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
        for c, d in inertia.items()
    ]
    sums = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(sums), "cluster").select("vec_id", *(c for c in ("cluster", "distance", *sums.columns[1:])))


def _round(k: int) -> str:
    """SQL of an assignment to the centroids k and of the centroids k + 1."""
    return f"""
    distances{k} AS MATERIALIZED (
        SELECT v.row, c.number, sum((v.x - c.x) * (v.x - c.x)) AS distance
        FROM parts AS v JOIN centroids{k} AS c USING (place) GROUP BY ALL
    ), nearest{k} AS MATERIALIZED (
        SELECT row, arg_min(number, (distance, number)) AS number, min(distance) AS distance FROM distances{k} GROUP BY row
    ), sums{k} AS (
        SELECT number, place, sum(x) AS s, count(*) AS n FROM nearest{k} JOIN parts USING (row) GROUP BY ALL
    ), centroids{k + 1} AS MATERIALIZED (
        SELECT c.number, c.place, CASE WHEN s IS NULL THEN c.x ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS x
        FROM centroids{k} AS c LEFT JOIN sums{k} USING (number, place)
    )"""


ORACLE = f"""
    WITH kept AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id,
            list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
        FROM embeddings
        WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}
    ), parts AS MATERIALIZED (
        SELECT row, unnest(generate_series(1, {DIMS})) AS place, unnest(vector) AS x FROM kept
    ), starts AS (
        SELECT row, row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), vector) - 1 AS number
        FROM kept QUALIFY number < {CLUSTERS}
    ), centroids0 AS MATERIALIZED (
        SELECT number, place, x FROM starts JOIN parts USING (row)
    ), {",".join(_round(k) for k in range(ROUNDS + 1))},
    clusters AS (
        SELECT number, sum(distance) AS inertia FROM nearest{ROUNDS} GROUP BY number
    ), hashes AS (
        SELECT number, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY place)) AS hash FROM centroids{ROUNDS} GROUP BY number
    )
    SELECT vec_id, CAST(number AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
        CAST(inertia AS BIGINT) AS cluster_inertia, CAST((SELECT sum(inertia) FROM clusters) AS BIGINT) AS inertia,
        hash AS centroid_sha256
    FROM nearest{ROUNDS} JOIN kept USING (row) JOIN clusters USING (number) JOIN hashes USING (number)
"""
