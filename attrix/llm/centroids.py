"""Centroid clustering (Lloyd's rounds on whole numbers) with Ptolemaic pivots.

Components become integers, so distances, sums and centroids are exact and every
rerun gives the same clusters.  For four points Ptolemy's inequality bounds one
distance by five others::

    d(x, c) >= |d(x, p) * d(c, q) - d(x, q) * d(c, p)| / d(p, q)

The pivots are fixed for all rounds (starting centroids, picked farthest first), so a
vector's distances to them are computed once and stored beside it.  In each round a
vector is checked exactly against the centroid of the least bound, then against every
centroid whose bound, over all pivot pairs, does not exceed what was found: bounds are
rounded down by more than their arithmetic can err, so a nearest centroid, ties
included, is never passed over.

Only the model passes the driver: ``k`` centroids and, per round, ``k`` x ``dims`` sums
(one partial row a cluster and task, added up by component).  Vectors never travel
after the first write; a vector that a third of the rows repeat is a sum like others.

Defined results: vectors with another number of components, null or non-finite ones
are not kept.  Vectors beyond ``LIMIT`` in any component, whose distances a long could
not hold, are returned with nulls and take no part.  A null ``vec_id`` hashes as an
empty text; rows that repeat an id start by their components' order; with fewer than
``k`` vectors there are as many centroids; an empty table gives no rows.  Extra columns
are dropped.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.llm.text import map_arrow, stash

K, ROUNDS, DIMS, SCALE, PIVOTS = 16, 3, 64, 64, 6
#: Components' bound: 64 squares of twice as much fit into 63 bits.
LIMIT = 1 << 27
#: Far above what four roundings of doubles can err, relative.
SLACK = 2.0 ** -48
STORED = "vec_id long, v array<int>, p array<long>"
RESULT = "vec_id long, cluster int, distance long, checked int"


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``x`` to one vector or to rows of ``c``."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def farthest_first(vectors: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` distinct vectors, each the farthest from those before it."""
    if not len(vectors):
        return vectors
    picked, least = [0], squares(vectors, vectors[0])
    while len(picked) < n and least.max() > 0:
        picked.append(int(least.argmax()))
        least = np.minimum(least, squares(vectors, vectors[picked[-1]]))
    return vectors[picked]


class Bounds:
    """Ptolemaic lower bounds between vectors and centroids over fixed pivots."""

    def __init__(self, pivots: np.ndarray, centroids: np.ndarray):
        self.pairs = [(p, q, float(np.sqrt(squares(pivots[p:p + 1], pivots[q])[0])))
                      for p, q in combinations(range(len(pivots)), 2)]
        self.near = np.sqrt(np.stack([squares(centroids, p) for p in pivots], 1).astype(float))

    def least_squares(self, cached: np.ndarray) -> np.ndarray:
        """For each vector (its squared pivot distances) and centroid, a number that
        its squared distance is not below."""
        d, c = np.sqrt(cached.astype(float)), self.near
        out = np.zeros((len(d), len(c)))
        for p, q, apart in self.pairs:
            one, two = d[:, p, None] * c[:, q], d[:, q, None] * c[:, p]
            np.maximum(out, (np.abs(one - two) - SLACK * (one + two)) / apart, out=out)
        return out * out * (1 - SLACK)


def assign(x: np.ndarray, cached: np.ndarray, centroids: np.ndarray, bounds: Bounds):
    """Nearest centroid of each row (ties: smaller number), its squared distance, and
    how many were checked exactly."""
    low = bounds.least_squares(cached)
    cluster = low.argmin(1)
    best = squares(x, centroids[cluster])
    first, checked = cluster.copy(), np.ones(len(x), np.int32)
    for c in range(len(centroids)):
        left = np.flatnonzero((low[:, c] <= best.astype(float) * (1 + SLACK)) & (first != c))
        d = squares(x[left], centroids[c])
        better = (d < best[left]) | ((d == best[left]) & (c < cluster[left]))
        best[left[better]], cluster[left[better]] = d[better], c
        checked[left] += 1
    return cluster, best, checked


def arrays(batch: pa.RecordBatch, dims: int, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    x = pc.list_flatten(batch.column("v")).to_numpy(zero_copy_only=False).astype(np.int64)
    p = pc.list_flatten(batch.column("p")).to_numpy(zero_copy_only=False)
    return x.reshape(-1, dims), p.reshape(-1, pivots)


def lists(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = a.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(a.ravel(), kind))


def with_pivots(pivots: np.ndarray):
    """Store each vector's squared distances to the pivots."""
    def fn(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = pc.list_flatten(b.column("v")).to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, -1)
            near = np.stack([squares(x, p) for p in pivots], 1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), lists(near, pa.int64())], names=["vec_id", "v", "p"])

    return fn


def partial_sums(pivots: np.ndarray, centroids: np.ndarray):
    """Per task: each cluster's number of vectors and sums of components."""
    def fn(batches):
        bounds = Bounds(pivots, centroids)
        k, dims = centroids.shape
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            if b.num_rows:
                x, p = arrays(b, dims, len(pivots))
                cluster, _, _ = assign(x, p, centroids, bounds)
                n += np.bincount(cluster, minlength=k)
                np.add.at(total, cluster, x)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), lists(total[some], pa.int64())],
                                         names=["cluster", "n", "s"])

    return fn


def final(pivots: np.ndarray, centroids: np.ndarray):
    def fn(batches):
        bounds = Bounds(pivots, centroids)
        for b in batches:
            if b.num_rows:
                x, p = arrays(b, centroids.shape[1], len(pivots))
                cluster, d, checked = assign(x, p, centroids, bounds)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(d), pa.array(checked)],
                                                 names=["vec_id", "cluster", "distance", "checked"])

    return fn


def centroid_clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE,
                      pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance, checked`` (exact checks in the last assignment) of
    every kept row of ``vec_id, embedding``, and the final centroids."""
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
            .where((F.size("embedding") == dims) & finite))
    # floor() of a double beyond a long would stop; such rows go to ``beyond``
    small = F.forall("embedding", lambda x: (x * scale >= float(-LIMIT)) & (x * scale < float(LIMIT)))
    whole = kept.where(small).select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale).cast("int")).alias("v"))
    beyond = kept.where(~small).select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in
                                                   (("cluster", "int"), ("distance", "long"), ("checked", "int"))])
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = whole.orderBy(name, "v").limit(k).collect()  # the k starting vectors
    centroids = np.array([r["v"] for r in start], np.int64).reshape(-1, dims)
    if not len(centroids):
        return beyond, centroids
    fixed = farthest_first(centroids, pivots)
    stored = stash(map_arrow(whole, with_pivots(fixed), STORED), "vectors")
    for _ in range(rounds):
        sums = map_arrow(stored, partial_sums(fixed, centroids), "cluster int, n long, s array<long>")
        parts = sums.select("cluster", "n", F.posexplode("s").alias("i", "x")).groupBy("cluster", "i").agg(
            F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        for r in parts.collect():  # k x dims rows
            centroids[r["cluster"], r["i"]] = int(r["x"]) // r["n"]
    out = stash(map_arrow(stored, final(fixed, centroids), RESULT), "assigned")
    return out.unionByName(beyond), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add ``cluster_inertia, inertia`` (sums of distances) and ``centroid_sha256``."""
    each = {r["cluster"]: int(r["d"]) for r in assigned.where("cluster IS NOT NULL").groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows

    def by_cluster(values: dict, kind: str):
        entries = [F.lit(x) for c in sorted(values) for x in (c, values[c])]
        return F.create_map(*entries)[F.col("cluster")].cast(kind) if entries else F.lit(None).cast(kind)

    def held(n: int) -> int | None:
        return n if n < 1 << 63 else None

    sha = {c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest() for c in each}
    return assigned.select(
        "vec_id", "cluster", "distance", by_cluster({c: held(d) for c, d in each.items()}, "long").alias("cluster_inertia"),
        F.when(F.col("cluster").isNotNull(), F.lit(held(sum(each.values())))).cast("long").alias("inertia"),
        by_cluster(sha, "string").alias("centroid_sha256"))
