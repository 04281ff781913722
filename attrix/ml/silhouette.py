"""Euclidean silhouette by all pairs of rows.

Equal rows of one cluster are one weighted point.  Points are dealt by hash into groups
of bounded size; each pair of groups is one piece of work, which holds the two groups and
a tile of distances, and adds up each point's distances by cluster in both directions, so
a pair of points is measured once.  What a point is told by all groups is added up piece
by piece.  Nothing but the cluster sizes and the final sums reaches the driver.  The time
grows with the square of the distinct points, memory does not grow.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.session import ship_package, stash

#: What the points of a group, or their sums, may take; and the sums that are added up at once.
GROUP_BYTES, PIECE_BYTES = 16 << 20, 1 << 20
MOST, LEAST = 50_000, 512
#: Distances that are measured at a time, each way; below which share of its rows' squares a
#: squared distance is taken from the differences, as its digits would cancel.
TILE, CLOSE = 256, 1e-9


def _groups(points: int, width: int, cores: int) -> int:
    """Into how many groups the points go: few enough that they seldom travel, small
    enough for a task, enough pairs for the cores."""
    size = max(1, min(MOST, GROUP_BYTES // (8 * width)))
    for_cores = min(math.ceil(math.sqrt(6 * cores)), -(-points // LEAST))
    return max(1, -(-points // size), for_cores)


class Rows:
    """Rows whose products are squared distances: ``[-2x, |x|^2, 1] . [y, 1, |y|^2]``."""

    def __init__(self, x: np.ndarray):
        self.x, sq, one = x, (x * x).sum(1)[:, None], np.ones((len(x), 1))
        self.sq, self.left, self.right = sq[:, 0], np.hstack([-2 * x, sq, one]), np.hstack([x, one, sq])


def distances(a: Rows, r: slice, b: Rows, s: slice, out: np.ndarray | None = None) -> np.ndarray:
    """All distances between rows ``r`` of ``a`` and ``s`` of ``b``; close ones without cancellation."""
    d = np.matmul(a.left[r], b.right[s].T, out=out)
    if d.min() <= CLOSE * (a.sq[r].max() + b.sq[s].max()):
        i, j = np.nonzero(d <= CLOSE * (a.sq[r, None] + b.sq[s]))
        for at in range(0, len(i), 8192):
            k, m = i[at:at + 8192], j[at:at + 8192]
            t = a.x[r][k] - b.x[s][m]
            d[k, m] = (t * t).sum(1)
    return np.sqrt(d, out=d)


def _add(out: np.ndarray, d: np.ndarray, c: np.ndarray, w: np.ndarray) -> None:
    """Adds the distances ``d`` to points of clusters ``c`` (sorted) and weights ``w``, by cluster."""
    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    if len(first) > 16:
        out[:, c[first]] += np.add.reduceat(d * w, first, axis=1)
        return
    for lo, hi in zip(first, np.r_[first[1:], len(c)]):
        out[:, c[lo]] += d[:, lo:hi] @ w[lo:hi]


def pair_sums(a: tuple, b: tuple | None, k: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Sums of distances by cluster from each point of ``a`` to ``b`` and back
    (``b`` None: within ``a``).  A group is (clusters, weights, rows), sorted by cluster."""
    c, w, z = a
    oc, ow, oz = a if b is None else b
    z, oz = Rows(z), Rows(oz)
    there, back = np.zeros((len(c), k)), None if b is None else np.zeros((len(oc), k))
    held = np.empty(TILE * TILE)
    for i in range(0, len(c), TILE):
        r = slice(i, min(i + TILE, len(c)))
        for j in range(0, len(oc), TILE):
            s = slice(j, min(j + TILE, len(oc)))
            shape = r.stop - r.start, s.stop - s.start
            d = distances(z, r, oz, s, held[:shape[0] * shape[1]].reshape(shape))
            _add(there[r], d, oc[s], ow[s])
            if back is not None:
                _add(back[s], d.T, c[r], w[r])
    return there, back


def silhouette_sums(points: DataFrame, cols: list[str], sizes: dict) -> DataFrame:
    """One row ``total, rows``: the sum of all rows' silhouettes and their number.
    ``points``: ``c`` (a key of ``sizes``), ``cols`` (doubles)."""
    spark, names, d = points.sparkSession, sorted(sizes), len(cols)
    ship_package(spark)
    k, place, n_of = len(names), {c: j for j, c in enumerate(names)}, np.array([sizes[c] for c in names], float)
    pts = stash(points.groupBy("c", *cols).agg(F.count(F.lit(1)).cast("double").alias("w"))
                .withColumn("id", F.monotonically_increasing_id()), "silhouette-points")
    sc = spark.sparkContext
    groups = _groups(pts.count(), max(d + 3, k), sc.defaultParallelism)
    pairs = groups * (groups + 1) // 2
    per_piece = max(1, PIECE_BYTES // (8 * k))

    def pack(batches):
        """The points of a group that lie in one batch, as bytes."""
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(0).to_numpy()
            c = np.array([place[v] for v in b.column(1).to_pylist()], np.int64)
            num = [b.column(i).to_numpy(zero_copy_only=False) for i in range(2, b.num_columns)]
            z = np.column_stack(num[2:]).astype(float)
            for v in np.unique(g):
                m = g == v
                yield pa.RecordBatch.from_pydict({"g": pa.array([v], pa.int32()), **{
                    x: pa.array([a[m].tobytes()], pa.binary()) for x, a in (("c", c), ("id", num[0].astype(np.int64)), ("w", num[1]), ("z", z))}})

    packed = stash(pts.select(F.pmod(F.xxhash64("c", *cols), F.lit(groups)).cast("int").alias("g"), "c", "id", "w", *cols)
                   .mapInArrow(pack, "g int, c binary, id binary, w binary, z binary"), "silhouette-groups")

    def load(pdf):
        if pdf.empty:
            return None
        c, ids = (np.frombuffer(b"".join(pdf[x]), np.int64) for x in ("c", "id"))
        order = np.lexsort((ids, c))
        w = np.frombuffer(b"".join(pdf["w"]))[order]
        return c[order], w, np.frombuffer(b"".join(pdf["z"])).reshape(-1, d)[order]

    def meet(key, pdf):
        a, b = int(key[0]), int(key[1])
        mine = load(pdf[pdf["g"] == a])
        if a == b:
            told = [(a, mine, pair_sums(mine, None, k)[0])]
        else:
            other = load(pdf[pdf["g"] == b])
            there, back = (None, None) if mine is None or other is None else pair_sums(mine, other, k)
            told = [] if there is None else [(a, mine, there), (b, other, back)]
        out = []
        for g, (c, w, _), sums in told:
            for p, at in enumerate(range(0, len(c), per_piece)):
                r = slice(at, at + per_piece)
                out.append((g, p, c[r].tobytes(), w[r].tobytes(), sums[r].tobytes()))
        return pd.DataFrame(out, columns=["g", "p", "c", "w", "sums"])

    def score(key, pdf):
        c, w = np.frombuffer(pdf["c"].iloc[0], np.int64), np.frombuffer(pdf["w"].iloc[0])
        total = np.zeros((len(c), k))
        for s in pdf["sums"]:
            total += np.frombuffer(s).reshape(-1, k)
        rows = np.arange(len(c))
        own = total[rows, c] / np.maximum(n_of[c] - 1, 1)  # without the row itself
        total /= n_of
        total[rows, c] = np.inf
        near = total.min(1)
        s = np.where(n_of[c] < 2, 0.0, (near - own) / np.maximum(np.maximum(own, near), 1e-300))
        return pd.DataFrame([((w * s).sum(), w.sum())], columns=["total", "rows"])

    each = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    dealt = (packed.withColumn("h", each).select(F.least("g", "h").alias("a"), F.greatest("g", "h").alias("b"), "g", "c", "id", "w", "z")
             .repartition(max(1, min(pairs, 64 * sc.defaultParallelism)), "a", "b"))
    told = stash(dealt.groupBy("a", "b").applyInPandas(meet, "g int, p int, c binary, w binary, sums binary"), "silhouette-sums")
    return told.groupBy("g", "p").applyInPandas(score, "total double, rows double").agg(
        F.sum("total").alias("total"), F.sum("rows").alias("rows"))
