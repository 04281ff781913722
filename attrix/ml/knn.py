"""Exact k nearest neighbours (Euclidean) as a metric join, and the vote on them.

1. Up to ``MAX_PIVOTS`` training rows are pivots; each row of both sides goes to
   the cell of its nearest pivot.  A cell is summed up in its row count, its radius
   and the ``k`` smallest distances to its pivot (a bounded table: pivots x k).
2. Triangle inequality, from above: for a test point q and any training row r of
   cell j, ``d(q, r) <= d(q, p_j) + d(p_j, r)``; the k-th smallest of these sums bounds
   q's k-th distance.  From below: no row of cell j is nearer than ``d(q, p_j) - radius_j``
   or ``(d(q, p_j)^2 - d(q, p_i)^2) / (2 d(p_i, p_j))``, with i the cell of q.
3. First q meets its own cell; the k-th distance found there sharpens its bound.
   Then q visits the other cells whose lower bound does not exceed it.
4. Both rounds shuffle by cell.  A cell of more than ``BLOCK`` training rows is cut
   into salted blocks, each visited by all of the cell's test points; the test points of
   a block beyond ``VISITS`` are dealt to copies of it.  A task holds one block and streams
   its visitors: no cell, however hot, is one task, and no pair is ever a row -- only a
   visitor's ``k`` best of each block are.

Bounds are widened by far more than their arithmetic can err, so no neighbour is lost.
Distances are sums of squared differences, coordinate by coordinate; ties at the k-th
place go to the smaller label, then are equal in every vote.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attrix.session import ship_package, spread, stash

MAX_PIVOTS, BLOCK, VISITS = 1024, 32_768, 262_144
#: Rows that meet all pivots at a time, and rows handed on or compared at a time.
ROWS, OUT = 512, 1 << 15
#: Relative widening of the bounds.
SLACK = 1e-9


def _scaled(df: DataFrame, features, stats):
    return [((F.col(c).cast("double") - F.lit(m)) / F.lit(s)).alias(f"z{i}")
            for i, (c, (m, s)) in enumerate(zip(features, stats))]


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows of ``x`` to rows of ``y`` (one matrix product)."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1), 0.0))


def _widened(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A bound for the error of ``_distances``."""
    return np.sqrt(SLACK * ((x * x).sum(1)[:, None] + (y * y).sum(1)) + 1e-300)


def _coordinates(pdf: pd.DataFrame, d: int) -> np.ndarray:
    return pdf[[f"z{i}" for i in range(d)]].to_numpy(dtype=np.float64)


def _pieces(batches, *keys: str):
    """``(key, rows)`` for the runs of equal keys in sorted batches."""
    for b in batches:
        if b.empty:
            continue
        change = np.zeros(len(b), bool)
        for c in keys:
            v = b[c].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cuts = np.r_[0, np.flatnonzero(change), len(b)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo < hi:
                part = b.iloc[lo:hi]
                yield tuple(part[c].iloc[0] for c in keys), part


def _slices(batches):
    """The batches in pieces whose table of distances to all pivots stays small."""
    for b in batches:
        for lo in range(0, len(b), ROWS):
            yield b.iloc[lo:lo + ROWS]


def _nearest(q: np.ndarray, x: np.ndarray, label: np.ndarray, k: int):
    """``(row, distance, label)`` of the k best rows of ``x`` for each row of ``q``."""
    k = min(k, len(x))
    approx = _distances(q, x) ** 2
    kth = np.partition(approx, k - 1, axis=1)[:, k - 1]
    room = SLACK * ((q * q).sum(1) + (x * x).sum(1).max()) + 1e-300
    close = approx <= (kth + 2 * room)[:, None]
    if len(q) > 1 and np.count_nonzero(close) > OUT:  # many ties
        del approx, close
        half = len(q) // 2
        low, high = _nearest(q[:half], x, label, k), _nearest(q[half:], x, label, k)
        return np.r_[low[0], high[0] + half], np.r_[low[1], high[1]], np.r_[low[2], high[2]]
    row, col = np.nonzero(close)
    exact = ((q[row] - x[col]) ** 2).sum(1)
    order = np.lexsort((label[col], exact, row))
    row, col, exact = row[order], col[order], exact[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    best = place < k
    return row[best], np.sqrt(exact[best]), label[col[best]]


class _Cells:
    """Pivots with what is known of their cells."""

    def __init__(self, pivots: np.ndarray):
        self.pivots, self.d = pivots, pivots.shape[1]
        self.apart = _distances(pivots, pivots)
        n = len(pivots)
        self.count, self.radius = np.zeros(n, np.int64), np.zeros(n)
        self.smallest = [np.empty(0)] * n

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = _distances(x, self.pivots)
        return d.argmin(1).astype(np.int32), d

    def above(self, x: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
        """A bound for each point's k-th distance."""
        sums = np.concatenate([d[:, j:j + 1] + s for j, s in enumerate(self.smallest) if len(s)], axis=1)
        if sums.shape[1] < k:
            return np.full(len(x), np.inf)
        return np.partition(sums, k - 1, axis=1)[:, k - 1] + 3 * _widened(x, self.pivots).max(1)

    def below(self, x: np.ndarray, d: np.ndarray, home: np.ndarray) -> np.ndarray:
        """A bound for each point's distance to any row of each cell."""
        own = d[np.arange(len(x)), home][:, None]
        wide = _widened(x, self.pivots)
        apart = self.apart[home]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > 4 * wide, ((d - wide) ** 2 * (d > wide) - (own + wide) ** 2) / (2 * apart), 0.0)
        return np.maximum(np.maximum(d - self.radius - 2 * wide, plane * (1 - SLACK) - wide), 0.0)


def _meet(train: DataFrame, visits: DataFrame, cells: _Cells, k: int) -> DataFrame:
    """``tid, dist, nlabel``: each visitor's k best rows in each block it visits."""
    d = cells.d
    zc = [f"z{i}" for i in range(d)]
    calls = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # <= pivots
    blocks = {j: -(-int(n) // BLOCK) for j, n in enumerate(cells.count) if n}
    copies = {j: -(-n // VISITS) for j, n in calls.items()}

    def number(of: dict) -> F.Column:
        pairs = [F.lit(int(x)) for kv in of.items() for x in kv]
        return F.coalesce(F.create_map(*pairs)[F.col("cell")], F.lit(1)) if pairs else F.lit(1)

    def all_of(n: F.Column) -> F.Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    deal = F.xxhash64("id")
    held = (train.where(F.col("cell").isin(list(calls)) if len(calls) < len(cells.count) else F.lit(True))
            .withColumn("block", F.pmod(deal, number(blocks)).cast("int")).withColumn("copy", all_of(number(copies)))
            .select("cell", "block", "copy", F.lit(0).alias("side"), F.lit(None).cast("long").alias("tid"), "label", *zc))
    asked = (visits.withColumn("copy", F.pmod(deal, number(copies)).cast("int")).withColumn("block", all_of(number(blocks)))
             .select("cell", "block", "copy", F.lit(1).alias("side"), F.col("id").alias("tid"), F.lit(None).cast("string").alias("label"), *zc))
    keys = ["cell", "block", "copy"]
    groups = sum(blocks.get(j, 0) * n for j, n in copies.items())

    def fn(batches):
        now, held_x, held_label = None, [], []
        for (cell, block, copy, side), part in _pieces(batches, *keys, "side"):
            if (cell, block, copy) != now:
                now, held_x, held_label = (cell, block, copy), [], []
            if side == 0:
                held_x.append(_coordinates(part, d))
                held_label.append(part["label"].to_numpy(dtype=object))
                continue
            if len(held_x) > 1:
                held_x, held_label = [np.concatenate(held_x)], [np.concatenate(held_label)]
            if not held_x:
                continue
            names, code = np.unique(held_label[0].astype(str), return_inverse=True)
            step = max(1, (1 << 21) // len(held_x[0]))
            for lo in range(0, len(part), step):
                piece = part.iloc[lo:lo + step]
                row, dist, label = _nearest(_coordinates(piece, d), held_x[0], code, k)
                yield pd.DataFrame({"tid": piece["tid"].to_numpy(dtype=np.int64)[row], "dist": dist, "nlabel": names[label]})

    both = held.unionByName(asked).repartition(max(1, min(groups, 4096)), *keys).sortWithinPartitions(*keys, "side")
    return both.mapInPandas(fn, "tid long, dist double, nlabel string")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("tid").orderBy("dist", "nlabel")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)


def knn_join(train: DataFrame, test: DataFrame, d: int, k: int, pivots: int | None = None) -> DataFrame:
    """``tid, dist, nlabel, r``: the k nearest rows of ``train`` (``label, z0..``) for
    every row of ``test`` (``id, z0..``), ``r`` from 1."""
    spark = train.sparkSession
    ship_package(spark)
    zc = [f"z{i}" for i in range(d)]
    train = stash(spread(train.select("label", *zc)).withColumn("id", F.monotonically_increasing_id()), "knn-train")
    n = train.count()
    want = pivots or min(MAX_PIVOTS, max(1, int(n ** 0.5 / 2)))
    seeds = [tuple(r) for r in train.select(*zc).distinct().orderBy(F.xxhash64(*zc), *zc).limit(want).collect()]
    if not seeds:
        return spark.createDataFrame([], "tid long, dist double, nlabel string, r int")
    cells = _Cells(np.array(seeds, np.float64).reshape(-1, d))

    def to_cell(batches):
        for b in _slices(batches):
            cell, far = cells.home(_coordinates(b, d))
            yield b.assign(cell=cell, far=far[np.arange(len(b)), cell])

    shape = ", ".join(f"{z} double" for z in zc)
    train = stash(train.select("id", "label", *zc).mapInPandas(to_cell, f"id long, label string, {shape}, cell int, far double"), "knn-cells")
    first = Window.partitionBy("cell").orderBy("far", "id")
    nearest = train.select("cell", "far", "id").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
    small = {r["cell"]: r["s"] for r in nearest.groupBy("cell").agg(F.collect_list("far").alias("s")).collect()}  # pivots x k
    for r in train.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect():
        cells.count[r["cell"]], cells.radius[r["cell"]] = r["n"], r["radius"]
        cells.smallest[r["cell"]] = np.array(small[r["cell"]])

    def go_home(batches):
        for b in _slices(batches):
            x = _coordinates(b, d)
            cell, far = cells.home(x)
            yield b.assign(cell=cell, most=cells.above(x, far, k))

    asked = stash(test.select("id", *zc).mapInPandas(go_home, f"id long, {shape}, cell int, most double"), "knn-test")
    near = stash(_meet(train, asked, cells, k), "knn-home")
    kth = _best(near, k).where(F.col("r") == k).select(F.col("tid").alias("id"), F.col("dist").alias("kth"))
    sharper = asked.join(kth, "id", "left").withColumn("most", F.least("most", F.col("kth") * (1 + SLACK))).drop("kth")

    def go_out(batches):
        for b in _slices(batches):
            x = _coordinates(b, d)
            home = b["cell"].to_numpy()
            low = cells.below(x, _distances(x, cells.pivots), home)
            go = (low <= b["most"].to_numpy()[:, None]) & (cells.count > 0)
            go[np.arange(len(b)), home] = False
            row, cell = np.nonzero(go)
            point = b[["id", *zc]]
            for lo in range(0, len(row), OUT):  # a row may go to every cell
                yield point.iloc[row[lo:lo + OUT]].assign(cell=cell[lo:lo + OUT].astype(np.int32))

    away = stash(sharper.select("id", *zc, "cell", "most").mapInPandas(go_out, f"id long, {shape}, cell int"), "knn-away")
    return _best(near.unionByName(_meet(train, away, cells, k)), k)


def knn_classify(train: DataFrame, test: DataFrame, features: list[str], label: str, k: int,
                 key: str | None, stats, pivots: int | None = None) -> DataFrame:
    """(key,) label and prediction of every test row; ties in the vote go to the
    smallest label."""
    keep = [F.col(key).alias(key)] if key else []
    asked = stash(spread(test.select(F.col(label).cast("string").alias("label"), *[c.alias("_key") for c in keep],
                              *_scaled(test, features, stats))).withColumn("id", F.monotonically_increasing_id()), "knn-asked")
    known = train.select(F.col(label).cast("string").alias("label"), *_scaled(train, features, stats))
    nearest = knn_join(known, asked, len(features), k, pivots)
    votes = nearest.groupBy("tid", "nlabel").agg(F.count("*").alias("v"))
    winner = votes.groupBy("tid").agg(F.min_by("nlabel", F.struct((-F.col("v")).alias("nv"), F.col("nlabel"))).alias("prediction"))
    out = asked.join(winner, asked["id"] == winner["tid"], "left")
    return out.select(*([F.col("_key").alias(key)] if key else []), "label", "prediction")

