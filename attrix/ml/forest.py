"""Random forests whose cost grows with the rows.

MLlib grows a forest by passes over all rows, as many nodes a pass as fit into its
memory for node sums; full-depth trees have as many nodes as rows, so its time grows
with their square.  Here every tree still takes its own bootstrap sample (Poisson
weights), at most 32 bins a feature, Gini or variance gains and a random subset of the
features a node, but rows move instead of sums: large nodes are split by distributed
histograms (one aggregation a round, for all trees) until what a node holds is small,
then each small node's rows are shuffled to one task, which grows the rest below it.
Rows of equal bins (and class) are one weighted entry.

Unlike MLlib, sibling leaves of one class are not merged afterwards (nor are they in
the reference).  Trees stay a Spark table; the driver sees the splits of large nodes
and one row of gains a subtree.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.session import ship_package, stash

BINS = 32
#: What the entries of a node may take before one task grows all below it.
GROUP_BYTES = 32 << 20
CHUNK_BYTES = 4 << 20
#: Poisson(1): P(weight <= i).
POISSON = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 19)]))
TREE = "tree int, node int, feat binary, bin binary, left binary, leaf binary, cls binary, p binary, gain binary"


# ---------------------------------------------------------------------------
# bins and weights
# ---------------------------------------------------------------------------

def thresholds(values: np.ndarray, bins: int) -> np.ndarray:
    """Borders of one feature from a sample, as MLlib sets them: between all distinct
    values if they are few, else where the counts come nearest to equal shares."""
    return counted_thresholds(*np.unique(values, return_counts=True), bins)


def counted_thresholds(v: np.ndarray, n: np.ndarray, bins: int) -> np.ndarray:
    """The same from distinct values, sorted, and their counts."""
    if len(v) <= bins:
        return (v[:-1] + v[1:]) / 2
    stride, out, count = n.sum() / bins, [], n[0]
    target = stride
    for i in range(1, len(v)):
        before, count = count, count + n[i]
        if abs(before - target) < abs(count - target):
            out.append((v[i - 1] + v[i]) / 2)
            target += stride
    return np.array(out)


def bootstrap(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Poisson(1) weights that depend on row, tree and seed alone."""
    with np.errstate(over="ignore"):
        z = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.uint64((seed << 20) + tree + 1) * np.uint64(0xD1B54A32D192ED03))
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
        z ^= z >> np.uint64(31)
    return np.searchsorted(POISSON, (z >> np.uint64(11)) * 2.0 ** -53, side="right")


def _codes(X: np.ndarray) -> pa.Array:
    n, d = X.shape
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(d), n, [None, pa.py_buffer(np.ascontiguousarray(X))]).cast(pa.binary())


def _decode(col: pa.Array, d: int) -> np.ndarray:
    at = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[at[0]:at[-1]].reshape(len(col), d)


def _collapse(X: np.ndarray, cls: np.ndarray | None):
    """Rows of distinct bins (and class), and which of them each row is."""
    key = X if cls is None else np.hstack([X, np.ascontiguousarray(cls, dtype=np.int32).view(np.uint8).reshape(len(X), 4)])
    wide = 8 if key.shape[1] <= 8 else key.shape[1]
    key = np.ascontiguousarray(np.pad(key, ((0, 0), (0, wide - key.shape[1]))))
    key = key.view(np.uint64 if wide == 8 else f"V{wide}").ravel()
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    return first, inverse.ravel()


# ---------------------------------------------------------------------------
# splits
# ---------------------------------------------------------------------------

def _order(bins, key):
    """Rows by ``key`` and, within it, as ``bins`` orders them."""
    k = key[bins]
    return bins[np.argsort(k.astype(np.uint16) if len(k) and k.max() < 65536 else k, kind="stable")]


def _before(sums):
    return np.cumsum(sums) - sums


def best_splits(bins_of, k, node, w, s, W, group=None, T=None, A=None):
    """For each node the largest gain among ``k`` features: (gain, slot, bin), gain 0
    where none splits.  Rows are sorted by node; ``bins_of(j)`` gives their bins in slot j.
    Regression: sums ``s``.  Classification: ``group`` numbers (node, class), with weights
    ``T``, and ``A`` sums their squares by node."""
    m = len(W)
    S = None if group is not None else np.bincount(node, s, m)
    A = S * S if A is None else A
    gain, slot, at = np.zeros(m), np.zeros(m, np.int64), np.zeros(m, np.int64)
    for j in range(k):
        b = bins_of(j)
        by_bin = np.argsort(b, kind="stable")
        o = _order(by_bin, node)
        no, bo = node[o], b[o]
        e = np.flatnonzero((no[1:] == no[:-1]) & (bo[1:] != bo[:-1]))
        if not len(e):
            continue
        ne = no[e]
        left = np.cumsum(w[o])[e] - _before(W)[ne]
        right = W[ne] - left
        if group is None:
            sl = np.cumsum(s[o])[e] - _before(S)[ne]
            al, ar = sl * sl, (S[ne] - sl) ** 2
        else:  # sums of squares grow by 2 x what a class has before + the weight
            oc = _order(by_bin, group)
            wc, gc = w[oc], group[oc]
            grown = np.empty(len(w))
            grown[oc] = wc * (2 * (np.cumsum(wc) - wc - _before(T)[gc]) + wc)
            base = _before(A)[ne]
            al = np.cumsum(grown[o])[e] - base
            ar = A[ne] - 2 * (np.cumsum((w * T[group])[o])[e] - base) + al
        g = al / left + ar / right - A[ne] / W[ne]
        first = np.flatnonzero(np.r_[True, ne[1:] != ne[:-1]])
        top = np.maximum.reduceat(g, first)
        hit = np.flatnonzero(g == np.repeat(top, np.diff(np.r_[first, len(g)])))
        nodes, i = np.unique(ne[hit], return_index=True)
        better = top > gain[nodes]
        nodes, i = nodes[better], hit[i[better]]
        gain[nodes], slot[nodes], at[nodes] = g[i], j, bo[e[i]]
    return gain, slot, at


def subsets(rng, m: int, d: int, k: int) -> np.ndarray:
    """``k`` of ``d`` features for each of ``m`` nodes."""
    if k == d:
        return np.broadcast_to(np.arange(d), (m, d))
    return np.argpartition(rng.random((m, d), dtype=np.float32), k, axis=1)[:, :k]


def grow(X, w, s, classes: bool, depth: int, k: int, rng) -> dict:
    """All levels below one node, whole levels at a time.  ``s``: class numbers or sums of the
    label.  A node is a place in ``feat`` (-1: leaf), ``bin`` and ``left``; a leaf's shares of classes
    (or its mean, as class 0) are rows of ``leaf``, ``cls``, ``p``."""
    n, d = X.shape
    row, node = np.argsort(s, kind="stable") if classes else np.arange(n), np.zeros(n, np.int64)
    gain = np.zeros(d)
    least = 1e-12 * (1.0 if classes else float((s * s / w).sum()))
    parts, leaves, total = [], [], 1
    first, m = 0, 1
    while m:
        feat, cut, left = np.full(m, -1, np.int32), np.zeros(m, np.uint8), np.zeros(m, np.int32)
        if classes:
            c = s[row]
            new = np.r_[True, (node[1:] != node[:-1]) | (c[1:] != c[:-1])]
            at = np.flatnonzero(new)
            group, T = np.cumsum(new) - 1, np.add.reduceat(w[row], at)
            gnode, W = node[at], np.bincount(node, w[row], m)
            open_ = (np.bincount(gnode, minlength=m) > 1) & (depth > 0)
        else:
            W, S = np.bincount(node, w[row], m), np.bincount(node, s[row], m)
            open_ = (np.bincount(node, minlength=m) > 1) & (depth > 0)
        if open_.any():
            in_ = open_[node]
            r, v = row[in_], (np.cumsum(open_) - 1)[node[in_]]
            of = subsets(rng, int(open_.sum()), d, k)
            kw = {}
            if classes:
                gi = open_[gnode]
                kw = dict(group=(np.cumsum(gi) - 1)[group[in_]], T=T[gi], A=np.bincount(gnode, T * T, m)[open_])
            g, j, b = best_splits(lambda i: X[r, i] if k == d else X[r, of[v, i]], k, v, w[r], s[r], W[open_], **kw)
            ok = g > least * (W[open_] if classes else 1.0)
            split = np.flatnonzero(open_)[ok]
            feat[split], cut[split] = of[np.flatnonzero(ok), j[ok]], b[ok]
            left[split] = total + 2 * np.arange(len(split))
            gain += np.bincount(feat[split], g[ok], d)
        end = feat < 0
        if classes:
            x = end[gnode]
            leaves.append((first + gnode[x], s[row][at][x], T[x] / W[gnode[x]]))
        else:
            x = np.flatnonzero(end)
            leaves.append((first + x, np.zeros(len(x)), S[x] / W[x]))
        parts.append((feat, cut, left))
        go = ~end[node]
        row, node = row[go], node[go]
        node = left[node] - total + (X[row, feat[node]] > cut[node])
        o = _order(np.arange(len(node)), node)
        row, node = row[o], node[o]
        first, m, depth = total, int(2 * (~end).sum()), depth - 1
        total += m
    feat, cut, left = (np.concatenate(a) for a in zip(*parts))
    leaf, cls, p = (np.concatenate(a) for a in zip(*leaves))
    o = np.argsort(leaf, kind="stable")
    return {"feat": feat, "bin": cut, "left": left, "leaf": leaf[o].astype(np.int32), "cls": cls[o].astype(np.int32),
            "p": p[o].astype(float), "gain": gain}


def route(t: dict, X: np.ndarray) -> np.ndarray:
    """The leaf of each row of bins."""
    at = np.zeros(len(X), np.int64)
    live = np.arange(len(X))
    while len(live := live[t["feat"][at[live]] >= 0]):
        a = at[live]
        at[live] = t["left"][a] + (X[live, t["feat"][a]] > t["bin"][a])
    return at


# ---------------------------------------------------------------------------
# Spark jobs
# ---------------------------------------------------------------------------

@dataclass
class Forest:
    """A fitted forest: ``trees`` is a Spark table of subtrees (``TREE``), ``tops`` the splits
    of large nodes above them."""

    trees: DataFrame
    tops: list
    borders: list
    features: list
    classes: bool
    top_gain: dict = field(default_factory=dict)

    def importances(self) -> np.ndarray:
        """Gains by feature, each tree's scaled to 1."""
        sums = {t: g.copy() for t, g in self.top_gain.items()}
        for r in self.trees.select("tree", "gain").toLocalIterator():  # one row a subtree
            sums[r["tree"]] = sums.get(r["tree"], 0.0) + np.frombuffer(r["gain"])
        out = sum((g / g.sum() if g.sum() > 0 else g for g in sums.values()), np.zeros(len(self.features)))
        return out / out.sum() if out.sum() > 0 else out

    def predict(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` and ``prediction``: the class of the largest share over all trees, or the mean
        of their values.  Rows of equal bins are looked up once."""
        spark, d, tops = df.sparkSession, len(self.features), self.tops
        rows = stash(encode(df, self.features, self.borders, keep), "forest-ask")
        cells = stash(rows.select("code").distinct().withColumn("id", F.monotonically_increasing_id()), "forest-cells")

        def ask(batches):
            for ids, X, _ in _chunks(batches, d):
                for t, top in enumerate(tops):
                    at = route(top, X)
                    for v in np.unique(at):
                        m = at == v
                        yield _record(tree=t, node=int(v), X=X[m], id=ids[m])

        def vote(batches):
            for batch in batches:
                for r in (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                    t = {c: np.frombuffer(r[c], ty) for c, ty in (("feat", np.int32), ("bin", np.uint8), ("left", np.int32),
                                                                  ("leaf", np.int32), ("cls", np.int32), ("p", float))}
                    at, ids = route(t, np.frombuffer(r["X"], np.uint8).reshape(-1, d)), np.frombuffer(r["id"], np.int64)
                    lo, hi = np.searchsorted(t["leaf"], at, "left"), np.searchsorted(t["leaf"], at, "right")
                    n = hi - lo
                    i = np.repeat(lo - _before(n), n) + np.arange(n.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(t["cls"][i]), pa.array(t["p"][i])],
                                                     names=["id", "cls", "p"])

        asked = cells.select("id", "code", F.lit(0.0).alias("y")).mapInArrow(ask, "tree int, node int, X binary, id binary")
        parts = _parts(spark, len(tops))
        votes = (asked.repartition(parts, "tree", "node").join(self.trees.repartition(parts, "tree", "node"), ["tree", "node"])
                 .select("X", "id", "feat", "bin", "left", "leaf", "cls", "p").mapInArrow(vote, "id long, cls int, p double"))
        if self.classes:
            best = votes.groupBy("id", "cls").agg(F.sum("p").alias("p")).groupBy("id").agg(
                F.max(F.struct(F.round("p", 9).alias("p"), (-F.col("cls")).alias("c"))).alias("b")).select(
                "id", (-F.col("b.c")).cast("double").alias("prediction"))
        else:
            best = votes.groupBy("id").agg((F.sum("p") / len(tops)).alias("prediction"))
        return rows.join(cells.join(best, "id").select("code", "prediction"), "code").select(*keep, "prediction")


def _parts(spark, trees: int) -> int:
    return max(1, min(trees, 16 * spark.sparkContext.defaultParallelism))


def _record(**cols):
    """One row of numbers and of arrays as bytes."""
    arrays = {c: pa.array([v], pa.int32()) if isinstance(v, int) else pa.array([v.tobytes()], pa.binary()) for c, v in cols.items()}
    return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))


def _chunk_rows(d: int) -> int:
    return max(1, min(500_000, CHUNK_BYTES // d))


def _chunks(batches, d: int):
    """(id, bins, label) of a few MB of rows at a time."""
    most, held, n = _chunk_rows(d), [], 0

    def out():
        return (np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))

    for b in batches:
        if not b.num_rows:
            continue
        held.append((b.column(0).to_numpy(), _decode(b.column(1), d), b.column(2).to_numpy()))
        n += b.num_rows
        if n >= most:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def encode(df: DataFrame, features: list[str], borders: list, keep: list[str]) -> DataFrame:
    """``code``: one byte a feature, how many borders lie below its value; ``keep`` beside it."""
    ship_package(df.sparkSession)
    kept = df.select(*keep).schema

    def fn(batches):
        for b in batches:
            X = np.empty((b.num_rows, len(borders)), np.uint8)
            for j, t in enumerate(borders):
                X[:, j] = np.searchsorted(t, b.column(len(kept) + j).to_numpy(zero_copy_only=False), side="left")
            yield pa.RecordBatch.from_arrays([_codes(X), *b.columns[:len(kept)]], names=["code", *kept.names])

    cols = [F.col(c).cast("double").alias(f"_{j}") for j, c in enumerate(features)]
    schema = ", ".join(["code binary", *[f"`{f.name}` {f.dataType.simpleString()}" for f in kept]])
    return df.select(*keep, *cols).mapInArrow(fn, schema)


def fit(df: DataFrame, features: list[str], label: str, classes: bool, n_estimators: int, max_depth: int,
        per_node: int, seed: int) -> Forest:
    """A forest on ``df`` (no nulls); ``label`` is a class number (``classes``) or a value.  ``per_node``
    features are tried a node."""
    spark, d, k = df.sparkSession, len(features), per_node
    n, mean = df.agg(F.count(F.lit(1)), F.avg(F.col(label).cast("double"))).first()
    need = max(BINS * BINS, 10_000)  # as MLlib: borders need no more rows
    sample = (df if n <= need else df.sample(need / n, seed)).select(*[F.col(c).cast("double") for c in features]).toPandas()
    borders = [thresholds(sample.iloc[:, j].to_numpy(), min(BINS, n)) for j in range(d)]
    shift = 0.0 if classes else mean
    y = df.withColumn("_y", F.col(label).cast("double") - F.lit(shift))
    rows = stash(encode(y, features, borders, ["_y"]).select(F.monotonically_increasing_id().alias("id"), "code", F.col("_y").alias("y")), "forest")

    tops = [{"feat": np.array([-1], np.int32), "bin": np.zeros(1, np.uint8), "left": np.zeros(1, np.int32), "depth": [0]}
            for _ in range(n_estimators)]

    def entries(batches, which):
        """(tree, top node, bins, weight, class or sum) of the nodes in ``which``."""
        for ids, X, y in _chunks(batches, d):
            first, inverse = _collapse(X, y if classes else None)
            cell = X[first]
            for t in sorted(which):
                wt = bootstrap(ids, t, seed)
                w = np.bincount(inverse, wt, len(first))
                s = y[first] if classes else np.bincount(inverse, wt * y, len(first))
                at = np.where(w > 0, route(tops[t], cell), -1)
                for v in which[t]:
                    m = at == v
                    if m.any():
                        yield t, v, cell[m], w[m], s[m]

    done, top_gain = _split_large(rows, tops, entries, n, classes, n_estimators, max_depth, k, d, seed)
    which = {t: [v for v in np.flatnonzero(top["feat"] < 0).tolist() if (t, v) not in done] for t, top in enumerate(tops)}
    depths = [top["depth"] for top in tops]

    def deal(batches):
        for t, v, X, w, s in entries(batches, which):
            yield _record(tree=t, node=v, X=X, w=w, s=s)

    def below(key, pdf):
        t, v = int(key[0]), int(key[1])
        X = np.frombuffer(b"".join(pdf["X"]), np.uint8).reshape(-1, d)
        w, s = (np.frombuffer(b"".join(pdf[c]), float) for c in ("w", "s"))
        first, inverse = _collapse(X, s if classes else None)
        w, s = np.bincount(inverse, w), s[first] if classes else np.bincount(inverse, s)
        out = grow(X[first], w, s, classes, max_depth - depths[t][v], k, np.random.default_rng([seed, t, v]))
        out["p"] = out["p"] + shift
        return pd.DataFrame([{"tree": t, "node": v, **{c: a.tobytes() for c, a in out.items()}}])

    parts = _parts(spark, sum(len(v) for v in which.values()))
    trees = (rows.mapInArrow(deal, "tree int, node int, X binary, w binary, s binary").repartition(parts, "tree", "node")
             .groupBy("tree", "node").applyInPandas(below, TREE))
    if done:  # large nodes that nothing splits
        trees = trees.unionByName(spark.createDataFrame([_leaf(t, v, cls, p + shift, d) for (t, v), (cls, p) in done.items()], TREE))
    return Forest(stash(trees, "forest-trees"), tops, borders, list(features), classes, top_gain)


def _leaf(t, v, cls, p, d):
    a = {"feat": np.array([-1], np.int32), "bin": np.zeros(1, np.uint8), "left": np.zeros(1, np.int32),
         "leaf": np.zeros(len(cls), np.int32), "cls": cls.astype(np.int32), "p": p.astype(float), "gain": np.zeros(d)}
    return (t, v, *[bytearray(x.tobytes()) for x in a.values()])


def _split_large(rows, tops, entries, n, classes, n_estimators, max_depth, k, d, seed):
    """Splits nodes of more than ``GROUP_BYTES`` of entries, one aggregation a round for all
    trees, and adds them to ``tops``.  Returns the large leaves and the gains by tree."""
    most = GROUP_BYTES // (d + 16)
    done, gains = {}, {t: np.zeros(d) for t in range(n_estimators)}
    if n <= most:
        return done, gains
    cell = ["code", "y"] if classes else ["code"]
    # as many entries as the chunks of rows have between them (ids of a written partition follow each other)
    sized = rows.groupBy(F.expr(f"id div {_chunk_rows(d)}")).agg(
        F.approx_count_distinct(F.xxhash64(*cell)).alias("n")).agg(F.sum("n")).first()[0]
    large = {t: [0] for t in range(n_estimators)} if sized > most and max_depth > 0 else {}

    def chosen(t, v):
        return subsets(np.random.default_rng([seed, t, v, 1]), 1, d, k)[0]

    while large:
        now = large

        def histogram(batches):
            for t, v, X, w, s in entries(batches, now):
                for f in chosen(t, v):
                    key = X[:, f].astype(np.int64) + (s.astype(np.int64) * 256 if classes else 0)
                    u, i = np.unique(key, return_inverse=True)
                    c = len(u)
                    yield pa.RecordBatch.from_pydict({
                        "tree": np.full(c, t, np.int32), "node": np.full(c, v, np.int32), "f": np.full(c, f, np.int32), "key": u,
                        "w": np.bincount(i, w), "s": np.bincount(i, s), "n": np.bincount(i)})

        def best(key, pdf):
            t, v = int(key[0]), int(key[1])
            gain, cut = 0.0, (-1, -1)
            for f in chosen(t, v):
                h = pdf[pdf["f"] == f].sort_values("key")
                b, w, s = (h["key"] % 256).to_numpy(np.uint8), h["w"].to_numpy(), h["s"].to_numpy()
                W, kw = np.array([w.sum()]), {}
                if classes:
                    _, group = np.unique(h["key"] // 256, return_inverse=True)
                    T = np.bincount(group, w)
                    kw = dict(group=group, T=T, A=np.array([(T * T).sum()]))
                g, _, at = best_splits(lambda _: b, 1, np.zeros(len(b), np.int64), w, s, W, **kw)  # noqa: B023
                if g[0] > max(gain, 1e-12 * (W[0] if classes else (s * s / w).sum())):
                    gain, cut = g[0], (int(f), int(at[0]))
            h = pdf[pdf["f"] == (cut[0] if cut[0] >= 0 else pdf["f"].iloc[0])]
            below = h["n"][h["key"] % 256 <= cut[1]].sum()
            cls, which = np.unique(h["key"] // 256, return_inverse=True)
            p = np.bincount(which, h["w"]) if classes else np.array([h["s"].sum()])
            return pd.DataFrame([{"tree": t, "node": v, "f": cut[0], "at": cut[1], "gain": gain, "lower": below, "upper": h["n"].sum() - below,
                                  "cls": cls.astype(np.int32).tobytes(), "p": (p / h["w"].sum()).tobytes()}])

        sums = rows.mapInArrow(histogram, "tree int, node int, f int, key long, w double, s double, n long").groupBy(
            "tree", "node", "f", "key").agg(F.sum("w").alias("w"), F.sum("s").alias("s"), F.sum("n").alias("n"))
        found = sums.groupBy("tree", "node").applyInPandas(
            best, "tree int, node int, f int, at int, gain double, lower long, upper long, cls binary, p binary").collect()  # one row a large node
        large = {}
        for r in sorted(found, key=lambda r: (r["tree"], r["node"])):
            t, v, top = r["tree"], r["node"], tops[r["tree"]]
            if r["f"] < 0:
                done[t, v] = np.frombuffer(r["cls"], np.int32), np.frombuffer(r["p"])
                continue
            gains[t][r["f"]] += r["gain"]
            at = len(top["feat"])
            top["feat"][v], top["bin"][v], top["left"][v] = r["f"], r["at"], at
            for c, new in (("feat", -1), ("bin", 0), ("left", 0)):
                top[c] = np.append(top[c], np.array([new, new], top[c].dtype))
            top["depth"] += [top["depth"][v] + 1] * 2
            if top["depth"][at] < max_depth:
                large.setdefault(t, []).extend(at + i for i, size in enumerate((r["lower"], r["upper"])) if size > most)
        large = {t: v for t, v in large.items() if v}
    return done, gains
